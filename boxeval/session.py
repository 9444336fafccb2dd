"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("boxeval")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


@functools.lru_cache(maxsize=4)
def _shipped(application: str) -> str:
    """An archive of the package; the driver serves it to all Python workers."""
    package = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='boxeval-')}/boxeval.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    return archive


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they were started."""
    context = spark.sparkContext
    archive = _shipped(context.applicationId)
    if Path(archive).name not in {Path(f).name for f in context._python_includes}:
        context.addPyFile(archive)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of this machine is only used in local mode, where none is set.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="boxeval-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    Iterative operators use this between rounds: the lineage stays short and
    a lost executor re-reads files instead of replaying earlier rounds.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
