"""Documents to packed training sequences in five stages, each of one operator of ``boxeval.llm``.

Every stage takes the documents that the one before has kept and returns
documents again, with all their columns; the last returns the pieces and their
places.  Rows without an id are not rejected for that, and merged with each other only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.llm.common import bounded_batches, fixture_contents, new_name
from boxeval.llm.jaccard import near_duplicates
from boxeval.llm.quality import fit_quality, quality_score
from boxeval.llm.queries import packed, verdicts
from boxeval.llm.secrets import masked, secrets
from boxeval.llm.toxicity import fit_toxicity, toxicity
from boxeval.streaming.sinks import remove_folder, work_folder

#: Scores below (quality) or from (toxicity) which a document is rejected.
LEAST_QUALITY, MOST_TOXIC = 0.3, 0.5


def _texts(docs: DataFrame) -> DataFrame:
    return fixture_contents(docs, "doc_id", "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least ``LEAST_QUALITY``; all of them if there are no verdicts to learn from."""
    bounded_batches(spark)
    model = fit_quality(_texts(docs), verdicts(spark, sf_dir, "quality"))
    return docs.where(quality_score(F.col("text"), model) >= LEAST_QUALITY)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``MOST_TOXIC``."""
    bounded_batches(spark)
    model = fit_toxicity(_texts(docs), verdicts(spark, sf_dir, "toxic"))
    return docs.where(toxicity(F.col("text"), model)["score"] < MOST_TOXIC)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id; of a class's rows without an id, one as well.

    Rows are told apart by all their columns, so that an id with several texts
    has a document for each of them, and which row of a class stays is fixed.
    Keys have 64 bits: n rows share one by chance about n^2 / 2^65 times.
    """
    key = new_name("key", docs.columns)
    # a null adds nothing to a hash, so nulls are told apart by their places
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))
    classes = near_duplicates(fixture_contents(keyed, key, "text")).distinct()
    ids = keyed.select(F.col(key).alias("id"), "doc_id").distinct()
    first = ids.join(classes, "id").groupBy("class_id", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "id")).alias("first"))
    stays = first.select(F.col("first.id").alias(key))
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).drop(key)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets; ``n_chars`` is that of the new text.

    Encoded runs that could not be read as a whole are replaced by '[unread]'.
    """
    bounded_batches(spark)
    name = new_name("found", docs.columns)
    found = docs.withColumn(name, secrets(F.col("text")))
    clean = found.withColumn("text", masked(F.col("text"), F.concat(f"{name}.spans", f"{name}.unread"))).drop(name)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packed(_texts(docs))


STAGES = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near copies", near_copies),
    ("secrets", without_secrets),
    ("packing", sequences),
]

#: Models, decoding and tokens have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again.

    A stage's rows are deleted once the next one has been written; those of the
    last stay, as the result is read from there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
    return docs
