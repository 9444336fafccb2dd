"""Catalogues, indexes, inventories, reports and raw contents as tables.

All schemas are given, so nothing is inferred from the data.  A given schema
hides what it does not know, so each kind of document also has its list of
problems: files that are no such document, and keys that nobody declared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from boxeval.functions.text import is_iso_date
from boxeval.operators.contracts import Rule, broken

SIZE_LIMIT = 256 * 1024 * 1024
_RECT = "struct<x:int,y:int,width:int,height:int>"
_STYLE = "struct<kind:string,gray:double,angle:int,density:string>"
_TRUTH = (
    f"struct<id:string,kind:string,pixelRect:{_RECT},canonicalPlacement:string,renderedPlacement:string,"
    f"orientation:string,pieceStyle:string,squareStyle:{_STYLE},hasCoordinateLabels:boolean,borderWidthPx:int>"
)
CATALOGUE = (
    "schemaVersion int, corpusId string, corpusVersion int, lockedBeforeTuning boolean, coordinateSystem string, "
    "pageWidth int, pageHeight int, "
    "matching struct<rule:string,iouThreshold:double,tieBreakers:array<string>,duplicatePredictions:string,partialAnnotations:string>, "
    "tolerance struct<rectanglePixels:int,gridErrorSquares:double>, "
    "pages array<struct<id:string,path:string,sha256:string,width:int,height:int,tags:array<string>,"
    "generator:struct<spec:string,seed:bigint,degradation:map<string,double>>,"
    f"annotations:array<{_TRUTH}>>>, generation variant, contactSheet variant, _corrupt_record string"
)
INDEX = (
    "schemaVersion int, fixtures array<struct<id:string,sha256:string,path:string,contentType:string,"
    "source:struct<kind:string,generator:string,url:string,license:string,retrieved:string>,tags:array<string>,"
    "expected:variant,tolerance:variant,limitations:array<string>,consumers:array<string>,addedInIssue:int>>, "
    "_corrupt_record string"
)
EVIDENCE = (
    "schemaVersion int, issue int, commit string, date string, deviceClass string, os string, browser string, "
    "installed boolean, url string, capabilities map<string,string>, crossOriginIsolated boolean, "
    "widthsTried array<struct<mode:string,cssWidth:int>>, result string, notes string, evidence array<string>, "
    "limitations array<string>, _corrupt_record string"
)
REPORT = (
    "suite string, engine string, "
    "runs array<struct<run:int,phase:string,placement:string,orientation:string,reliable:boolean,exactMatch:boolean,"
    "totalMs:double,inferenceMs:double,coldStart:boolean>>, _corrupt_record string"
)


def _documents(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One JSON document per file, or per line, with the file it came from."""
    read = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return read.withColumn("file", F.col("_metadata.file_path"))


def _keys(kind: DataType) -> dict[str, list[str]]:
    """Declared keys per place of a document: its own, and those of the records in its lists."""
    found = {"$": [f.name for f in kind.fields if f.name != "_corrupt_record"]}
    for field in kind.fields:
        if isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StructType):
            for place, keys in _keys(field.dataType.elementType).items():
                found[f"$.{field.name}" + place[1:]] = keys
    return found


def _texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """``file, value`` of each document as text; blank lines are none."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.where(F.btrim("value") != "") if lines else raw


def document_problems(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """``file, problem`` for each document that is no JSON object, and each key that ``schema`` does not declare.

    A document is a file, or a line with ``lines``.  Keys are looked at in the
    document itself and in the records of its lists.
    """
    raw = _texts(spark, path, lines)
    top = F.json_object_keys("value")
    unknown = []
    for place, declared in _keys(StructType.fromDDL(schema)).items():
        steps = place.split(".")[1:]
        if steps:
            kind = "array<map<string,string>>"
            for step in reversed(steps[1:]):
                kind = f"array<struct<{step}:{kind}>>"
            rows = F.from_json(F.get_json_object("value", f"$.{steps[0]}"), kind)
            for step in steps[1:]:
                rows = F.flatten(F.filter(rows.getField(step), lambda r: r.isNotNull()))
            keys = F.flatten(F.transform(F.filter(rows, lambda r: r.isNotNull()), F.map_keys))
        else:
            keys = top
        extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, declared)))
        unknown.append(_prefixed(extra, place))
    problems = F.when(top.isNull(), F.array(F.lit("not-an-object"))).otherwise(F.concat(*unknown))
    return raw.select("file", F.explode(problems).alias("problem"))


def _prefixed(keys: Column, place: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(f"unknown-key:{place}."), k))


def read_catalogue(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """A corpus catalogue as ``corpus``, ``pages``, ``truth``, ``page_tags`` and ``problems``.

    A document in a file of its own is read by one task.  With ``lines`` each
    line is a document with some of the catalogue's pages, as
    :func:`write_catalogue` leaves it, and a file is split over many tasks.
    """
    docs = _documents(spark, path, CATALOGUE, lines)
    pages = docs.select("corpusId", F.inline("pages"))
    flat = pages.select(
        F.col("corpusId").alias("corpus_id"),
        F.col("id").alias("page"),
        "path",
        "sha256",
        "width",
        "height",
        F.col("generator.spec").alias("spec"),
        F.col("generator.seed").alias("seed"),
        F.col("generator.degradation").alias("degradation"),
    )
    truth = pages.select(F.col("id").alias("page"), F.posexplode("annotations").alias("a", "t")).select(
        "page",
        "a",
        F.col("t.id").alias("annotation_id"),
        "t.kind",
        "t.pixelRect.*",
        F.col("t.canonicalPlacement").alias("canonical"),
        F.col("t.renderedPlacement").alias("rendered"),
        "t.orientation",
        F.col("t.squareStyle").alias("square_style"),
        F.col("t.hasCoordinateLabels").alias("has_labels"),
        F.col("t.borderWidthPx").alias("border_px"),
    )
    tags = pages.select(F.col("id").alias("page"), F.posexplode("tags").alias("at", "tag"))
    return {"corpus": docs.drop("pages"), "pages": flat, "truth": truth, "page_tags": tags, "problems": document_problems(spark, path, CATALOGUE, lines)}


def write_catalogue(pages: DataFrame, path: str, corpus: str, head: dict[str, Column] | None = None, in_one: int = 64) -> None:
    """Write pages as catalogue documents, one per line, of about ``in_one`` pages each.

    ``pages`` has the fields of a page as the catalogue declares them, its
    annotations in one row with it, and a column ``corpus`` with the id of the
    corpus it is in; ``head`` are other fields of the document.  Pages are dealt
    by a hash of their id, so no document, and no task, holds a whole corpus.
    """
    page = F.struct(*(c for c in pages.columns if c != corpus))
    parts = max(1, -(-pages.count() // in_one))
    dealt = pages.select(F.col(corpus).alias("corpusId"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), page.alias("page"))
    documents = dealt.groupBy("corpusId", "part").agg(F.collect_list("page").alias("pages"))
    fields = {"schemaVersion": F.lit(1)} | (head or {})
    documents.select(*(c.alias(n) for n, c in fields.items()), "corpusId", "pages").write.json(path)


def read_fixture_index(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fixture entries, whose open ``expected`` and ``tolerance`` objects stay variants, and the documents' problems.

    A document is a file, or a line with ``lines``.
    """
    entries = _documents(spark, path, INDEX, lines).select("schemaVersion", "file", F.inline("fixtures"))
    return entries, document_problems(spark, path, INDEX, lines)


def wanted_values(index: DataFrame, wanted: Column, kind: str) -> Column:
    """What ``expected`` holds at a path that each row names; null where nothing of that kind is there."""
    return F.when(wanted.isNotNull(), F.try_variant_get("expected", wanted, kind))


def expected_fields(index: DataFrame) -> DataFrame:
    """``id, field, value`` of each field of the ``expected`` objects, whatever fields they have; values stay variants.

    An ``expected`` that is no object has none.
    """
    objects = index.where(F.schema_of_variant("expected").startswith("OBJECT")).select("id", "expected")
    fields = index.sparkSession.tvf.variant_explode(F.col("expected").outer())
    return objects.lateralJoin(fields).select("id", F.col("key").alias("field"), "value")


def lookup_fixture(index: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries for the wanted ids, and the ids that are not in the index."""
    return index.join(ids, "id", "left_semi"), ids.join(index, "id", "left_anti")


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored evaluation reports, one row per run with the file as lineage, and the documents that are none.

    A report is a file, or a line with ``lines``.
    """
    documents = _documents(spark, path, REPORT, lines)
    good = F.col("_corrupt_record").isNull() & F.col("runs").isNotNull()
    return documents.where(good).select("suite", "engine", "file", F.inline("runs")), documents.where(~good).select("file", "_corrupt_record")


def read_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A licence-to-packages map as rows, and the files that are no such map."""
    kind = "map<string,array<struct<name:string,versions:array<string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = raw.withColumn("groups", F.from_json("value", kind, {"mode": "PERMISSIVE"}))
    complete = F.forall(
        F.map_values("groups"),
        lambda packages: packages.isNotNull()
        & F.forall(packages, lambda p: p["name"].isNotNull() & p["versions"].isNotNull()),
    )
    good = F.coalesce(complete, F.lit(False))
    rows = parsed.where(good).select("file", F.explode("groups").alias("licence", "packages"))
    return rows.select("file", "licence", F.inline("packages")), parsed.where(~good).select("file")


def read_inventory_members(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Licence-to-packages maps, one per line, as packages, and what is wrong with members of them.

    The packages are ``file, licence, name, versions``.  A member of a map or of
    a list that is not what it should be is a row of the second table, with its
    ``file, licence, problem`` and JSON as ``member``, and takes nothing else
    with it: ``not-a-map`` (a line), ``not-a-list`` (of packages), ``no-name``,
    ``no-versions`` (a list of texts).
    """
    lines = _texts(spark, path, True).withColumn("groups", F.from_json("value", "map<string,variant>"))
    none = F.lit(None).cast("string")
    torn = lines.where(F.col("groups").isNull()).select("file", none.alias("licence"), F.lit("not-a-map").alias("problem"), F.col("value").alias("member"))
    groups = lines.select("file", F.explode("groups").alias("licence", "packages"))
    groups = groups.withColumn("each", F.try_variant_get("packages", "$", "array<variant>"))
    no_list = groups.where(F.col("each").isNull()).select("file", "licence", F.lit("not-a-list").alias("problem"), F.to_json("packages").alias("member"))
    members = groups.select("file", "licence", F.explode("each").alias("p"))
    members = members.select(
        "file", "licence", F.to_json("p").alias("member"), _text_at("p", "$.name").alias("name"),
        F.try_variant_get("p", "$.versions", "array<variant>").alias("v"),
    )
    texts = F.transform("v", lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")))
    members = members.withColumn("versions", F.when(F.forall(texts, lambda t: t.isNotNull()), texts)).drop("v")
    problem = F.when(F.col("name").isNull(), F.lit("no-name")).when(F.col("versions").isNull(), F.lit("no-versions"))
    bad = members.where(problem.isNotNull()).select("file", "licence", problem.alias("problem"), "member")
    return members.where(problem.isNull()).select("file", "licence", "name", "versions"), torn.unionByName(no_list).unionByName(bad)


def _text_at(variant: str, path: str) -> Column:
    found = F.try_variant_get(variant, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", found.cast("string"))


def shelves(contents: DataFrame, in_one: int = 128) -> int:
    """Into how many folders :func:`write_contents` has to deal texts so that each holds about ``in_one``."""
    return max(1, -(-contents.count() // in_one))


def write_contents(contents: DataFrame, path: str, name: str, content: str, tasks: int) -> None:
    """Write each text and a line's end to a file of its own, ``<name>.txt``; texts of one name are lines of one file.

    ``name`` is a whole number.  Texts are dealt out by it, and each task fills
    a folder.  Files get their names when they are complete, so a task that runs
    again replaces what it wrote.  Spark's own writers would need a folder for
    each name, and a listing and a rename for each folder.
    """
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    rows = contents.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))

    def fill(part: Iterator[Row]) -> None:
        store, root = _store(path)
        context = TaskContext.get()
        folder = f"{root}/shelf={context.partitionId()}"
        store.create_dir(folder, recursive=True)
        for one, texts in itertools.groupby(part, lambda row: row.name):
            begun = f"{folder}/.{one}-{context.taskAttemptId()}"
            with store.open_output_stream(begun) as out:
                for row in texts:
                    out.write((row.content or b"") + b"\n")
            store.move(begun, f"{folder}/{one}.txt")

    rows.repartition(tasks, "name").sortWithinPartitions("name").foreachPartition(fill)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def read_contents(
    spark: SparkSession, path: str, pattern: str = "*", after: str | None = None, before: str | None = None, tasks: int | None = None
) -> DataFrame:
    """Files as bytes with path and length; those changed after or before a moment (``YYYY-MM-DDTHH:mm:ss``) if asked for.

    Names and times are looked at when files are listed, so what is not wanted is not read.
    Every few small files are a task of their own, unless ``tasks`` says how many there may be at most.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    for name, moment in (("modifiedAfter", after), ("modifiedBefore", before)):
        if moment is not None:
            read = read.option(name, moment)
    files = read.load(path)
    return files if tasks is None else files.coalesce(tasks)


def read_evidence(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Device records, one per file or line, and what is wrong with any of them as ``file, problem``."""
    records = _documents(spark, path, EVIDENCE, lines)
    found = broken(evidence_rules())
    faults = records.select("file", F.explode(F.transform(found, lambda f: F.concat_ws(":", f["path"], f["message"]))).alias("problem"))
    return records, document_problems(spark, path, EVIDENCE, lines).unionByName(faults)


def evidence_rules() -> list[Rule]:
    """What the fields of a device record must be."""
    # fixed values: device classes, capabilities and their states, results
    capabilities = ("indexeddb", "opfs", "workers", "webassembly", "storage-estimate", "storage-persistence", "touch", "cross-origin-isolation")
    states = ("supported", "unsupported", "unknown", "error")
    named, held = F.map_keys("capabilities"), F.map_values("capabilities")
    complete = F.array_sort(named) == F.array(*map(F.lit, sorted(capabilities)))
    return [
        Rule("schemaVersion", "must be 1", F.col("schemaVersion") == 1),
        Rule("issue", "must be positive", F.col("issue") >= 1),
        Rule("commit", "must be a hash", F.col("commit").rlike("^[0-9a-f]{7,40}$")),
        Rule("date", "must be a day", is_iso_date(F.col("date"), real_day=True)),
        Rule("deviceClass", "must be known", F.col("deviceClass").isin("ipad", "android", "laptop")),
        *(Rule(c, "must not be empty", F.length(c) > 0) for c in ("os", "browser")),
        *(Rule(c, "must be given", F.col(c).isNotNull()) for c in ("installed", "crossOriginIsolated", "notes", "evidence", "limitations")),
        Rule("url", "must be an https origin", F.col("url").rlike("^https://[^/]+/?$")),
        Rule("capabilities", "must be the declared ones", complete),
        Rule("capabilities", "must have known states", F.forall(held, lambda s: s.isin(*states))),
        Rule("widthsTried", "must have modes and widths", F.forall("widthsTried", lambda w: (F.length(w["mode"]) > 0) & (w["cssWidth"] >= 1))),
        Rule("result", "must be known", F.col("result").isin("pass", "fail", "partial")),
    ]


def sniff_contents(content: Column, length: Column, magic: bytes, kind: str, limit: int = SIZE_LIMIT) -> Column:
    """``too-large``, ``not-a-<kind>`` or null; the size is looked at first."""
    start = F.substring(content.cast("binary"), 1, len(magic)) == F.lit(magic)
    return F.when(length > limit, F.lit("too-large")).when(
        ~F.coalesce(start, F.lit(False)), F.lit(f"not-a-{kind}")
    )


def write_report(df: DataFrame, path: str, parts: list[str], mode: str = "errorifexists") -> None:
    """Write report rows as JSON lines, one folder per suite and engine.

    Rows stay rows: a report that gathers a whole group into one document would
    have to fit into one task.
    """
    df.write.mode(mode).partitionBy(*parts).json(path)
