"""Reading and writing files of contents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.bindings import observations, table
from boxeval.operators.metrics import summarise
from boxeval.queries.registry import query
from boxeval.queries.views import OBS
from boxeval.session import cut
from boxeval.sources import readers as S
from boxeval.streaming.sinks import remove_folder, work_folder


@query(
    "s7_sniff_contents",
    """SELECT page_id, CASE WHEN strlen(html) > 4000 THEN 'too-large' WHEN NOT starts_with(html, '<!DOCTYPE') THEN 'not-a-page' END AS code FROM pages""",
)
def sniff_contents(spark: SparkSession, sf: str) -> DataFrame:
    code = S.sniff_contents(F.col("html"), F.octet_length("html"), b"<!DOCTYPE", "page", 4000)
    return table(spark, sf, "pages").select("page_id", code.alias("code"))


@query(
    "s8_write_report",
    f"""WITH {OBS} SELECT 'lines' AS suite, candidate AS engine, stage, style, count(*) AS observations, CAST(sum(exact) AS BIGINT) AS exact FROM obs GROUP BY candidate, stage, style""",
)
def write_report(spark: SparkSession, sf: str) -> DataFrame:
    summary = summarise(observations(spark, sf), ["candidate", "stage", "style"])
    rows = summary.select(
        F.lit("lines").alias("suite"), F.col("candidate").alias("engine"), "stage", "style", "observations", "exact"
    )
    folder = work_folder(spark, "report")
    S.write_report(rows, folder, ["suite", "engine"])
    kinds = "stage string, style string, observations bigint, exact bigint, suite string, engine string"
    report = cut(spark.read.schema(kinds).json(folder))
    remove_folder(spark, folder)
    return report


@query(
    "s4_read_reports",
    """SELECT CAST(event_id AS BIGINT) AS run, event_type AS engine, value AS ms FROM events""",
)
def read_reports(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select("event_id", "event_type", "value")
    folder = work_folder(spark, "runs")
    run = F.struct(F.col("event_id").cast("int").alias("run"), F.col("value").alias("totalMs"))
    documents = runs.select(F.lit("events").alias("suite"), F.col("event_type").alias("engine"), F.array(run).alias("runs"))
    S.write_report(documents, folder, ["suite"])
    read, _ = S.read_reports(spark, folder, lines=True)
    rows = cut(read.select(F.col("run").cast("bigint").alias("run"), "engine", F.col("totalMs").alias("ms")))
    remove_folder(spark, folder)
    return rows
