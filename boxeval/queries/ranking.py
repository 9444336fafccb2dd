"""Top-k, suppression, ordered windows and latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.bindings import predictions, requests, runs, windows
from boxeval.operators import suppression as K
from boxeval.functions.register import register_distribution
from boxeval.operators.distribution import cold_warm, distribution
from boxeval.operators.ordered import first_flag, row_numbers
from boxeval.queries.registry import query
from boxeval.queries.views import BOXES, REQUESTS, RUNS, WINDOWS

_IOU = (
    "(greatest(0.0, least({a}x + {a}side, {b}x + {b}side) - greatest({a}x, {b}x))"
    " * greatest(0.0, least({a}y + {a}side, {b}y + {b}side) - greatest({a}y, {b}y)))"
)


def _iou(a: str, b: str) -> str:
    shared = _IOU.format(a=a, b=b)
    return f"({shared} / ({a}side * {a}side + {b}side * {b}side - {shared}))"


_BOXED = "x AS x0, y AS y0, x + side AS x1, y + side AS y1"


@query(
    "k1_top_k",
    f"""WITH {WINDOWS} SELECT * FROM (SELECT page, seq, {_BOXED}, score,
      CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, seq) AS INTEGER) AS rank FROM wins) WHERE rank <= 3""",
)
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return K.top_k(K.with_corners(windows(spark, sf)), 3)


def diverse_sql(wins: str, k: int) -> str:
    """Twin of the diverse list over a table expression ``wins``."""
    return f"""WITH RECURSIVE {wins},
ranked AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY seq) AS rn,
  {{'worse': -score, 'seq': seq, 'x': x, 'y': y, 'side': side}} AS one FROM wins),
walk AS (
  SELECT page, rn AS k, [one] AS kept FROM ranked WHERE rn = 1
  UNION ALL
  SELECT s.page, s.rn, CASE WHEN s.met IS NOT NULL AND s.met.worse <= s.one.worse THEN s.kept
    ELSE list_sort(list_append(list_filter(s.kept, lambda e: s.met IS NULL OR e.seq <> s.met.seq), s.one))[1:{k}] END
  FROM (SELECT w.page, r.rn, r.one, w.kept, list_filter(w.kept, lambda e: {_iou('e.', 'r.one.')} >= 0.75)[1] AS met
        FROM walk w JOIN ranked r ON r.page = w.page AND r.rn = w.k + 1) s),
final AS (SELECT page, arg_max(kept, k) AS kept FROM walk GROUP BY page),
listed AS (SELECT page, unnest(kept) AS w, generate_subscripts(kept, 1) AS rank FROM final)
SELECT page, w.seq AS seq, w.x AS x0, w.y AS y0, w.x + w.side AS x1, w.y + w.side AS y1, -w.worse AS score, CAST(rank AS INTEGER) AS rank FROM listed"""


@query("k2_diverse_top_k", diverse_sql(WINDOWS, 4))
def diverse_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return K.diverse_top_k(K.with_corners(windows(spark, sf)), k=4)


def suppress_sql(wins: str, abstain: bool) -> str:
    """Twin of suppression over a table expression ``wins``."""
    rival = f"""WHERE NOT EXISTS (SELECT 1 FROM wins o WHERE o.page = m.page
        AND (-o.score > m.one.worse OR (-o.score = m.one.worse AND o.seq > m.one.seq)) AND {_iou('m.one.', 'o.')} >= 0.72
        AND (abs(m.one.x - o.x) > greatest(1.5, least(m.one.side, o.side) / 32) OR abs(m.one.y - o.y) > greatest(1.5, least(m.one.side, o.side) / 32)
          OR abs(m.one.side - o.side) > greatest(1.5, least(m.one.side, o.side) / 32) * 2)
        AND (-m.one.worse - o.score) / -m.one.worse <= 0.035::DOUBLE)"""
    return f"""WITH RECURSIVE {wins},
ranked AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY score DESC, seq) AS rn,
  {{'worse': -score, 'seq': seq, 'x': x, 'y': y, 'side': side}} AS one FROM wins),
walk AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT) AS k, [one] AS kept, false AS took FROM ranked WHERE rn = 1
  UNION ALL
  SELECT s.page, s.rn, CASE WHEN s.take THEN CASE WHEN s.k = 0 THEN [s.one] ELSE list_append(s.kept, s.one) END ELSE s.kept END, s.take
  FROM (SELECT w.page, w.k, r.rn, r.one, w.kept,
          -r.one.worse >= 1.15::DOUBLE AND (w.k = 0 OR len(list_filter(w.kept, lambda e: {_iou('e.', 'r.one.')} >= 0.72)) = 0) AS take
        FROM walk w JOIN ranked r ON r.page = w.page AND r.rn = w.k + 1) s),
kept AS (SELECT r.page, r.one FROM walk w JOIN ranked r ON r.page = w.page AND r.rn = w.k WHERE w.took),
clear AS (SELECT m.page, m.one FROM kept m {rival if abstain else ''}),
listed AS (SELECT page, one, CAST(row_number() OVER (PARTITION BY page ORDER BY one.worse, one.seq) AS INTEGER) AS rank FROM clear)
SELECT page, one.seq AS seq, one.x AS x0, one.y AS y0, one.x + one.side AS x1, one.y + one.side AS y1, -one.worse AS score, rank
FROM listed WHERE rank <= 4"""


@query("k3_suppress", suppress_sql(WINDOWS, False))
def suppress(spark: SparkSession, sf: str) -> DataFrame:
    return K.suppress(K.with_corners(windows(spark, sf)), abstain=False)


@query("k4_abstain_ambiguous", suppress_sql(WINDOWS, True))
def abstain_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    return K.suppress(K.with_corners(windows(spark, sf)))


@query("k4_abstain_rounds", suppress_sql(WINDOWS, True))
def abstain_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return K.suppress_rounds(K.with_corners(windows(spark, sf)))


@query(
    "k5_cap_predictions",
    f"WITH {BOXES} SELECT page, count(*) AS predictions, 'too-many-predictions' AS reason FROM pred GROUP BY page HAVING count(*) > 4",
)
def cap_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return K.over_limit(predictions(spark, sf))


@query("w1_mark_cold", f"WITH {RUNS} SELECT event_id, user_id, day, run = 0 AS cold FROM runs")
def mark_cold(spark: SparkSession, sf: str) -> DataFrame:
    marked = first_flag(runs(spark, sf), ["user_id", "day"], ["ts", "event_id"], "cold")
    return marked.select("event_id", "user_id", "day", "cold")


@query(
    "w2_check_cold_sequence",
    f"""WITH {RUNS} SELECT event_id, event_type = 'signup' AS recorded, run = 0 AS cold, 'cold-sequence-invalid' AS message
    FROM runs WHERE (event_type = 'signup') <> (run = 0)""",
)
def check_cold_sequence(spark: SparkSession, sf: str) -> DataFrame:
    marked = first_flag(runs(spark, sf), ["user_id", "day"], ["ts", "event_id"], "cold")
    recorded = marked.withColumn("recorded", F.col("event_type") == "signup")
    return recorded.where(F.col("recorded") != F.col("cold")).select(
        "event_id", "recorded", "cold", F.lit("cold-sequence-invalid").alias("message")
    )


@query(
    "w3_latest_request",
    f"WITH {REQUESTS} SELECT event_id, key, request_id, latest, request_id = latest AS current FROM requests",
)
def latest_request(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).select(
        "event_id", "key", "request_id", "latest", (F.col("request_id") == F.col("latest")).alias("current")
    )


@query("w5_run_number", f"WITH {RUNS} SELECT event_id, user_id, day, run FROM runs")
def run_number(spark: SparkSession, sf: str) -> DataFrame:
    numbered = row_numbers(
        runs(spark, sf), ["user_id", "day"], [F.col("ts"), F.col("event_id")], "number"
    )
    return numbered.select("event_id", "user_id", "day", (F.col("number") - 1).alias("run"))


def _five(value: str, prefix: str = "", only: str = "true") -> str:
    used = f"FILTER (WHERE {only})"
    return f"""count({value}) {used} AS {prefix}count, min({value}) {used} AS {prefix}min,
      quantile_disc({value}, 0.5) {used} AS {prefix}p50, quantile_disc({value}, 0.95) {used} AS {prefix}p95, max({value}) {used} AS {prefix}max"""


_DISTRIBUTION = f"WITH {RUNS} SELECT engine, style, {_five('ms')} FROM runs GROUP BY engine, style"


@query("m9_distribution", _DISTRIBUTION)
def distribution_query(spark: SparkSession, sf: str) -> DataFrame:
    return distribution(runs(spark, sf), ["engine", "style"], "ms")


@query("f2_distribution", _DISTRIBUTION)
def distribution_function(spark: SparkSession, sf: str) -> DataFrame:
    """M9 as a table-valued SQL function."""
    runs(spark, sf).createOrReplaceTempView("boxeval_runs")
    register_distribution(spark, "boxeval_runs", ["engine", "style"], "ms")
    return spark.sql("SELECT * FROM distribution()")


@query("m9_distribution_large_groups", _DISTRIBUTION)
def counted_distribution_query(spark: SparkSession, sf: str) -> DataFrame:
    """Over values that come with their counts."""
    counted = runs(spark, sf).groupBy("engine", "style", "ms").agg(F.count("*").alias("n"))
    return distribution(counted, ["engine", "style"], "ms", weight="n")


@query(
    "m10_cold_warm",
    f"""WITH {RUNS} SELECT engine, {_five('ms', 'cold_', 'run = 0')}, {_five('ms', 'warm_', 'run > 0')}, {_five('ms', 'all_')}
    FROM runs GROUP BY engine""",
)
def cold_warm_query(spark: SparkSession, sf: str) -> DataFrame:
    marked = first_flag(runs(spark, sf), ["user_id", "day"], ["ts", "event_id"], "cold")
    return cold_warm(marked, ["engine"], "ms", "cold")
