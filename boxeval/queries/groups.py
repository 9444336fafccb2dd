"""Plans, grouped summaries, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.bindings import (
    EXPECTED_BOARD,
    evidence,
    observations,
    planned_pages,
    planned_truth,
    predictions,
    raw_runs,
    runs,
    table,
)
from boxeval.operators import gates as Q
from boxeval.operators import metrics as M
from boxeval.operators.distribution import distribution
from boxeval.operators.ordered import row_numbers
from boxeval.operators.suppression import over_limit
from boxeval.plans import inputs as P
from boxeval.queries.registry import query
from boxeval.queries.views import BOXES, OBS, RAW, RUNS, SUMMARY

_PLAN_SQL = f"""WITH {BOXES}, ann AS (SELECT page, a, CASE WHEN l_linenumber <= 3 THEN 'complete' ELSE 'partial' END AS kind,
  'style-' || CAST(l_partkey % 5 AS VARCHAR) AS style, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM truth),
styles AS (SELECT page, list_sort(list_distinct(list(style))) AS s FROM ann GROUP BY page),
plan AS (
  SELECT 'classifier:' || page || ':' || a AS input_id, page, 'classifier' AS stage, style, a, true AS oracle, x AS crop_x, y AS crop_y, w AS crop_width, h AS crop_height FROM ann WHERE kind = 'complete'
  UNION ALL
  SELECT 'manual:' || page || ':' || a, page, 'manual', style, a, false, greatest(0.0, floor(x - w * 0.08::DOUBLE)), greatest(0.0, floor(y - w * 0.08::DOUBLE)),
    least(800.0, ceil(x + w + w * 0.08::DOUBLE)) - greatest(0.0, floor(x - w * 0.08::DOUBLE)), least(800.0, ceil(y + h + w * 0.08::DOUBLE)) - greatest(0.0, floor(y - w * 0.08::DOUBLE)) FROM ann
  UNION ALL
  SELECT 'full-page:' || o_orderkey, o_orderkey, 'full-page', CASE WHEN s IS NULL THEN 'negative' WHEN len(s) = 1 THEN s[1] ELSE 'mixed:' || array_to_string(s, '+') END,
    NULL, false, 0.0, 0.0, 800.0, 800.0 FROM orders LEFT JOIN styles ON page = o_orderkey)"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return P.plan_inputs(planned_pages(spark, sf), planned_truth(spark, sf))


@query("p1_plan_inputs", f"{_PLAN_SQL} SELECT * FROM plan")
def plan_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)


@query(
    "p2_plan_truth",
    f"""{_PLAN_SQL} SELECT p.page, p.input_id, t.a AS truth_a, t.x - crop_x AS x0, t.y - crop_y AS y0, t.x + t.w - crop_x AS x1, t.y + t.h - crop_y AS y1
    FROM plan p JOIN ann t ON t.page = p.page AND t.kind = 'complete' AND (p.a IS NULL OR p.a = t.a)""",
)
def plan_truth(spark: SparkSession, sf: str) -> DataFrame:
    return P.plan_truth(_plan(spark, sf), planned_truth(spark, sf))


@query(
    "p3_assign_split",
    """SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'development' ELSE 'held-out' END AS split FROM documents""",
)
def assign_split(spark: SparkSession, sf: str) -> DataFrame:
    dev = table(spark, sf, "labels").where(F.col("toxic") == 1)
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return P.assign_split(docs, "doc_id", dev)


@query(
    "p4_page_style",
    f"{_PLAN_SQL} SELECT page, style FROM plan WHERE stage = 'full-page'",
)
def page_style(spark: SparkSession, sf: str) -> DataFrame:
    styled = P.page_styles(planned_pages(spark, sf), planned_truth(spark, sf))
    return styled.select("page", "style")


@query(
    "p4_style_key",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'flat-gray-' || CASE WHEN p_size % 2 = 0 THEN '0.5' ELSE '0.25' END
      WHEN 1 THEN 'hatch-' || p_size || '-' || p_brand WHEN 2 THEN 'halftone-' || p_brand END AS style FROM part""",
)
def style_key(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("flat", "hatch", "halftone", "unknown")))
    style = F.struct(
        F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("kind"),
        F.when(F.col("p_size") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.25)).alias("gray"),
        F.col("p_size").cast("int").alias("angle"),
        F.col("p_brand").alias("density"),
    )
    parts = table(spark, sf, "part").select("p_partkey", style.alias("style"))
    return parts.select("p_partkey", P.style_key(F.col("style")).alias("style"))


@query(
    "p5_sweep_grid",
    """SELECT source, edge, margin, 48::BIGINT AS expected FROM (SELECT DISTINCT source FROM documents),
      (SELECT CAST(unnest([160, 192, 224, 256, 288, 320, 352, 384]) AS BIGINT) AS edge), (SELECT CAST(unnest([0, 8, 16, 24, 32, 40]) AS BIGINT) AS margin)""",
)
def sweep_grid(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "documents").select("source").distinct()
    grid = P.sweep_grid(base, {"edge": list(range(160, 385, 32)), "margin": list(range(0, 41, 8))})
    return grid.withColumns({c: F.col(c).cast("bigint") for c in ("edge", "margin")})


@query(
    "j8_attach_plan",
    """SELECT l_orderkey AS page, l_linenumber AS repetition, o_orderstatus AS split, o_orderpriority AS style, o_orderkey IS NOT NULL AS planned
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'""",
)
def attach_plan(spark: SparkSession, sf: str) -> DataFrame:
    obs = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("repetition")
    )
    plan = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P")
    plan = plan.select(
        F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("style")
    )
    return P.attach_plan(obs, plan, "page")


@query(
    "j10_expected_grid",
    f"""WITH {RUNS} SELECT s.user_id, s.day, r.run FROM (SELECT DISTINCT user_id, day FROM runs) s, (SELECT CAST(unnest([0, 1]) AS BIGINT) AS run) r
    WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.user_id = s.user_id AND x.day = s.day AND x.run = r.run)""",
)
def expected_grid(spark: SparkSession, sf: str) -> DataFrame:
    numbered = row_numbers(runs(spark, sf), ["user_id", "day"], [F.col("ts"), F.col("event_id")], "n")
    seen = numbered.withColumn("run", F.col("n") - 1).select("user_id", "day", "run")
    return P.missing_runs(seen, seen, ["user_id", "day"], 2)


@query("m3_summarise", f"WITH {OBS} SELECT candidate, stage, {SUMMARY} FROM obs GROUP BY candidate, stage")
def summarise(spark: SparkSession, sf: str) -> DataFrame:
    return M.summarise(observations(spark, sf), ["candidate", "stage"])


def _five(value: str, prefix: str, only: str) -> str:
    used = f"FILTER (WHERE {only})"
    return f"""count({value}) {used} AS {prefix}count, min({value}) {used} AS {prefix}min, quantile_disc({value}, 0.5) {used} AS {prefix}p50,
      quantile_disc({value}, 0.95) {used} AS {prefix}p95, max({value}) {used} AS {prefix}max"""


@query(
    "m3_timings",
    f"""WITH {OBS} SELECT stage, {_five('ms', 'cold_', 'cold')}, {_five('ms', 'warm_', 'NOT cold')}, {_five('ms', 'all_', 'true')}, {_five('init_ms', 'init_', 'true')}
    FROM obs GROUP BY stage""",
)
def timings(spark: SparkSession, sf: str) -> DataFrame:
    return M.timings(observations(spark, sf), ["stage"])


@query(
    "m4_summarise_sets",
    f"""WITH {OBS} SELECT CASE WHEN grouping(input_id) = 0 THEN 'page+input_id' WHEN grouping(page) = 0 THEN 'page+stage' WHEN grouping(split) = 0 AND grouping(style) = 0 THEN 'split+stage+style'
      WHEN grouping(split) = 0 THEN 'split+stage' WHEN grouping(style) = 0 THEN 'stage+style' ELSE 'stage' END AS grouping,
      stage, style, split, page, input_id, {SUMMARY}
    FROM obs GROUP BY GROUPING SETS ((stage), (stage, style), (split, stage), (split, stage, style), (page, stage), (page, input_id))""",
)
def summarise_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = [["stage"], ["stage", "style"], ["split", "stage"], ["split", "stage", "style"], ["page", "stage"], ["page", "input_id"]]
    return M.summarise_sets(observations(spark, sf), sets)


@query(
    "m5_summarise_overlapping",
    f"""WITH {OBS}, tagged AS (SELECT *, tag1 AS tag FROM obs UNION ALL SELECT *, tag2 FROM obs) SELECT stage, tag, {SUMMARY} FROM tagged GROUP BY stage, tag""",
)
def summarise_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    return M.summarise_overlapping(observations(spark, sf), ["stage"])


@query(
    "m6_zero_filled_groups",
    f"""WITH {OBS}, d AS (SELECT * FROM (SELECT unnest(['development', 'held-out']) AS split), (SELECT unnest(['classifier', 'manual', 'full-page', 'replay']) AS stage))
    SELECT d.split, d.stage, count(o.page) AS observations, CAST(coalesce(sum(o.predictions), 0) AS BIGINT) AS predictions FROM d LEFT JOIN obs o ON o.split = d.split AND o.stage = d.stage GROUP BY ALL""",
)
def zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["split", "stage"]
    summed = M.summarise(observations(spark, sf), keys).select(*keys, "observations", "predictions")
    splits = F.explode(F.array(F.lit("development"), F.lit("held-out")))
    stages = F.explode(F.array(*(F.lit(s) for s in ("classifier", "manual", "full-page", "replay"))))
    domain = spark.range(1).select(splits.alias("split")).withColumn("stage", stages)
    return M.zero_filled(summed, domain, keys, ["observations", "predictions"])


@query(
    "m7_guard_mixed",
    f"""WITH {OBS} SELECT style, split, count(*) FILTER (WHERE oracle) AS with_box, count(*) FILTER (WHERE NOT oracle) AS without_box FROM obs GROUP BY style, split
    HAVING count(*) FILTER (WHERE oracle) > 0 AND count(*) FILTER (WHERE NOT oracle) > 0""",
)
def guard_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return M.guard_mixed(observations(spark, sf), ["style", "split"])


@query(
    "m13_paths_long",
    f"""WITH {OBS} SELECT style, CASE stage WHEN 'full-page' THEN 'normal' WHEN 'manual' THEN 'bounded' ELSE 'oracle' END AS path,
      CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(expected_boards) AS BIGINT) AS boards FROM obs GROUP BY ALL""",
)
def paths_long(spark: SparkSession, sf: str) -> DataFrame:
    stages = {"normal": "full-page", "bounded": "manual", "oracle": "classifier"}
    sums = [
        F.struct(
            F.sum(F.when(F.col("stage") == stage, F.col("exact"))).alias("exact"),
            F.sum(F.when(F.col("stage") == stage, F.col("expected_boards"))).alias("boards"),
        ).alias(path)
        for path, stage in stages.items()
    ]
    wide = observations(spark, sf).groupBy("style").agg(*sums)
    long = wide.unpivot(["style"], list(stages), "path", "v")
    return long.select("style", "path", "v.exact", "v.boards")


def _sides(spark: SparkSession, sf: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    obs = observations(spark, sf)
    return tuple(
        M.summarise(obs.where(F.col("candidate") == c), keys) for c in ("control", "candidate")
    )


_COMPARED = ["predictions", "matched", "exact", "exact_rate"]
_COMPARE_SQL = f"""WITH {OBS}, s AS (SELECT candidate, stage, repetition, {SUMMARY} FROM obs WHERE NOT (candidate = 'control' AND stage = 'manual' AND repetition = 7) GROUP BY candidate, stage, repetition),
b AS (SELECT * FROM s WHERE candidate = 'control'), c AS (SELECT * FROM s WHERE candidate = 'candidate')"""


@query(
    "j9_compare_candidates",
    f"""{_COMPARE_SQL} SELECT coalesce(b.stage, c.stage) AS stage, coalesce(b.repetition, c.repetition) AS repetition,
      {', '.join(f'b.{m} AS {m}_base, c.{m} AS {m}_cand' for m in _COMPARED)},
      CASE WHEN c.stage IS NULL THEN 'base-only' WHEN b.stage IS NULL THEN 'candidate-only' ELSE 'both' END AS side
    FROM b FULL JOIN c ON b.stage = c.stage AND b.repetition = c.repetition""",
)
def compare_candidates(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["stage", "repetition"]
    base, cand = _sides(spark, sf, keys)
    # one group is missing from the control, as a failed run would leave it
    base = base.where(~((F.col("stage") == "manual") & (F.col("repetition") == 7)))
    return M.compare(base, cand, keys, _COMPARED)


_DELTA_METRICS = """expected_boards predictions matched missed false_positive duplicate aligned exact correct_squares precision recall exact_rate square_rate
  reliable unreliable reliable_exact reliable_wrong reliable_wrong_study out_of_image correct_orientations orientation_rate"""
_DELTA_SQL = f"""WITH {OBS}, s AS (SELECT candidate, stage, {SUMMARY} FROM obs GROUP BY candidate, stage),
long AS (SELECT stage, candidate, unnest([{', '.join(f"{{'m': '{m}', 'v': CAST({m} AS DOUBLE)}}" for m in _DELTA_METRICS.split())}]) AS x FROM s),
d AS (SELECT b.stage, b.x.m AS metric, b.x.v AS base, c.x.v AS cand, c.x.v - b.x.v AS delta FROM long b JOIN long c ON b.stage = c.stage AND b.x.m = c.x.m
  WHERE b.candidate = 'control' AND c.candidate = 'candidate')"""


@query("m14_delta", f"{_DELTA_SQL} SELECT * FROM d")
def delta(spark: SparkSession, sf: str) -> DataFrame:
    base, cand = _sides(spark, sf, ["stage"])
    return M.delta(M.compare(base, cand, ["stage"], M.COMPARED), ["stage"], M.COMPARED)


@query(
    "q4_regression_gate",
    f"""{_DELTA_SQL} SELECT * FROM d WHERE (metric IN ('matched', 'aligned', 'exact', 'correct_squares', 'precision', 'recall', 'exact_rate', 'square_rate') AND delta < 0)
      OR (metric IN ('missed', 'false_positive', 'duplicate', 'reliable_wrong') AND delta > 0)""",
)
def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    return Q.regression_gate(delta(spark, sf))


@query(
    "m16_distinct_sorted",
    f"WITH {OBS} SELECT DISTINCT tag FROM (SELECT tag1 AS tag FROM obs UNION ALL SELECT tag2 FROM obs) ORDER BY tag",
)
def distinct_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


@query(
    "m19_orientation_metrics",
    f"""WITH {OBS} SELECT style, CAST(sum(identifiable) AS BIGINT) AS identifiable, CAST(sum(correct_orientations) AS BIGINT) AS correct, CAST(sum(ambiguous_truth) AS BIGINT) AS ambiguous_truth,
      CAST(sum(ambiguity_acknowledged) AS BIGINT) AS acknowledged, CAST(sum(correct_orientations) AS DOUBLE) / nullif(CAST(sum(identifiable) AS DOUBLE), 0) AS rate FROM obs WHERE NOT oracle GROUP BY style""",
)
def orientation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    summed = M.summarise(observations(spark, sf).where(~F.col("oracle")), ["style"])
    return summed.select(
        "style",
        "identifiable",
        F.col("correct_orientations").alias("correct"),
        "ambiguous_truth",
        F.col("ambiguity_acknowledged").alias("acknowledged"),
        F.col("orientation_rate").alias("rate"),
    )


@query(
    "q1_assess_observation",
    f"""WITH {RAW} SELECT event_id, array_to_string(infra, ',') AS infrastructure, CASE WHEN unsafe = 1 THEN 'reliable-wrong' ELSE '' END AS safety,
      CASE WHEN exact THEN '' ELSE 'candidate-not-exact' END AS qualification, total_ms, stage_ms FROM assessed""",
)
def assess_observation(spark: SparkSession, sf: str) -> DataFrame:
    done = Q.assess_observation(raw_runs(spark, sf), EXPECTED_BOARD, "v1")
    kinds = ("infrastructure", "safety", "qualification")
    return done.select("event_id", *(F.array_join(k, ",").alias(k) for k in kinds), "total_ms", "stage_ms")


_CASES = """declared AS (SELECT CAST(c_custkey AS BIGINT) AS case_id FROM customer UNION SELECT case_id FROM assessed),
cases AS (SELECT d.case_id, count(a.event_id) AS n, count(DISTINCT (a.session, a.run)) FILTER (WHERE a.event_id IS NOT NULL) AS keys,
    count(DISTINCT (a.session, a.run)) FILTER (WHERE a.session < 3) AS inside, CAST(coalesce(sum(len(a.infra)), 0) + count(a.odd) AS BIGINT) AS i,
    CAST(coalesce(sum(a.unsafe), 0) AS BIGINT) AS safety_failures, count(*) FILTER (WHERE NOT a.exact) AS q
  FROM declared d LEFT JOIN assessed a ON a.case_id = d.case_id GROUP BY d.case_id),
counted AS (SELECT *, CAST(i + CASE WHEN n <> 6 OR keys <> n THEN 1 ELSE 0 END + 6 - inside AS BIGINT) AS infrastructure_failures FROM cases)"""


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer is a case that should have been run."""
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("case_id"))


@query(
    "q2_assess_case",
    f"""WITH {RAW}, {_CASES}, t AS (SELECT *, q + infrastructure_failures + safety_failures AS qualification_failures FROM counted)
    SELECT case_id, infrastructure_failures, safety_failures, qualification_failures, CASE WHEN infrastructure_failures = 0 THEN 'PASS' ELSE 'FAIL' END AS infrastructure_status,
      CASE WHEN safety_failures = 0 THEN 'PASS' ELSE 'FAIL' END AS safety_status, CASE WHEN qualification_failures = 0 THEN 'PASS' ELSE 'FAIL' END AS qualification_status FROM t""",
)
def assess_case(spark: SparkSession, sf: str) -> DataFrame:
    done = Q.assess_observation(raw_runs(spark, sf), EXPECTED_BOARD, "v1")
    return Q.assess_case(done, "case_id", _declared(spark, sf))


@query(
    "q2_case_failures",
    f"""WITH {RAW}, {_CASES}, f AS (SELECT case_id, session, run, 'infrastructure' AS kind, unnest(infra) AS reason FROM assessed UNION ALL SELECT case_id, session, run, 'infrastructure', odd FROM assessed WHERE odd IS NOT NULL
      UNION ALL SELECT case_id, session, run, 'safety', 'reliable-wrong' FROM assessed WHERE unsafe = 1 UNION ALL SELECT case_id, session, run, 'qualification', 'candidate-not-exact' FROM assessed WHERE NOT exact
      UNION ALL SELECT d.case_id, s, r, 'infrastructure', 'missing' FROM declared d, range(3) AS x(s), range(2) AS y(r) WHERE NOT EXISTS (SELECT 1 FROM assessed a WHERE a.case_id = d.case_id AND a.session = s AND a.run = r))
    SELECT case_id, kind, 'session-' || session || '-run-' || run || ':' || reason AS failure, count(*) AS n FROM f GROUP BY ALL
    UNION ALL SELECT case_id, 'infrastructure', 'observation-count-or-identity-invalid', 1 FROM cases WHERE n <> 6 OR keys <> n""",
)
def case_failures(spark: SparkSession, sf: str) -> DataFrame:
    done = Q.assess_observation(raw_runs(spark, sf), EXPECTED_BOARD, "v1")
    return Q.case_failures(done, "case_id", _declared(spark, sf))


@query(
    "q3_threshold_gate",
    f"""WITH {OBS}, s AS (SELECT stage, {SUMMARY}, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM obs GROUP BY stage),
    m AS (SELECT stage, oracle, unnest([{{'m': 'exact_rate', 'v': exact_rate, 'l': 0.95, 'o': '>='}}, {{'m': 'square_rate', 'v': square_rate, 'l': 0.995, 'o': '>='}}, {{'m': 'p50_ms', 'v': p50, 'l': 1000.0, 'o': '<='}},
      {{'m': 'p95_ms', 'v': p95, 'l': 2000.0, 'o': '<='}}, {{'m': 'false_positive', 'v': CAST(false_positive AS DOUBLE), 'l': 0.0, 'o': '<='}}]) AS x FROM s)
    SELECT stage, x.m AS metric, x.v AS value, x.o AS op, CAST(x.l AS DOUBLE) AS "limit", CASE WHEN CASE x.o WHEN '>=' THEN x.v >= x.l ELSE x.v <= x.l END THEN 'PASS' ELSE 'FAIL' END AS status FROM m WHERE NOT (oracle AND x.m = 'false_positive')""",
)
def threshold_gate(spark: SparkSession, sf: str) -> DataFrame:
    obs = observations(spark, sf)
    times = distribution(obs, ["stage"], "ms").select(
        "stage", F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms")
    )
    names = [name for name, _, _ in Q.LIMITS]
    wide = M.summarise(obs, ["stage"]).join(times, "stage")
    wide = wide.select("stage", "oracle", *(F.col(n).cast("double").alias(n) for n in names))
    # nothing was to be found where boxes were given, so there is nothing to hold against the limit
    long = wide.unpivot(["stage", "oracle"], names, "metric", "value").where(~(F.col("oracle") & (F.col("metric") == "false_positive")))
    limits = spark.createDataFrame(Q.LIMITS, "metric string, op string, limit double")
    return Q.threshold_gate(long.drop("oracle"), limits)


@query(
    "q6_completeness",
    """SELECT o_orderkey AS page, r AS repetition FROM orders, (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS r)
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = r)""",
)
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    obs = observations(spark, sf).select("page", "repetition")
    return Q.completeness(planned_pages(spark, sf), obs, ["page"], 3)


@query(
    "q7_stop_on_failure",
    f"""WITH {BOXES}, n AS (SELECT o_orderpriority AS page_group, o_orderkey AS page, count(p.p) AS c FROM orders LEFT JOIN pred p ON p.page = o_orderkey GROUP BY ALL)
    SELECT page_group, count(*) FILTER (WHERE c <= 4) AS pages, CAST(coalesce(sum(c) FILTER (WHERE c <= 4), 0) AS BIGINT) AS predictions, count(*) FILTER (WHERE c > 4) AS failures FROM n GROUP BY page_group""",
)
def stop_on_failure(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("page_group")
    )
    pred = predictions(spark, sf)
    failed = over_limit(pred)
    counts = pred.groupBy("page").agg(F.count("*").alias("n"))
    good = groups.join(failed, "page", "left_anti").join(counts, "page", "left")
    seen = good.groupBy("page_group").agg(
        F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("predictions")
    )
    return Q.with_failures(seen, failed.join(groups, "page"), ["page_group"])


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "q8_capability_matrix",
    f"""WITH c AS (SELECT user_id, {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in _KINDS)} FROM events GROUP BY user_id),
    l AS (SELECT 'class-' || CAST(user_id % 3 AS VARCHAR) AS device_class, unnest([{', '.join(f"{{'c': '{k}', 'n': n_{k}}}" for k in _KINDS)}]) AS x FROM c),
    s AS (SELECT device_class, x.c AS capability, CASE WHEN x.n >= 14 THEN 'supported' WHEN x.n >= 12 THEN 'unknown' WHEN x.n >= 9 THEN 'unsupported' ELSE 'error' END AS status FROM l)
    SELECT device_class, capability, count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'unsupported') AS unsupported,
      count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) FILTER (WHERE status = 'error') AS error,
      bool_and(CASE WHEN capability IN ('signup', 'view') THEN status = 'supported' END) AS required_ok FROM s GROUP BY device_class, capability""",
)
def capability_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return Q.capability_matrix(evidence(spark, sf), "device_class", _KINDS, ["signup", "view"])
