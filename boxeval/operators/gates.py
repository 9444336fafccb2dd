"""Pass and fail rules over observations, cases and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.functions.boards import board_violations
from boxeval.functions.numbers import reasons, strict_boolean, strict_duration

# fixed values: metric, direction, limit
LIMITS = [
    ("exact_rate", ">=", 0.95),
    ("square_rate", ">=", 0.995),
    ("p50_ms", "<=", 1000.0),
    ("p95_ms", "<=", 2000.0),
    ("false_positive", "<=", 0.0),
]
# fixed values: the reason words below, here and in the rules
MISCOUNTED, MISSING = "observation-count-or-identity-invalid", "missing"
HIGHER_IS_BETTER = ["matched", "aligned", "exact", "correct_squares", "precision", "recall", "exact_rate", "square_rate"]
LOWER_IS_BETTER = ["missed", "false_positive", "duplicate", "reliable_wrong"]


def assess_observation(raw: DataFrame, expected: str, version: str) -> DataFrame:
    """Parse one raw run per row and name what is wrong with it.

    A run without a board is safe, but not exact.  All raw fields are strings
    and may be null; a bad one becomes a reason, never an exception.
    """
    known = F.when(F.col("phase").isin("done", "no-board", "error"), F.col("phase"))
    done, none = F.coalesce(known == "done", F.lit(False)), F.coalesce(known == "no-board", F.lit(False))
    total, stage = strict_duration(F.col("total_ms")), strict_duration(F.col("stage_ms"))
    trusted, cold = strict_boolean(F.col("reliable")), strict_boolean(F.col("cold"))
    exact = done & F.coalesce(F.col("placement") == expected, F.lit(False))
    unsafe = done & F.coalesce(trusted, F.lit(False)) & ~exact
    infra = reasons(
        (known.isNull(), "phase-missing-or-invalid"),
        (F.coalesce(known == "error", F.lit(False)), "recognizer-error"),
        (done & trusted.isNull(), "reliable-missing-or-invalid"),
        (done & (F.size(board_violations(F.col("placement"))) > 0), "placement-missing-or-invalid"),
        (none & F.col("reliable").isNotNull(), "no-board-reliable-present"),
        (none & F.col("placement").isNotNull(), "no-board-placement-present"),
        (total.isNull(), "total-ms-missing-or-invalid"),
        (stage.isNull(), "stage-ms-missing-or-invalid"),
        (cold.isNull(), "cold-start-missing-or-invalid"),
        (~F.col("version").eqNullSafe(F.lit(version)), "recognizer-version-mismatch"),
    )
    return (
        raw.withColumn("exact", exact)
        .withColumn("infrastructure", infra)
        .withColumn("safety", reasons((unsafe, "reliable-wrong")))
        .withColumn("qualification", reasons((~exact, "candidate-not-exact")))
        .withColumn("phase", known)
        .withColumn("total_ms", total)
        .withColumn("stage_ms", stage)
        .withColumn("cold", cold)
    )


def _in_grid(sessions: int, runs: int) -> Column:
    return F.col("session").between(0, sessions - 1) & F.col("run").between(0, runs - 1)


def _sequence_reason(sessions: int, runs: int) -> Column:
    inside = F.coalesce(_in_grid(sessions, runs), F.lit(False))
    wrong = ~F.col("cold").eqNullSafe(F.col("run") == 0)
    return F.when(~inside, F.lit("observation-identity-invalid")).when(
        wrong, F.lit("cold-sequence-invalid")
    )


def _per_case(assessed: DataFrame, case: str, sessions: int, runs: int, cases: DataFrame | None) -> DataFrame:
    """Counts per case; declared ``cases`` without a row have zeros.

    Runs are combined per (case, session, run) before they meet their case.
    """
    odd = _sequence_reason(sessions, runs).isNotNull()
    per_run = assessed.groupBy(case, "session", "run").agg(
        F.count("*").alias("n"),
        F.sum(F.size("infrastructure") + odd.cast("int")).alias("infra"),
        F.sum(F.size("safety")).alias("safe"),
        F.sum(F.size("qualification")).alias("qual"),
    )
    names = ["observations", "identities", "inside", "infra", "safety_failures", "qual"]
    counted = per_run.groupBy(case).agg(
        F.sum("n").alias("observations"),
        F.count("*").alias("identities"),
        F.count_if(_in_grid(sessions, runs)).alias("inside"),
        F.sum("infra").alias("infra"),
        F.sum("safe").alias("safety_failures"),
        F.sum("qual").alias("qual"),
    )
    if cases is not None:
        counted = cases.select(case).distinct().join(counted, case, "full")
        counted = counted.withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in names})
    wrong = (F.col("observations") != sessions * runs) | (F.col("identities") != F.col("observations"))
    return counted.withColumn("miscounted", wrong)


def assess_case(assessed: DataFrame, case: str, cases: DataFrame | None = None, sessions: int = 3, runs: int = 2) -> DataFrame:
    """Three verdicts per case; the last one also counts the failures of the others.

    ``cases`` declares what should have been run, also cases without any row.
    """
    per_case = _per_case(assessed, case, sessions, runs, cases)
    infra = F.col("infra") + F.col("miscounted").cast("bigint") + sessions * runs - F.col("inside")

    def verdict(count: str) -> Column:
        return F.when(F.col(count) == 0, F.lit("PASS")).otherwise(F.lit("FAIL"))

    counted = per_case.withColumn("infrastructure_failures", infra).withColumn(
        "qualification_failures", F.col("qual") + F.col("safety_failures") + F.col("infrastructure_failures")
    )
    kinds = ("infrastructure", "safety", "qualification")
    return counted.select(
        case,
        *(f"{k}_failures" for k in kinds),
        *(verdict(f"{k}_failures").alias(f"{k}_status") for k in kinds),
    )


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def case_failures(assessed: DataFrame, case: str, cases: DataFrame | None = None, sessions: int = 3, runs: int = 2) -> DataFrame:
    """Each failure of a case once with its count: what runs show, runs that are missing, and wrong numbers of runs."""

    def listed(kind: str, reasons_: Column) -> Column:
        return F.transform(reasons_, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("reason")))

    tagged = F.concat(
        *(listed(kind, F.col(kind)) for kind in ("infrastructure", "safety", "qualification")),
        listed("infrastructure", F.array_compact(F.array(_sequence_reason(sessions, runs)))),
    )
    label = F.format_string("session-%d-run-%d:%s", "session", "run", "reason")
    shown = assessed.select(case, "session", "run", F.explode(tagged).alias("f")).select(case, "session", "run", "f.kind", "f.reason")

    per_case = _per_case(assessed, case, sessions, runs, cases)
    grid = per_case.select(case, F.explode(_numbers(sessions)).alias("session")).withColumn("run", F.explode(_numbers(runs)))
    there = assessed.select(case, F.col("session").cast("bigint").alias("session"), F.col("run").cast("bigint").alias("run"))
    absent = grid.join(there.distinct(), [case, "session", "run"], "left_anti")
    absent = absent.select(case, "session", "run", F.lit("infrastructure").alias("kind"), F.lit(MISSING).alias("reason"))

    rows = shown.unionByName(absent).groupBy(case, "kind", label.alias("failure")).agg(F.count("*").alias("n"))
    wrong = per_case.where("miscounted").select(
        case, F.lit("infrastructure").alias("kind"), F.lit(MISCOUNTED).alias("failure"), F.lit(1).cast("bigint").alias("n")
    )
    return rows.unionByName(wrong)


def threshold_gate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Long metrics against limits with a direction; a missing value fails."""
    joined = metrics.join(F.broadcast(limits), "metric")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("limit")).otherwise(
        F.col("value") <= F.col("limit")
    )
    passed = F.coalesce(ok, F.lit(False))
    return joined.withColumn("status", F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")))


def regression_gate(deltas: DataFrame) -> DataFrame:
    """Metrics that got worse than the baseline."""
    worse = (F.col("metric").isin(HIGHER_IS_BETTER) & (F.col("delta") < 0)) | (
        F.col("metric").isin(LOWER_IS_BETTER) & (F.col("delta") > 0)
    )
    return deltas.where(worse)


def completeness(planned: DataFrame, obs: DataFrame, keys: list[str], repetitions: int) -> DataFrame:
    """Planned (input, repetition) pairs that no observation covers."""
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(repetitions).cast("bigint"))
    wanted = planned.select(*keys).distinct().withColumn("repetition", F.explode(numbers))
    return wanted.join(obs, [*keys, "repetition"], "left_anti")


def with_failures(summary: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """Groups report what was seen; failures are counted beside it, never raised."""
    counted = failures.groupBy(*keys).agg(F.count("*").alias("failures"))
    joined = summary.join(counted, keys, "full")
    return joined.withColumn("failures", F.coalesce("failures", F.lit(0).cast("bigint")))


def capability_matrix(evidence: DataFrame, group: str, capabilities: list[str], required: list[str]) -> DataFrame:
    """Status counts per group and capability, and whether a required one holds."""
    statuses = ["supported", "unsupported", "unknown", "error"]
    long = evidence.unpivot([group], capabilities, "capability", "status")
    counted = long.groupBy(group, "capability").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in statuses)
    )
    holds = F.col("unsupported") + F.col("unknown") + F.col("error") == 0
    return counted.withColumn("required_ok", F.when(F.col("capability").isin(required), holds))
