from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boxeval.operators import contracts as V
from boxeval.operators import gates as Q
from boxeval.operators import integrity as H
from boxeval.operators import metrics as M
from boxeval.operators import policy as L
from boxeval.plans import inputs as P
from boxeval.sources import readers as S

FIXTURES = Path(__file__).parent / "fixtures"


def test_violations_are_listed_and_fail_fast_raises(spark):
    df = spark.createDataFrame([(1, "ok", 3), (2, None, 9), (3, "", 3)], "id int, name string, n int")
    rules = [V.Rule("name", "must be non-empty", F.length("name") > 0), V.Rule("n", "must be small", F.col("n") < 5)]
    found = {(r.row_id, r.path) for r in V.check_fields(df, "thing", F.col("id"), rules).collect()}
    assert found == {("2", "name"), ("2", "n"), ("3", "name")}
    with pytest.raises(Exception, match="thing 2 name"):
        V.check_fields(df.where("id = 2"), "thing", F.col("id"), rules, fail_fast=True).collect()
    good, bad = V.quarantine(df, rules)
    assert good.count() == 1 and {tuple(r.reasons) for r in bad.collect()} == {("must be non-empty", "must be small"), ("must be non-empty",)}


def test_keys_and_regions(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "x": 2}')], "id int, j string")
    found = {(r.path, r.message) for r in V.check_keys(df, "m", F.col("id"), F.col("j"), ["a", "b"]).collect()}
    assert found == {("x", "unexpected property"), ("b", "missing property")}
    region = spark.createDataFrame([(8, 8, [1.0] * 64), (4, 8, [256.0] * 32)], "w int, h int, d array<double>")
    rules = V.region_rules(F.col("w"), F.col("h"), F.col("d"), 1)
    assert sorted(r.path for r in V.check_fields(region, "r", F.col("w"), rules).collect()) == ["data", "width"]


def test_fingerprint_depends_on_content_not_on_partitions(spark):
    rows = [(g, i * 1500, f"h{i}") for g in "ab" for i in range(20)]
    df = spark.createDataFrame(rows, "g string, id bigint, sha256 string")

    def prints(frame):
        return {r.g: (r.fingerprint, r.n) for r in H.set_fingerprint(frame, "g", "id").collect()}

    first = prints(df)
    assert first == prints(df.repartition(7).orderBy(F.desc("id"))) and first["a"] == first["b"]
    changed = prints(df.withColumn("sha256", F.when(F.col("id") == 1500, F.lit("z")).otherwise(F.col("sha256"))))
    assert changed["a"] != first["a"]


@pytest.mark.parametrize(
    "text, kind, parts, mixed, allowed",
    [
        ("MIT", "plain", ["MIT"], False, True),
        ("(MIT OR GPL-3.0)", "or", ["MIT", "GPL-3.0"], False, True),
        ("GPL-3.0 OR AGPL-3.0", "or", ["GPL-3.0", "AGPL-3.0"], False, False),
        ("(MIT AND GPL-3.0)", "and", ["MIT", "GPL-3.0"], False, False),
        (" (MIT AND ISC) ", "and", ["MIT", "ISC"], False, True),
        ("MIT AND ISC OR X", "or", ["MIT AND ISC", "X"], True, False),
        ("(", "plain", ["("], False, False),
        ("()", "plain", [""], False, False),
    ],
)
def test_licence_expressions(spark, text, kind, parts, mixed, allowed):
    parsed = L.parse_expression(F.lit(text))
    row = spark.range(1).select(parsed.alias("e"), L.is_allowed(parsed, ["MIT", "ISC"]).alias("ok")).first()
    assert (row.e.kind, row.e.parts, row.e.mixed, row.ok) == (kind, parts, mixed, allowed)


def test_inventory_and_exceptions(spark):
    rows, broken = S.read_inventory(spark, str(FIXTURES / "inventory*.json"))
    assert rows.count() == 5 and [Path(r.file).name for r in broken.collect()] == ["inventory-broken.json"]
    exceptions = spark.createDataFrame([("delta", "AGPL-3.0"), ("eps", "MIT")], "name string, licence string")
    assert [r.name for r in L.find_violations(rows, ["MIT"], exceptions).collect()] == ["eps"]
    counts = {r.licence: r.packages for r in L.inventory_count(rows).collect()}
    assert counts == {"MIT": 2, "(GPL-3.0 OR MIT)": 1, "AGPL-3.0": 2, None: 5}


def test_catalogue_becomes_tables_and_a_plan(spark):
    c = S.read_catalogue(spark, str(FIXTURES / "catalogue.json"))
    assert c["problems"].count() == 0
    assert c["pages"].count() == 2 and c["page_tags"].count() == 3
    truth = {r.annotation_id: r for r in c["truth"].collect()}
    assert truth["left"].rendered == "8/8/8/8/8/8/8/8" and truth["cut"].rendered is None
    pages = c["pages"].select("page", F.col("width").cast("double").alias("page_width"), F.col("height").cast("double").alias("page_height"))
    boxes = c["truth"].select(
        "page", F.col("annotation_id").alias("a"), "kind", P.style_key(F.col("square_style")).alias("style"),
        *(F.col(k).cast("double").alias(k) for k in ("x", "y", "width", "height")),
    )
    plan = P.plan_inputs(pages, boxes)
    got = {r.input_id: (r.style, r.oracle, r.crop_x, r.crop_width) for r in plan.collect()}
    assert got == {
        "classifier:two-boards:left": ("flat-gray-0.5", True, 8.0, 320.0),
        "manual:two-boards:left": ("flat-gray-0.5", False, 0.0, 354.0),
        "manual:two-boards:cut": ("hatch-45-dense", False, 694.0, 74.0),
        "full-page:two-boards": ("mixed:flat-gray-0.5+hatch-45-dense", False, 0.0, 768.0),
        "full-page:text-only": ("negative", False, 0.0, 768.0),
    }
    seen = {(r.input_id, r.truth_a, r.x0) for r in P.plan_truth(plan, boxes).collect()}
    assert seen == {("classifier:two-boards:left", "left", 0.0), ("manual:two-boards:left", "left", 8.0), ("full-page:two-boards", "left", 8.0)}


def test_index_keeps_open_objects(spark):
    index, problems = S.read_fixture_index(spark, str(FIXTURES / "index.json"))
    assert problems.count() == 0
    pages = {r.id: r.n for r in index.select("id", F.variant_get("expected", "$.pages", "int").alias("n")).collect()}
    assert pages == {"one-page": 1, "scan": None}
    found, unknown = S.lookup_fixture(index, spark.createDataFrame([("scan",), ("nope",)], "id string"))
    assert [r.id for r in found.collect()] == ["scan"] and [r.id for r in unknown.collect()] == ["nope"]
    source = F.col("source.generator").isNull() != F.col("source.url").isNull()
    assert V.check_fields(index, "fixture", F.col("id"), [V.Rule("source", "one of", source)]).count() == 0


def test_evidence_matrix(spark):
    record, problems = S.read_evidence(spark, str(FIXTURES / "evidence.json"))
    assert {r.problem for r in problems.collect()} == {"commit:must be a hash", "deviceClass:must be known", "capabilities:must be the declared ones"}
    wide = record.select("deviceClass", *(F.col("capabilities")[c].alias(c) for c in ("wasm", "share")))
    got = {r.capability: r.required_ok for r in Q.capability_matrix(wide, "deviceClass", ["wasm", "share"], ["wasm"]).collect()}
    assert got == {"wasm": True, "share": None}


def test_contents_reports_and_sniffing(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    files = S.read_contents(spark, str(tmp_path), "*.pdf")
    code = S.sniff_contents(F.col("content"), F.col("length"), b"%PDF-", "pdf")
    assert sorted((r.length, r.c) for r in files.select("length", code.alias("c")).collect()) == [(5, "not-a-pdf"), (10, None)]
    small = S.sniff_contents(F.col("content"), F.col("length"), b"%PDF-", "pdf", limit=4)
    assert {r.c for r in files.select(small.alias("c")).collect()} == {"too-large"}
    report = tmp_path / "report.json"
    report.write_text('{"suite": "s", "engine": "e",\n "runs": [{"run": 0, "phase": "done", "totalMs": 3.5}]}')
    assert [(r.engine, r.totalMs, Path(r.file).name) for r in S.read_reports(spark, str(report))[0].collect()] == [("e", 3.5, "report.json")]


def test_broken_and_unknown_documents_stay_visible(spark, tmp_path):
    import json

    def problems(df):
        return {(Path(r.file).name, r.problem) for r in df.collect()}

    (tmp_path / "torn.json").write_text('{"schemaVersion": 1, "fixtures": [')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "extra.json").write_text('{"schemaVersion": 1, "fixtures": [{"id": "a", "colour": "red"}, {"id": "b"}], "more": 0}')
    entries, found = S.read_fixture_index(spark, str(tmp_path))
    assert {r.id for r in entries.collect()} == {"a", "b"}
    assert problems(found) == {
        ("torn.json", "not-an-object"), ("list.json", "not-an-object"),
        ("extra.json", "unknown-key:$.more"), ("extra.json", "unknown-key:$.fixtures.colour"),
    }
    catalogue = json.loads((FIXTURES / "catalogue.json").read_text())
    catalogue["contactSheet"] = {"path": "x"}
    catalogue["pages"][0]["annotations"][0]["mood"] = "good"
    catalogue["pages"][1]["annotations"] = []
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.json").write_text(json.dumps(catalogue))
    read = S.read_catalogue(spark, str(tmp_path / "deep"))
    assert problems(read["problems"]) == {("c.json", "unknown-key:$.pages.annotations.mood")}
    assert read["corpus"].select(F.variant_get("contactSheet", "$.path", "string")).first()[0] == "x"
    runs, broken = S.read_reports(spark, str(tmp_path))
    assert runs.count() == 0
    assert {Path(r.file).name for r in broken.collect()} == {"torn.json", "list.json", "extra.json"}


def raw(**changes):
    base = {
        "session": 0, "run": 0, "phase": "done", "placement": "8/8/8/8/8/8/8/8", "reliable": "true",
        "total_ms": "5", "stage_ms": "2", "cold": "true", "version": "v1",
    }
    return base | changes


RAW = "case string, session bigint, run bigint, phase string, placement string, reliable string, total_ms string, stage_ms string, cold string, version string"


@pytest.mark.parametrize(
    "changes, infra, safety, qual",
    [
        ({}, [], [], []),
        ({"placement": "7k/8/8/8/8/8/8/8"}, [], ["reliable-wrong"], ["candidate-not-exact"]),
        ({"phase": "no-board", "placement": None, "reliable": None}, [], [], ["candidate-not-exact"]),
        ({"phase": "no-board"}, ["no-board-reliable-present", "no-board-placement-present"], [], ["candidate-not-exact"]),
        ({"phase": None}, ["phase-missing-or-invalid"], [], ["candidate-not-exact"]),
        ({"phase": "error"}, ["recognizer-error"], [], ["candidate-not-exact"]),
        ({"reliable": "yes", "total_ms": "NaN", "stage_ms": " ", "cold": None, "version": None},
         ["reliable-missing-or-invalid", "total-ms-missing-or-invalid", "stage-ms-missing-or-invalid", "cold-start-missing-or-invalid", "recognizer-version-mismatch"], [], []),
    ],
)
def test_observation_reasons(spark, changes, infra, safety, qual):
    df = spark.createDataFrame([{"case": "c", **raw(**changes)}], RAW)
    r = Q.assess_observation(df, "8/8/8/8/8/8/8/8", "v1").first()
    assert (r.infrastructure, r.safety, r.qualification) == (infra, safety, qual)


def test_case_verdicts(spark):
    full = [raw(session=s, run=r, cold="true" if r == 0 else "false") for s in range(3) for r in range(2)]
    cases = {
        "good": full,
        "missing": full[:-1],
        "twice": [*full[:-1], full[0]],
        "late-cold": [*full[:-1], {**full[-1], "cold": "true"}],
        "outside": [*full[:-1], {**full[-1], "session": 7}],
    }
    df = spark.createDataFrame([{"case": c, **row} for c, rows in cases.items() for row in rows], RAW)
    done = Q.assess_observation(df, "8/8/8/8/8/8/8/8", "v1")
    got = {r.case: (r.infrastructure_failures, r.safety_status, r.qualification_status) for r in Q.assess_case(done, "case").collect()}
    assert got == {
        "good": (0, "PASS", "PASS"), "missing": (2, "PASS", "FAIL"), "twice": (2, "PASS", "FAIL"),
        "late-cold": (1, "PASS", "FAIL"), "outside": (2, "PASS", "FAIL"),
    }
    named = {r.failure for r in Q.case_failures(done, "case").where("case = 'late-cold'").collect()}
    assert named == {"session-2-run-1:cold-sequence-invalid"}
    declared = spark.createDataFrame([("never",), ("good",)], "case string")
    counts = {r.case: r.infrastructure_failures for r in Q.assess_case(done, "case", declared).collect()}
    assert counts["never"] == 7 and counts["good"] == 0
    listed = {}
    for r in Q.case_failures(done, "case", declared).collect():
        listed.setdefault(r.case, {})[r.failure] = r.n
    assert "good" not in listed
    count, missing = "observation-count-or-identity-invalid", "session-2-run-1:missing"
    assert listed["missing"] == {count: 1, missing: 1}
    assert listed["outside"] == {"session-7-run-1:observation-identity-invalid": 1, missing: 1}
    assert listed["never"] == {count: 1, **{f"session-{s}-run-{r}:missing": 1 for s in range(3) for r in range(2)}}


def test_only_a_wrong_reliable_reading_rises(spark):
    same = {m: 1.0 for m in M.COMPARED}
    rows = [("control", "s", *same.values()), ("candidate", "s", *(same | {"reliable_wrong": 2.0}).values())]
    df = spark.createDataFrame(rows, "side string, stage string, " + ", ".join(f"{m} double" for m in same))
    base, cand = (df.where(F.col("side") == side).drop("side") for side in ("control", "candidate"))
    deltas = M.delta(M.compare(base, cand, ["stage"], M.COMPARED), ["stage"], M.COMPARED)
    assert [(r.metric, r.delta) for r in Q.regression_gate(deltas).collect()] == [("reliable_wrong", 1.0)]


def test_mixed_groups_have_no_detection_sums(spark):
    counts = {c: 1 for c in M.COUNTS}
    found = dict.fromkeys(M.DETECTION, 1)
    rows = [("det", False, *counts.values(), *found.values()), ("mix", False, *counts.values(), *found.values()), ("mix", True, *counts.values(), *[None] * 5)]
    df = spark.createDataFrame(rows, "g string, oracle boolean, " + ", ".join(f"{c} bigint" for c in (*counts, *found)))
    got = {r.g: r for r in M.summarise(df, ["g"]).collect()}
    assert (got["det"].mixed, got["det"].precision, got["det"].matched) == (False, 1.0, 1)
    assert (got["mix"].mixed, got["mix"].precision, got["mix"].matched) == (True, None, None)
    assert got["mix"].exact_rate == 1.0


def test_comparison_deltas_and_gates(spark):
    base = spark.createDataFrame([("a", 5, None), ("b", 1, 0.5)], "g string, matched bigint, recall double")
    cand = spark.createDataFrame([("a", 4, 0.1), ("c", 1, 0.5)], "g string, matched bigint, recall double")
    both = M.compare(base, cand, ["g"], ["matched", "recall"])
    assert {r.g: r.side for r in both.collect()} == {"a": "both", "b": "base-only", "c": "candidate-only"}
    deltas = M.delta(both, ["g"], ["matched", "recall"])
    assert {(r.g, r.metric): r.delta for r in deltas.collect() if r.delta is not None} == {("a", "matched"): -1.0}
    assert [(r.g, r.metric) for r in Q.regression_gate(deltas).collect()] == [("a", "matched")]
    metrics = spark.createDataFrame([("exact_rate", 0.96), ("p95_ms", 2500.0), ("false_positive", None)], "metric string, value double")
    limits = spark.createDataFrame(Q.LIMITS, "metric string, op string, limit double")
    got = {r.metric: r.status for r in Q.threshold_gate(metrics, limits).collect()}
    assert got == {"exact_rate": "PASS", "p95_ms": "FAIL", "false_positive": "FAIL"}


def test_inputs_that_cannot_be_measured(spark):
    inputs = spark.createDataFrame(
        [("fine", 10.0, 10.0, True), ("flat", 0.0, 10.0, False), ("odd", float("nan"), 1.0, False), ("twice", 9.0, 9.0, False), ("bare", 9.0, 9.0, True)],
        "page string, width double, height double, oracle boolean",
    )
    truth = spark.createDataFrame([("fine", "x"), ("twice", "x"), ("twice", "x"), ("twice", "y")], "page string, a string")
    pred = spark.createDataFrame([("fine", "p"), ("twice", "p"), ("bare", "p")], "page string, p string")
    got = {(r.page, r.reason) for r in V.input_problems(inputs, truth, pred).collect()}
    assert got == {("flat", "page-size"), ("odd", "page-size"), ("twice", "duplicate-annotation"), ("bare", "oracle-not-one-to-one")}
