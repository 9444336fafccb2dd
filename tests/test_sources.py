"""Documents in lines, open objects, damaged members, pruned files and the SQL table function."""

import json
import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boxeval.functions.register import register_distribution, register_operators
from boxeval.operators import integrity as H
from boxeval.operators.distribution import distribution
from boxeval.sources import readers as S

FIXTURES = Path(__file__).parent / "fixtures"


def lines(path, *documents):
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in documents) + "\n\n")
    return str(path)


def test_a_catalogue_in_lines_is_the_catalogue(spark, tmp_path):
    whole = json.loads((FIXTURES / "catalogue.json").read_text())
    parts = [whole | {"pages": [page]} for page in whole["pages"]]
    given = S.read_catalogue(spark, str(FIXTURES / "catalogue.json"))
    read = S.read_catalogue(spark, lines(tmp_path / "c.jsonl", *parts), lines=True)
    for name in ("pages", "truth", "page_tags", "problems"):
        assert sorted(map(str, read[name].collect())) == sorted(map(str, given[name].collect()))


def test_torn_lines_and_unknown_keys_of_lines(spark, tmp_path):
    path = lines(tmp_path / "c.jsonl", {"corpusId": "a", "pages": [{"id": "p"}]}, '{"corpusId": ', {"corpusId": "b", "pages": [], "more": 1}, {"corpusId": "c", "pages": [{"id": "q", "mood": 1}]})
    read = S.read_catalogue(spark, path, lines=True)
    assert {r.page for r in read["pages"].collect()} == {"p", "q"}
    assert sorted(r.problem for r in read["problems"].collect()) == ["not-an-object", "unknown-key:$.more", "unknown-key:$.pages.mood"]


def test_written_catalogues_have_small_documents(spark, tmp_path):
    pages = spark.range(1000).select(
        F.when(F.col("id") < 900, F.lit("large")).otherwise(F.lit("small")).alias("corpus"), F.concat(F.lit("page-"), F.col("id").cast("string")).alias("id"),
        F.array(F.struct(F.lit("a").alias("id"))).alias("annotations"),
    )
    S.write_catalogue(pages, str(tmp_path / "c"), "corpus", {"pageWidth": F.lit(5)}, in_one=10)
    documents = [json.loads(line) for f in (tmp_path / "c").glob("part-*") for line in f.read_text().splitlines()]
    assert len(documents) >= 100 and max(len(d["pages"]) for d in documents) < 40
    read = S.read_catalogue(spark, str(tmp_path / "c"), lines=True)
    assert read["problems"].count() == 0 and read["truth"].count() == 1000
    assert {r.corpus_id: r["count"] for r in read["pages"].groupBy("corpus_id").count().collect()} == {"large": 900, "small": 100}
    # no pages, no documents
    S.write_catalogue(pages.where("false"), str(tmp_path / "none"), "corpus")
    assert S.read_catalogue(spark, str(tmp_path / "none"), lines=True)["pages"].count() == 0


def test_expected_values_at_paths_from_rows(spark, tmp_path):
    expected = {"a": {"n": 3, "deep": {"x": [1, 2]}}, "b": {"n": "three"}, "c": [1], "d": None, "e": {}}
    index = {"schemaVersion": 1, "fixtures": [{"id": k, "expected": v} for k, v in expected.items()] + [{"id": "f"}]}
    entries, problems = S.read_fixture_index(spark, lines(tmp_path / "i.jsonl", index), lines=True)
    assert problems.count() == 0
    path = F.when(F.col("id") == "c", F.lit("$[0]")).when(F.col("id") != "e", F.lit("$.n"))
    got = {r.id: r.v for r in entries.select("id", S.wanted_values(entries, path, "int").alias("v")).collect()}
    assert got == {"a": 3, "b": None, "c": 1, "d": None, "e": None, "f": None}
    fields = {(r.id, r.field): r.v for r in S.expected_fields(entries).select("id", "field", F.to_json("value").alias("v")).collect()}
    assert fields == {("a", "n"): "3", ("a", "deep"): '{"x":[1,2]}', ("b", "n"): '"three"'}


def test_damaged_members_of_an_inventory_take_nothing_with_them(spark, tmp_path):
    good = {"name": "alpha", "versions": ["1", "2"]}
    path = lines(
        tmp_path / "i.jsonl",
        {"MIT": [good, {"name": "beta"}, {"versions": ["1"]}, {"name": 3, "versions": []}, "text", {"name": "gamma", "versions": ["1", 2]}], "ISC": {"name": "x"}, "X": None, "Y": []},
        "[1]", '{"MIT": [', {"0BSD": [{"name": "delta", "versions": []}]},
    )
    packages, bad = S.read_inventory_members(spark, path)
    assert {(r.licence, r.name, tuple(r.versions)) for r in packages.collect()} == {("MIT", "alpha", ("1", "2")), ("0BSD", "delta", ())}
    found = sorted((r.licence or "", r.problem) for r in bad.collect())
    assert found == sorted(
        [("MIT", "no-versions"), ("MIT", "no-name"), ("MIT", "no-name"), ("MIT", "no-name"), ("MIT", "no-versions"),
         ("ISC", "not-a-list"), ("X", "not-a-list"), ("", "not-a-map"), ("", "not-a-map")]
    )
    assert {Path(r.file).name for r in bad.collect()} == {"i.jsonl"}


def test_contents_by_name_and_time(spark, tmp_path):
    for name, year in (("old.bin", 2001), ("new.bin", 2020), ("new.txt", 2020)):
        (tmp_path / name).write_bytes(name.encode())
        at = datetime(year, 6, 1).timestamp()
        os.utime(tmp_path / name, (at, at))

    def names(**times):
        return {Path(r.path).name for r in S.read_contents(spark, str(tmp_path), "*.bin", **times).collect()}

    assert names() == {"old.bin", "new.bin"}
    assert names(after="2010-01-01T00:00:00") == {"new.bin"} and names(before="2010-01-01T00:00:00") == {"old.bin"}
    assert names(after="2030-01-01T00:00:00") == set()


def test_contents_lie_in_few_folders_and_are_read_by_few_tasks(spark, tmp_path):
    rows = [(i, f"page {i}") for i in range(300)] + [(None, "a"), (None, None), (7, "page 7"), (-1, None)]
    pages = spark.createDataFrame(rows, "page bigint, html string").repartition(5)
    tasks = S.shelves(pages)
    S.write_contents(pages, str(tmp_path / "c"), "page", "html", tasks)
    folders = list((tmp_path / "c").iterdir())
    assert tasks == 3 and len(folders) <= 3 and all(f.is_file() for folder in folders for f in folder.iterdir())
    read = S.read_contents(spark, str(tmp_path / "c"), "*.txt", tasks=tasks)
    assert read.rdd.getNumPartitions() <= 3 < S.read_contents(spark, str(tmp_path / "c"), "*.txt").rdd.getNumPartitions()
    found = {Path(r.path).stem: (bytes(r.content), r.length) for r in read.collect()}
    want = {str(i): f"page {i}\n".encode() for i in range(300)} | {"7": b"page 7\n" * 2, "-1": b"\n"}
    none, length = found.pop("None")
    assert sorted(none.splitlines()) == [b"", b"a"] and length == 3
    assert found == {k: (v, len(v)) for k, v in want.items()}


def test_contents_of_no_pages_and_of_odd_ones(spark, tmp_path):
    from boxeval.queries import QUERIES

    spark.createDataFrame([(1, "item")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    missing = (1_000_000_001, None, "missing")
    rows = [(1, "u", "one"), (7, "u", "seven"), (10, "u", "ten"), (None, "u", "none"), (3, "u", None)]
    for kept, want in ((rows, [(1, 4, "ok"), (7, 6, "untracked"), (10, 4, "mismatch"), (None, None, "untracked"), (3, 1, "untracked"), missing]), ([], [missing])):
        spark.createDataFrame(kept, "page_id bigint, url string, html string").write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
        assert sorted(map(str, map(tuple, QUERIES["s6_read_contents"](spark, str(tmp_path)).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("least", [0, 2])
def test_distribution_in_sql(spark, least):
    rows = [("a", float(i % 7)) for i in range(40)] + [("b", None), ("c", 1.0), ("c", None), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, `a value` double")
    df.createOrReplaceTempView("some_values")
    register_distribution(spark, "some_values", ["g"], "a value")
    want = {tuple(r) for r in distribution(df, ["g"], "a value").collect() if r["count"] >= least}
    assert {tuple(r) for r in spark.sql(f"SELECT * FROM distribution({least})").collect()} == want


def test_strict_cells_in_sql(spark):
    assert "board_cells_strict" in register_operators(spark)
    cases = ["8/8/8/8/8/8/8/8", "k7/8/8/8/8/8/8/8", "44/8/8/8/8/8/8/8", "9/8/8/8/8/8/8/8", "7/8/8/8/8/8/8/8", "8/8", "", "x7/8/8/8/8/8/8/8", "8//8/8/8/8/8/8"]
    got = [spark.sql("SELECT board_cells_strict(:p)", {"p": p}).first()[0] for p in cases]
    assert got == ["." * 64, "k" + "." * 63] + [None] * 7


def test_fingerprints_of_text_ids_follow_the_list_only(spark):
    def prints(rows, leaf):
        df = spark.createDataFrame(rows, "g string, page string, sha256 string")
        return {r.g: (r.fingerprint, r.n) for r in H.set_fingerprint(df, "g", "page", leaf).collect()}

    own = [(f"page-{i}", f"h{i}") for i in range(300)]
    rows = [("a", *r) for r in own] + [("b", *r) for r in reversed(own)] + [("c", *own[0]), (None, *own[1])]
    for leaf in (1, 4, 4096):
        found = prints(rows, leaf)
        assert found["a"] == found["b"] and found["a"][1] == 300 and found["c"][1] == found[None][1] == 1
        changed = prints([("a", *r) for r in own[:-1]] + [("a", "page-299", "other")], leaf)
        assert changed["a"][0] != found["a"][0]
    # nulls, empties, repeated ids and separators are told apart
    odd = [[("x", None, "h")], [("x", "", "h")], [("x", "p", None)], [("x", "p", "h")], [("x", "p", "h")] * 2, [("x", "p\n", "h")], [("x", "p", "-")]]
    digests = [prints(rows, 4096)["x"] for rows in odd]
    assert len({d[0] for d in digests}) == len(odd) - 1 and digests[2][0] == digests[6][0]
    assert prints([], 4) == {}


def test_fixture_lists_are_made_after_the_events_are_dealt_out(spark, tmp_path):
    from boxeval.queries.sources import _index

    rows = [(i, "click", float(i), '{"k": 1}') for i in range(130)]
    spark.createDataFrame(rows, "event_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    index = _index(spark, str(tmp_path))
    plan = index._jdf.queryExecution().executedPlan().toString()
    # seen from the result: both aggregations come before the only shuffle
    assert plan.count("Exchange") == 1 and plan.rindex("ObjectHashAggregate") < plan.index("Exchange")
    assert sorted(len(r.fixtures) for r in index.collect()) == [2, 64, 64]
