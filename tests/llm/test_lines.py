import duckdb
from collections import Counter

import boxeval.llm.lines as L
from boxeval.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
CONTENTS = "id string, content string, row int, at int, line string, holder string"
LONG = "All rights reserved by the makers of this page."
BLANKS = " \t\n\v\f\r"


def contents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], CONTENTS)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, chars=40, fixtures=5):
    holders = {}
    for id, content in rows:
        for line in (content or "").split("\n"):
            key = lowered(line.strip(BLANKS))
            if len(key) >= chars:
                holders.setdefault(key, set()).add(id)
    repeated = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= fixtures}
    found = []
    for id, content in rows:
        lines = (content or "").split("\n")
        kept = [x for x in lines if (k := lowered(x.strip(BLANKS))) not in repeated or repeated[k] == id]
        found.append((id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(found)


def run(df, *args):
    return Counter(map(tuple, L.drop_repeated_lines(df, *args).collect()))


def check(spark, rows, *args):
    assert run(contents(spark, rows), *args) == brute(rows, *args)


def test_common_lines_stay_in_the_largest_id(spark):
    rows = [(f"page-{i}", f"own line {i}\n  {LONG if i % 2 else LONG.upper()}\t\r\nend {i}") for i in range(6)]
    check(spark, rows)
    kept = {r.id: r.content for r in L.drop_repeated_lines(contents(spark, rows)).collect()}
    assert kept["page-0"] == "own line 0\nend 0" and LONG.upper() not in kept["page-3"] and LONG in kept["page-5"]


def test_lines_below_the_limits_stay(spark):
    rows = [(f"p{i}", "\n".join(["x" * 39, LONG if i < 4 else "", "short"])) for i in range(8)]
    check(spark, rows)
    assert all(r.n_dropped == 0 for r in L.drop_repeated_lines(contents(spark, rows)).collect())


def test_lengths_are_code_points_and_only_ascii_is_lowered(spark):
    wide, upper = "漢" * 40, "É" * 40
    rows = [(f"p{i}", f"{wide}\n{upper if i % 2 else upper.lower()}\n{'漢' * 39}\n {LONG}") for i in range(8)]
    check(spark, rows)


def test_nulls_empties_and_ties(spark):
    rows = [(None, LONG), (None, f"{LONG}\n{LONG}"), (None, None), ("", LONG), ("a", LONG), ("b", f"{LONG}\n\n{LONG}\n"), ("c", LONG), ("d", ""), ("e", None)]
    check(spark, rows)
    # without an id all rows are one fixture
    check(spark, [(None, LONG)] * 9)


def test_repeated_ids_and_rows(spark):
    rows = [(f"p{i % 5}", f"{LONG}\n{i}") for i in range(10)] + [("p1", f"{LONG}\n1")] * 3
    check(spark, rows)


def test_all_lines_of_a_content_may_go(spark):
    check(spark, [(f"p{i}", f"{LONG}\n{LONG}") for i in range(7)])


def test_empty_table(spark):
    assert run(contents(spark, [])) == Counter()


def test_a_very_long_content(spark):
    lines = [f"{LONG} {i % 2000}" for i in range(60_000)]
    rows = [("z", "\n".join(lines)), *((f"p{i}", "\n".join(lines[: 1000 + i])) for i in range(5)), ("y", "x" * 3_000_000)]
    check(spark, rows)


def test_hot_and_other_lines(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_LINES", 3)
    rows = [(f"p{i:03}", "\n".join([LONG, f"{LONG} {i % 9}", f"{LONG} {i % 2}", f"{LONG} own {i}"])) for i in range(90)]
    check(spark, rows)


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cursor = con.execute(ORACLES["op12_line_dedup"])
    names = [d[0] for d in cursor.description]
    df = QUERIES["op12_line_dedup"](spark, SF).select(*names)
    rows = Counter(map(tuple, df.collect()))
    assert rows == Counter(cursor.fetchall()) and any(r[names.index("n_dropped")] for r in rows)


def test_no_python_runs_on_executors(spark):
    plan = L.drop_repeated_lines(contents(spark, [("a", LONG)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
