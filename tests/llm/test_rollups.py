import uuid

import duckdb
import pytest
from pyspark.errors import PySparkException

from boxeval.llm.queries import ORACLES, QUERIES
from boxeval.llm.rollups import commit, compact, signed_sums, totals
from boxeval.session import checkpoint_root

SF = "/root/testdata/sf0.001"
CHANGES = "batch_id bigint, kind string, source string, language string, tokenizer string, n_tokens bigint, prev_tokens bigint, n_fixtures string"


def changes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CHANGES)


@pytest.fixture
def table(spark):
    return f"{checkpoint_root(spark)}/rollups-{uuid.uuid4().hex}"


def found(spark, table):
    return {tuple(r)[:3]: tuple(r)[3:] for r in totals(spark, table).collect()}


A, B, N = ("s", "en", "words-1"), ("s", "en", "words-2"), (None, None, None)
FIRST = [(1, "insert", *A, 10, None), (1, "insert", *A, 10, None), (1, "insert", *B, 7, None), (1, "insert", *N, None, None)]
SECOND = [(2, "revise", *A, 4, 10), (2, "delete", *B, 7, None), (2, "rename", *A, 99, None), (2, None, *A, 99, None), (2, "revise", *N, 3, None)]


def test_signed_changes_and_batches_sent_twice(spark, table):
    commit(changes(spark, FIRST), table)
    assert found(spark, table) == {A: (2, 20), B: (1, 7), N: (1, 0)}
    for _ in range(2):
        commit(changes(spark, SECOND), table)
        assert found(spark, table) == {A: (2, 14), B: (0, 0), N: (1, 3)}
    commit(changes(spark, FIRST + SECOND), table)
    commit(changes(spark, [(3, "delete", *A, 4, None)]), table)
    assert found(spark, table) == {A: (1, 10), B: (0, 0), N: (1, 3)}


def test_empty_batches(spark, table):
    commit(changes(spark, []), table)
    assert found(spark, table) == {}
    commit(changes(spark, FIRST), table)
    commit(changes(spark, []), table)
    assert found(spark, table) == {A: (2, 20), B: (1, 7), N: (1, 0)}


def test_closed_batches_stay_counted_and_count_once(spark, table):
    commit(changes(spark, FIRST), table)
    compact(spark, table)
    assert spark.read.parquet(f"{table}/_stored/1/totals").count() == 3
    assert found(spark, table) == {A: (2, 20), B: (1, 7), N: (1, 0)}
    commit(changes(spark, FIRST + SECOND), table)
    assert found(spark, table) == {A: (2, 14), B: (0, 0), N: (1, 3)}
    # one that broke off before its end does not count, though it has a ledger
    spark.range(2, 3).withColumnRenamed("id", "batch_id").write.parquet(f"{table}/_stored/2/closed")
    assert found(spark, table) == {A: (2, 14), B: (0, 0), N: (1, 3)}
    # a partition that a compaction closed but could not delete is not counted again
    first = signed_sums(changes(spark, FIRST)).drop("batch_id")
    first.select("source", "language", "tokenizer", "n_fixtures", "n_tokens").write.parquet(f"{table}/batch_id=1")
    assert found(spark, table) == {A: (2, 14), B: (0, 0), N: (1, 3)}
    compact(spark, table)
    compact(spark, table)
    assert found(spark, table) == {A: (2, 14), B: (0, 0), N: (1, 3)}
    # late batches may have any number
    commit(changes(spark, [*SECOND, (-5, "delete", *A, 4, None)]), table)
    assert found(spark, table) == {A: (1, 10), B: (0, 0), N: (1, 3)}


def test_a_change_without_a_batch_is_refused(spark, table):
    with pytest.raises(PySparkException, match="no batch_id"):
        commit(changes(spark, [(None, "insert", *A, 1, None)]), table)


def test_many_changes_are_summed_before_the_shuffle(spark):
    plan = signed_sums(changes(spark, FIRST))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2
    assert "partial_sum" in plan


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    columns = ["source", "language", "tokenizer", "n_fixtures", "n_tokens"]
    expected = con.execute(f"select {', '.join(columns)} from ({ORACLES['op10_token_rollups']})").fetchall()
    assert sorted(map(tuple, QUERIES["op10_token_rollups"](spark, SF).select(columns).collect())) == sorted(expected)
