"""Quality and toxicity: held-out accuracy, and rows that are out of the ordinary."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxeval.llm.common import held_out, training_sample
from boxeval.llm.quality import STATISTICS, fit_quality, score_quality, statistics
from boxeval.llm.queries import QUERIES
from boxeval.llm.toxicity import SentenceModel, fit_toxicity, learn, score_toxicity

SF = "/root/testdata/sf0.01"
ODD = "id bigint, content string, score string, verdict string, passages int"


@pytest.mark.parametrize(("name", "label", "least"), [("op8_quality", "quality", 0.98), ("op1_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean(right) >= least


def odd(spark):
    texts = [None, "", "Same.", "Same.", "word " * 60_000, "\x00퟿!!! ???", "x" * 100_000]
    return spark.createDataFrame([(i if i != 3 else 2, t, "s", "v", 0) for i, t in enumerate(texts)] + [(None, "no id", "s", "v", 0)], ODD)


def verdicts(spark, rows):
    return spark.createDataFrame(rows, "id bigint, verdict int")


@pytest.mark.parametrize("rows", [[], [(2, 1)], [(2, 0)], [(0, 0), (1, 1), (2, 1), (2, 0), (4, 1), (5, 0), (None, 1), (6, None), (77, 1)]])
def test_odd_rows_have_a_score(spark, rows):
    df = odd(spark)
    for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        found = score(df, fit(df, verdicts(spark, rows))).collect()
        assert len(found) == 8
        assert all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.id == 2}) == 1
        by_id = {r.id: r.score for r in found}
        assert by_id[0] == by_id[1]  # null counts as empty
        assert score(df.limit(0), fit(df, verdicts(spark, rows))).collect() == []


def test_no_verdicts_say_nothing(spark):
    df = odd(spark)
    assert {r.score for r in score_quality(df, fit_quality(df, verdicts(spark, []))).collect()} == {0.5}


def test_sample_is_bounded_and_takes_the_larger_verdict(spark):
    contents = spark.range(2000).selectExpr("id", "'t' as content")
    known = spark.range(2000).selectExpr("id", "cast(id % 2 as int) as verdict")
    rows = training_sample(contents, known.unionByName(known.selectExpr("id", "0 as verdict")), 500).collect()
    assert 400 < len(rows) < 600
    assert all(r.verdict == r.id % 2 for r in rows)
    assert training_sample(contents, known, 5000).count() == 2000


def test_held_out_without_an_id(spark):
    rows = spark.createDataFrame([(None,), (0,)], "id bigint").select(held_out(F.col("id"))).collect()
    assert [r[0] for r in rows] == [False, zlib.crc32(b"0") % 5 == 0]


def test_statistics_are_finite():
    for text in ("", " ", "\n\n", "a", "ß" * 10, "İ" * 5, "!" * 1000, "1 " * 1000):
        row = statistics(text)
        assert len(row) == len(STATISTICS)
        assert np.isfinite(row).all()


def test_the_offending_sentence_is_found():
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in "abcdefghijklmnop"]
    texts, toxic = [], []
    for n in range(400):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(5)]
        if n % 4 == 0:
            sentences[n % 5] += " vile"
        texts.append(". ".join(sentences) + ".")
        toxic.append(int(n % 4 == 0))
    model = learn(texts, np.array(toxic))
    text = "wa wb wc. You vile wd. We wf."
    score, spans = model.judge(text)
    assert score > 0.5
    assert [text[s["start"] : s["end"]].strip() for s in spans] == ["You vile wd."]
    assert model.judge("wa wb wc. You wd.")[0] < 0.5


def test_noisy_or_of_sentences():
    model = SentenceModel({"bad": 3.0}, -4.0)
    p, q = 1 / (1 + np.exp(1)), 1 / (1 + np.exp(4))
    assert model.judge("Bad one. Fine. Bad two.")[0] == pytest.approx(1 - (1 - p) ** 2 * (1 - q))
    assert model.judge("")[0] == pytest.approx(q)


def test_the_sample_is_bounded_whatever_repeats(spark):
    from boxeval.llm.toxicity import bounded_sample

    one = spark.range(50_000).select(F.lit(7).cast("bigint").alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"))
    judged = spark.createDataFrame([(7, 1), (7, 0), (8, 0)], "id bigint, verdict int")
    rows = bounded_sample(training_sample(one, judged, 10), 1_000).collect()
    assert [(r.id, r.verdict) for r in rows] == [(7, 1)]
    # long contents: as many as there is room for, whole, and the same ones on each run
    long = spark.range(100).select("id", F.when(F.col("id") > 0, F.repeat(F.lit("word "), 2_000)).alias("content"), F.lit(0).alias("verdict"))
    kept = bounded_sample(long, 95_000).collect()
    assert sum(len(r.content or "") for r in kept) == 90_000 and {r.id for r in kept} >= {0}
    assert {r.id for r in bounded_sample(long.repartition(7), 95_000).collect()} == {r.id for r in kept}
    named = spark.createDataFrame([("page-a", None, 1), ("page-a", None, 1), ("page-b", "x", 0)], "id string, content string, verdict int")
    assert sorted(map(tuple, bounded_sample(named, 0).collect())) == [("page-a", None, 1)]


def test_very_long_contents_are_judged(spark):
    df = spark.createDataFrame([(1, "one two three " * 100_000), (2, "x" * 1_500_000), (3, "")], "id bigint, content string")
    model = SentenceModel({"two": 3.0}, -2.0)
    found = {r.id: r for r in score_toxicity(df, model).collect()}
    assert found[1].score > 0.7 and found[1].passages[0].end == 1_400_000 and found[2].score == found[3].score
    scored = {r.id: r.score for r in score_quality(df, fit_quality(df, spark.createDataFrame([(1, 1), (3, 0)], "id bigint, verdict int"))).collect()}
    assert all(0 <= scored[i] <= 1 for i in (1, 2, 3))
