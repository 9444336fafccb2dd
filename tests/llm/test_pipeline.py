from collections import defaultdict

import pytest

import corpus_pipeline as C
from boxeval.llm.quality import fit_quality, score_quality
from boxeval.llm.queries import contents, verdicts
from boxeval.llm.secrets import _mask, find_secrets
from boxeval.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage was given and has returned."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        found[name] = docs, after
        docs = after
    return found


def test_stages_and_columns(spark, steps):
    assert [name for name, _ in C.STAGES] == ["quality", "toxicity", "near copies", "secrets", "packing"]
    first = steps["quality"][0]
    for name in ("quality", "toxicity", "near copies", "secrets"):
        assert steps[name][1].dtypes == first.dtypes


def test_rejections_follow_the_scores(spark, steps):
    texts = contents(spark, SF)
    good = {r.id for r in score_quality(texts, fit_quality(texts, verdicts(spark, SF, "quality"))).collect() if r.score >= 0.3}
    before, after = steps["quality"]
    assert rows_of(after) == [r for r in rows_of(before) if r[0] in good]
    before, after = steps["toxicity"]
    texts = before.selectExpr("doc_id id", "text content")
    toxic = {r.id for r in score_toxicity(texts, fit_toxicity(texts, verdicts(spark, SF, "toxic"))).collect() if r.score >= 0.5}
    assert rows_of(after) == [r for r in rows_of(before) if r[0] not in toxic]
    assert 0 < len(toxic) < 0.3 * before.count()


def test_one_of_each_group_stays(steps):
    from test_jaccard import brute

    before, after = steps["near copies"]
    rows = before.collect()
    stays = {i for i, root, _ in brute([(r.doc_id, r.text) for r in rows]) if i == root}
    assert rows_of(after) == [r for r in rows_of(before) if r[0] in stays]
    assert len(stays) < len(rows)


def test_secrets_are_masked(steps):
    before, after = steps["secrets"]
    masked = {r.doc_id: _mask(r.text, find_secrets(r.text)[0]) for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect()} == masked
    assert all(r.n_chars == len(r.text) for r in after.collect())
    assert not any(find_secrets(r.text)[0] for r in after.collect())


def test_all_that_is_left_is_packed(steps):
    before, after = steps["packing"]
    pieces, levels = defaultdict(int), defaultdict(int)
    for r in after.collect():
        pieces[r.doc_id] += r.length
        levels[r.sequence_id] += r.length
    assert pieces.keys() == {r.doc_id for r in before.collect()}
    assert max(levels.values()) <= 1024


def test_run_gives_the_last_stage(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(C.run(spark, SF).select(columns)) == rows_of(steps["packing"][1].select(columns))


def test_repeated_and_missing_ids(spark):
    one, two = " ".join(f"one{i}" for i in range(60)), " ".join(f"two{i}" for i in range(60))
    rows = [
        (7, one, "en", "s", 1), (7, two, "en", "s", 1), (7, two, "en", "t", 1), (8, one + " more", "en", "s", 1),
        (None, two, "en", "s", 1), (None, two + " more", "en", "s", 1), (None, "some other text", "en", "s", 1),
    ]
    kept = C.near_copies(spark, spark.createDataFrame(rows, DOCUMENTS), SF).collect()
    with_id = sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None)
    assert with_id == [(7, one), (7, two)]
    without = sorted(r.text[:4] for r in kept if r.doc_id is None)
    assert without == ["some", "two0"]


def test_odd_documents(spark, tmp_path):
    plain = "the quick brown fox jumps over the lazy dog and runs away"
    other = "seven other words that nobody else says"
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, plain, "en", "s", 57), (3, plain, "en", "s", 57), (4, plain, "en", "t", 57),
        (None, plain, "en", "s", 57), (5, "word " * 40_000, "en", "s", 200_000), (6, "token=abcdefghijklmnop " + other, "en", "s", 80),
    ]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], DOCUMENTS + ", content string, score double")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    assert C.quality(spark, docs, sf).count() == 8  # nothing was learned: all scores are 0.5
    assert C.toxic(spark, docs, sf).count() == 8
    kept = C.near_copies(spark, docs, sf)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 3, 5, 6)] + [(True, 0)]
    clean = {r.doc_id: (r.text, r.n_chars) for r in C.without_secrets(spark, docs, sf).collect()}
    assert clean[1] == (None, None) and clean[2] == ("", 0)
    assert clean[6] == ("[assign] " + other, 9 + len(other))
    assert {r.doc_id for r in C.sequences(spark, docs, sf).collect()} == {None, 1, 2, 3, 4, 5, 6}
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
