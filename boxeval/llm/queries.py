"""One query per operator: the given tables as the operator's records, and its results as the agreed columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.llm.bpe import tokenize_contents
from boxeval.llm.chat import format_conversations, read_turns
from boxeval.llm.common import fixture_contents, held_out
from boxeval.llm.divergence import source_divergences
from boxeval.llm.fingerprints import fingerprint_neighbours
from boxeval.llm.jaccard import near_duplicates
from boxeval.llm.lines import drop_repeated_lines
from boxeval.llm.neighbours import nearest_boards
from boxeval.llm.packing import cut_contents, pack_pieces
from boxeval.llm.quality import fit_quality, score_quality
from boxeval.llm.rollups import commit, totals
from boxeval.llm.secrets import KINDS, scan_secrets
from boxeval.llm.toxicity import fit_toxicity, score_toxicity
from boxeval.llm.whitening import confidence_levels, fit_whitening, identity_error, whiten
from boxeval.session import cut
from boxeval.streaming.sinks import remove_folder, work_folder

#: What a content's tokens end with, and the texts that the vocabulary takes for one token.
END_ID, SPECIALS = 2, {"<|endoftext|>": 50256}

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_contents(_table(spark, sf_dir, "documents"), "doc_id", "text")


def verdicts(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """The verdicts that may be learned from."""
    rows = _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return rows.select(F.col("doc_id").alias("id"), F.col(label).alias("verdict"))


@_query("op1_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = contents(spark, sf_dir)
    scored = score_toxicity(texts, fit_toxicity(texts, verdicts(spark, sf_dir, "toxic")))
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "passages",
    )


def packed(texts: DataFrame) -> DataFrame:
    """Pieces of contents with the check sum of their ids and their place in a sequence."""
    # the same ids as the JSON file's library gives, four times as fast; the tests compare them
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = cut_contents(texts, path, public_tokenizers.PATTERN, SPECIALS, END_ID)
    pieces = pieces.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids")
    return pack_pieces(pieces).withColumnRenamed("id", "doc_id")


@_query("op2_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(contents(spark, sf_dir))


def _events(text: Column) -> Column:
    """How a turn came about, as ``step, kind, text``: what was written before is taken back by the log itself.

    An assistant's answer was streamed, broken off half way, and generated
    anew; what others say was sent half and then edited.  Without a turn there
    is no order, so such a row is one message.
    """
    half, third = F.floor(F.length(text) / 2).cast("int"), F.floor(F.length(text) / 3).cast("int")
    none = F.lit(None).cast("string")

    def event(step: int, kind: str, said: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("text"))

    def part(start: Column, length: Column) -> Column:
        return F.substring(text, start, length)

    streamed = F.array(
        event(0, "request", none), event(1, "phase", part(F.lit(1), half)), event(2, "regenerate", none),
        event(3, "phase", part(F.lit(1), third)), event(4, "phase", part(third + 1, F.length(text))),
    )
    edited = F.array(event(0, "request", part(F.lit(1), half)), event(1, "edit", text))
    return F.when(F.col("turn").isNull(), F.array(event(0, "request", text))).when(F.col("role") == "assistant", streamed).otherwise(edited)


@_query("op3_chat")
def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    # equal rows are turns of their own, so that each has a number in its request's id
    counted = rows.unionByName(extra).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    counted = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    messages = counted.select(
        F.col("conv_id").alias("key"),
        F.struct("role", F.md5("text").alias("digest"), "copy").alias("request_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        F.inline(_events(F.coalesce("text", F.lit("")))),
    )
    messages = messages.withColumn("seq", 8 * F.col("turn") + F.col("step"))
    formatted = cut(format_conversations(messages))
    turns = read_turns(formatted).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "learned"))).alias("t")
    )
    turns = turns.select(
        F.col("key").alias("conv_id"),
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join(F.col("t.learned"), "").alias("learned"),
    )
    sizes = formatted.select(F.col("key").alias("_key"), F.length("formatted").cast("long").alias("formatted_chars"))
    return turns.join(sizes, F.col("conv_id").eqNullSafe(F.col("_key"))).select(
        "conv_id",
        "n_turns",
        F.sha2("all", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@_query("op4_lz_fingerprints")
def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(contents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def _span_list(spans: Column) -> Column:
    def text(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, text), ",")


@_query("op5_secrets")
def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["layer"] == "")
    found = scan_secrets(contents(spark, sf_dir)).withColumn("base", base)
    return found.select(
        F.col("id").alias("doc_id"),
        *map(number, KINDS),
        F.sha2(_span_list(F.col("base")), 256).alias("base_sha256"),
        _span_list(F.col("spans")).alias("spans"),
        "complete",
    )


@_query("op6_byte_bpe")
def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = tokenize_contents(contents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op7_nearest")
def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("board_id"), F.col("embedding").alias("confidences")
    )
    return nearest_boards(boards, F.col("board_id") % 20 == 0).withColumnRenamed("board_id", "vec_id")


@_query("op8_quality")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = contents(spark, sf_dir)
    scored = score_quality(texts, fit_quality(texts, verdicts(spark, sf_dir, "quality")))
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@_query("op9_ngram_jaccard")
def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(contents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


_ROLLUP_SQL = """
WITH counted AS (
  SELECT doc_id, source, lang, length(coalesce(text, '')) AS letters,
         CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS guess,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS words
  FROM documents),
changes AS (
  SELECT source, lang, 'words-1' AS tokenizer, 1 AS f, guess AS t FROM counted
  UNION ALL SELECT source, lang, 'words-1', 0, words - guess FROM counted
  UNION ALL SELECT source, lang, 'letters-1', 1, letters FROM counted
  UNION ALL SELECT source, lang, 'words-1', -1, -words FROM counted
            WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT source, lang AS language, tokenizer, CAST(sum(f) AS BIGINT) AS n_fixtures, CAST(sum(t) AS BIGINT) AS n_tokens
FROM changes GROUP BY ALL
"""


@_query("op10_token_rollups", _ROLLUP_SQL)
def rollups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses are inserted, then revised by counts; rejected documents go; and the revision is sent twice."""
    text = F.coalesce("text", F.lit(""))
    counted = _table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        F.col("lang").alias("language"),
        F.length(text).cast("long").alias("letters"),
        F.ceil(F.length(text) / 4).cast("long").alias("guess"),
        F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")).cast("long").alias("words"),
    )

    def change(batch: int, kind: str, tokenizer: str, n_tokens: str, prev_tokens: str | None = None) -> Column:
        before = F.col(prev_tokens) if prev_tokens else F.lit(None).cast("long")
        return F.struct(
            F.lit(batch).alias("batch_id"),
            F.lit(kind).alias("kind"),
            F.lit(tokenizer).alias("tokenizer"),
            F.col(n_tokens).alias("n_tokens"),
            before.alias("prev_tokens"),
        )

    def changes(of: DataFrame, *each: Column) -> DataFrame:
        return of.select("source", "language", F.inline(F.array(*each)))

    revision = change(2, "revise", "words-1", "words", "guess")
    first = changes(counted, change(1, "insert", "words-1", "guess"), revision, change(3, "insert", "letters-1", "letters"))
    rejected = _table(spark, sf_dir, "labels").where(F.col("quality") == 0)
    second = changes(counted.join(rejected, "doc_id", "left_semi"), change(4, "delete", "words-1", "words"))
    table = work_folder(spark, "rollups")
    commit(first, table)
    commit(second.unionByName(changes(counted, revision)), table)
    result = cut(totals(spark, table))
    remove_folder(spark, table)
    return result


@_query("op11_whitening")
def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("board_id"), F.col("embedding").alias("confidences")
    )
    levels = confidence_levels(boards)
    model = fit_whitening(levels)
    rows = whiten(levels, model).select("board_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained())).cast("array<double>")
    return rows.select(
        F.col("board_id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        F.col("deviation").cast("bigint").alias("deviation"),
        "whitened",
        F.get(explained, "at").alias("explained"),
        F.lit(identity_error(levels, model)).alias("identity_error"),
    )


_LINES_SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM rows),
keys AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS holder FROM keys WHERE length(key) >= 40
             GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 5),
told AS (SELECT k.*, p.holder IS NOT NULL AND k.doc_id IS DISTINCT FROM p.holder AS dropped FROM keys k LEFT JOIN repeated p USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM told GROUP BY r, doc_id
"""


@_query("op12_line_dedup", _LINES_SQL)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_repeated_lines(contents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("content", 256).alias("kept_sha256"))


_DIVERGENCE_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
used AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows),
kept AS (SELECT lang, term FROM used GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM rows),
counts AS (SELECT lang, source, term, count(*) AS n FROM used JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
           LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
own AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1)::HUGEINT // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM filled JOIN v USING (lang)),
whole AS (SELECT lang, term, 1 + 1000000000 * (n + 1)::HUGEINT // (sum(n) OVER (PARTITION BY lang) + v) AS q
          FROM (SELECT lang, term, sum(n) AS n FROM filled GROUP BY lang, term) JOIN v USING (lang)),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@_query("op13_source_divergence", _DIVERGENCE_SQL)
def divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    texts = documents.select(F.col("text").alias("content"), F.col("lang").alias("language"), "source")
    return source_divergences(texts).withColumnRenamed("language", "lang")
