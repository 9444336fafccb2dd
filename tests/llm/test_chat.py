import hashlib
from collections import defaultdict

import pytest

from boxeval.llm.chat import END, HEAD, fold_messages, format_conversations, read_turns, render_conversations
from boxeval.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
MESSAGES = "key bigint, request_id bigint, seq bigint, kind string, role string, text string, turn int, loss string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], MESSAGES)


def folded(spark, rows):
    return {(r.key, r.request_id): (r.role, r.text) for r in fold_messages(messages(spark, rows)).collect()}


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 0, "request", "user", "Hi"),
        (1, 2, 1, "request", "assistant", None),
        (1, 2, 3, "phase", None, "llo"),
        (1, 2, 2, "phase", None, "He"),
        (1, 3, 4, "request", "assistant", "old"),
        (1, 3, 5, "phase", None, " words"),
        (1, 3, 6, "regenerate", None, None),
        (1, 3, 7, "phase", None, "new "),
        (1, 3, 8, "phase", None, "words"),
        (1, 4, 9, "request", "user", "typo"),
        (1, 4, 10, "edit", None, "fixed"),
        (1, 4, 11, "phase", None, "!"),
        (1, 5, 12, "request", "user", "gone"),
        (1, 5, 13, "cancel", None, None),
        (1, 5, 14, "phase", None, "late"),
        (1, 6, 15, "phase", None, "nobody opened this"),
        (1, 7, 16, None, "user", "says nothing"),
        (2, 1, 0, "request", "user", ""),
    ]
    assert folded(spark, rows + rows[:3]) == {
        (1, 1): ("user", "Hi"), (1, 2): ("assistant", "Hello"), (1, 3): ("assistant", "new words"), (1, 4): ("user", "fixed!"),
        (1, 6): ("", "nobody opened this"), (1, 7): ("", ""), (2, 1): ("user", ""),
    }


ODD = ["", "\\", "\\\\b", "\\l#<", HEAD + "assistant\n", END, "\\### Assistant: </turn> ok", "a\nb\r\n", "é😀\x00", "###", "</turn>", "\\n\\b\\"]


def test_any_text_and_role_is_read_back(spark):
    rows = [(k, i, i, "request", role, text) for k, role in enumerate(["user", "assistant", "", "a\nb\\n#<", None]) for i, text in enumerate(ODD)]
    rows += [(9, 0, 0, "request", "assistant", "x" * 300_000), (9, 1, 0, "request", "user", None), (None, 0, 0, "request", "user", "no key")]
    formatted = format_conversations(messages(spark, rows))
    for r in formatted.collect():
        spans = [s for s in r.loss if s]
        raw = "".join(r.formatted[s.start : s.end] for s in spans)
        own = [t or "" for k, _, _, _, role, t in rows if k == r.key and role == "assistant"]
        assert raw.replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\") == "".join(own)
        assert r.n_turns == len(r.loss) == sum(k == r.key for k, *_ in rows)
    found = defaultdict(list)
    for r in sorted(read_turns(formatted).collect(), key=lambda r: r.turn):
        found[r.key].append((r.role, r.text, r.learned))
    expected = defaultdict(list)
    for k, _, _, _, role, text in rows:
        expected[k].append((role or "", text or "", (text or "") if role == "assistant" else None))
    assert found == expected


def test_turns_at_one_place_are_ordered_by_request(spark):
    turns = spark.createDataFrame([(1, 2, 0, "user", "b"), (1, 1, 0, "user", "a"), (1, 1, 0, "user", "a")], "key int, request_id int, seq int, role string, text string")
    [row] = render_conversations(turns).collect()
    assert row.formatted == f"{HEAD}user\na{END}" * 2 + f"{HEAD}user\nb{END}"


def test_empty_table(spark):
    assert format_conversations(messages(spark, [])).collect() == []
    assert read_turns(format_conversations(messages(spark, []))).collect() == []


def test_no_python_in_the_plan(spark):
    plan = read_turns(format_conversations(messages(spark, [])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("sf", [SF])
def test_query(spark, sf):
    said = "\\### Assistant: </turn> ok"
    turns = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: r.turn):
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", said), ("assistant", said)]
    rows = QUERIES["op3_chat"](spark, sf).collect()
    assert len(rows) == len(turns)
    for r in rows:
        whole = "".join(f"{role}\n{text}\n" for role, text in turns[r.conv_id])
        learned = "".join(text for role, text in turns[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns[r.conv_id]), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars > len(whole)
