"""Conversations rebuilt from request messages, and rendered for training.

A conversation is the log of one ``key``.  Each of its turns is a request, and
the messages about it are folded in their order:

* ``request`` opens the turn with its role, and text if there is some already;
* ``phase`` is a streamed delta that goes on from what is there;
* ``edit`` puts its text in the place of all before;
* ``regenerate`` drops what is there; deltas that follow build the turn anew;
* ``cancel`` withdraws the turn, whatever came before or comes later.

Turns stand in the order in which they were opened.  All of it is column
expressions, grouping and windows.  Only a turn's own messages, and then a
conversation's final turns, meet in one row, as its rendered text has to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"
LOSS_ROLE = "assistant"
#: A backslash stands only before one of these letters, so what is read back is what was written.
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_ESCAPES, ("\n", "\\n"))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, role: bool = False) -> Column:
    """The text without any character that a marker begins with; of a role also without line ends."""
    return _replaced(text, list(_ROLE_ESCAPES if role else _ESCAPES))


def unescape(text: Column, role: bool = False) -> Column:
    """What :func:`escape` was given."""
    return _replaced(text, [(new, old) for old, new in reversed(_ROLE_ESCAPES if role else _ESCAPES)])


def fold_messages(messages: DataFrame) -> DataFrame:
    """``key, request_id, seq, role, text``: the final turn of each request.

    ``messages`` has ``key, request_id, seq, kind, role, text``; ``seq`` orders
    the messages of a key, and of equal ones the order is that of kind, role and
    text.  Turns have the ``seq`` of their first ``request`` message and its
    role; requests that nobody opened have the first message's, and the role
    ''.  A repeated message (all six columns equal) is one message.  Null texts
    are empty, null kinds say nothing, null keys make one conversation.
    """
    rows = messages.select("key", "request_id", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    one = ["key", "request_id"]
    at = F.struct("seq", "kind", "role", "text")
    says = F.col("kind").isin("request", "phase", "edit")
    resets = F.col("kind").isin("edit", "regenerate")
    whole = Window.partitionBy(*one)
    rows = rows.withColumn("_at", at).withColumn("_reset", F.max(F.when(resets, F.col("_at"))).over(whole))
    live = F.col("_reset").isNull() | (F.col("_at") >= F.col("_reset"))
    opened = F.min(F.when(F.col("kind") == "request", F.struct("seq", "role")))
    turns = rows.groupBy(*one).agg(
        F.coalesce(opened["seq"], F.min("seq")).alias("seq"),
        F.coalesce(opened["role"], F.lit("")).alias("role"),
        F.array_join(F.array_sort(F.collect_list(F.when(says & live, F.col("_at"))))["text"], "").alias("text"),
        F.coalesce(F.bool_or(F.col("kind") == "cancel"), F.lit(False)).alias("_gone"),
    )
    return turns.where(~F.col("_gone")).select(*one, "seq", "role", "text")


def render_conversations(turns: DataFrame) -> DataFrame:
    """``key, n_turns, formatted, loss`` for each conversation.

    ``turns`` are as :func:`fold_messages` gives them.  ``loss`` has an entry per
    turn: start and end (code points of ``formatted``, end exclusive) of the
    text that is to be learned, that of the assistant's turns, else null.  An
    empty text has an empty span.
    """
    role = escape(F.coalesce("role", F.lit("")), role=True)
    text = escape(F.coalesce("text", F.lit("")))
    parts = turns.select("key", "seq", "request_id", "role", F.concat(F.lit(HEAD), role, F.lit("\n")).alias("head"), text.alias("body"))
    order = Window.partitionBy("key").orderBy("seq", "request_id")
    length = F.length("head") + F.length("body") + len(END)
    start = F.sum(length.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(start, F.lit(0)) + F.length("head")
    span = F.struct(start.alias("start"), (start + F.length("body")).alias("end"))
    placed = parts.select(
        "key",
        F.struct(
            F.row_number().over(order).alias("turn"),
            F.concat("head", "body", F.lit(END)).alias("chunk"),
            F.when(F.col("role") == LOSS_ROLE, span).alias("loss"),
        ).alias("t"),
    )
    whole = placed.groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select(
        "key",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.col("t.chunk"), "").alias("formatted"),
        F.col("t.loss").alias("loss"),
    )


def format_conversations(messages: DataFrame) -> DataFrame:
    """Messages to rendered conversations; an empty table gives an empty one, other columns are not looked at."""
    return render_conversations(fold_messages(messages))


def read_turns(conversations: DataFrame) -> DataFrame:
    """``key, turn, role, text, learned`` read back from ``formatted`` and ``loss`` alone.

    ``learned`` is the text under the loss mask, null outside of it.
    """
    chunks = F.slice(F.split("formatted", END), 1, F.greatest(F.size("loss"), F.lit(1)))
    rows = conversations.select("key", F.posexplode(F.arrays_zip(chunks.alias("chunk"), F.col("loss").alias("loss"))).alias("turn", "t"))
    rows = rows.select("key", "turn", "t.chunk", "t.loss")
    before = Window.partitionBy("key").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum((F.length("chunk") + len(END)).cast("long")).over(before), F.lit(0))
    head = F.substring_index("chunk", "\n", 1)
    masked = F.substring(F.col("chunk"), (F.col("loss.start") - start + 1).cast("int"), (F.col("loss.end") - F.col("loss.start")).cast("int"))
    return rows.select(
        "key",
        "turn",
        unescape(F.substring(head, F.lit(len(HEAD) + 1), F.length(head)), role=True).alias("role"),
        unescape(F.substring(F.col("chunk"), F.length(head) + 2, F.length("chunk"))).alias("text"),
        unescape(masked).alias("learned"),
    )
