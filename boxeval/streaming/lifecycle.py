"""Request lifecycles as streaming aggregations.

A request is settled by the first of its answers, its cancellation, or a newer
request of the same key.  Each of those is a minimum over the request's own
messages, so the state is one small row per request rather than per key: a key
that sends a third of all messages is spread over its requests, and messages
combine before the shuffle.  The same functions run on batch and streaming
frames.

Messages have ``key, request_id, kind, us, event_id``; ``us`` is event time in
microseconds and ``kind`` one of request, phase, result, error, cancel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWERS = ("result", "error")


def with_successors(messages: DataFrame) -> DataFrame:
    """Let every request also tell the one before it that it is superseded."""
    is_request = F.col("kind") == "request"
    plain = F.struct(F.col("request_id").alias("id"), F.col("kind").alias("what"))
    newer = F.struct((F.col("request_id") - 1).alias("id"), F.lit("superseded").alias("what"))
    told = F.when(is_request & (F.col("request_id") > 1), F.array(plain, newer)).otherwise(F.array(plain))
    return messages.withColumn("m", F.explode(told))


def _first(kinds: tuple[str, ...]) -> Column:
    """Earliest message of these kinds: time, then id."""
    seen = F.struct(F.col("us"), F.col("event_id"), F.col("m.what").alias("what"))
    return F.min(F.when(F.col("m.what").isin(*kinds), seen))


def settle(messages: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """The state of each request: when it opened, what ended it first, what came late."""
    rows = with_successors(messages)
    keys = [F.col("key"), F.col("m.id").alias("request_id"), *(extra or [])]
    return rows.groupBy(*keys).agg(
        F.min(F.when(F.col("m.what") == "request", F.col("us"))).alias("opened"),
        _first((*ANSWERS, "cancel", "superseded")).alias("end"),
        F.count_if(F.col("m.what").isin(*ANSWERS)).alias("answers"),
        F.count_if(F.col("m.what") == "phase").alias("phases"),
    )


def lifecycle(messages: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """One row per request with its only outcome and the time it took.

    Answers after a cancellation or a newer request are not delivered; they and
    repeated answers are counted in ``rejected``.
    """
    settled = settle(messages, extra)
    outcome = (
        F.when(F.col("end").isNull(), F.lit("pending"))
        .when(F.col("end.what") == "cancel", F.lit("aborted"))
        .otherwise(F.col("end.what"))
    )
    delivered = outcome.isin(*ANSWERS)
    names = [c for c in settled.columns if c not in ("opened", "end", "answers", "phases")]
    return settled.where(F.col("opened").isNotNull()).select(
        *names,
        outcome.alias("outcome"),
        ((F.col("end.us") - F.col("opened")) / 1000).alias("elapsed_ms"),
        "phases",
        (F.col("answers") - delivered.cast("bigint")).alias("rejected"),
    )


def expiring_lifecycle(messages: DataFrame, late: str, idle: str) -> DataFrame:
    """The lifecycle on an endless stream: a request without messages for ``idle`` is told and forgotten.

    Messages more than ``late`` behind the newest are dropped; the stream's
    progress counts them (``numRowsDroppedByWatermark``).
    """
    timed = messages.withWatermark("ts", late)
    return lifecycle(timed, [F.session_window("ts", idle).alias("w")]).drop("w")


def delivered_once(messages: DataFrame, late: str) -> DataFrame:
    """Messages without those that were sent again within ``late`` of the first, or that came later than that.

    A message is known by its ``event_id`` until the watermark is ``late``
    beyond its own time, so the state holds the ids of that stretch only.  Those
    that are behind the watermark when they come are dropped, and counted by the
    stream's progress (``numRowsDroppedByWatermark``).
    """
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def state_of_request(messages: DataFrame) -> DataFrame:
    """What each request would show: how it ended first, else its newest progress.

    ``detail`` of a phase is ``loading-model`` or ``recognizing``, and of a
    result ``no-board`` if there was none.  A request that was never opened
    shows nothing and has a null ``opened``.
    """
    kind, detail = F.col("kind"), F.col("detail")
    shown = (
        F.when(kind == "request", F.lit("capturing"))
        .when(kind == "phase", F.coalesce(detail, F.lit("recognizing")))
        .when(kind == "result", F.when(detail == "no-board", detail).otherwise(F.lit("done")))
        .when(kind == "error", kind)
        .when(kind == "cancel", F.lit("cancelled"))
    )
    at = F.struct("us", "event_id", shown.alias("status"))
    return messages.groupBy("key", "request_id").agg(
        F.min(F.when(kind == "request", F.col("us"))).alias("opened"),
        F.min(F.when(kind.isin(*ANSWERS, "cancel"), at)).alias("end"),
        F.max(F.when(kind.isin("request", "phase"), at)).alias("progress"),
    )


def status_of_key(states: DataFrame) -> DataFrame:
    """What each key shows now: the state of its current request, the last one that was opened.

    Answers to earlier requests don't matter, nor what comes after a request
    has ended.  A key that never opened a request is ``idle``.
    """
    status = F.when(F.col("opened").isNull(), F.lit("idle")).otherwise(F.coalesce("end.status", "progress.status"))
    current = F.max(F.struct(F.col("opened").isNotNull().alias("open"), "request_id", status.alias("status")))
    return states.groupBy("key").agg(current.alias("n")).select("key", "n.status")


def stale_requests(messages: DataFrame) -> DataFrame:
    """The lifecycle in which a page change ends the request that is current then.

    ``context`` messages carry ``latest``, the key's current request at that
    moment; such requests have the outcome ``aborted`` by the change.
    """
    change = F.col("kind") == "context"
    about = F.when(change, F.col("latest")).otherwise(F.col("request_id"))
    told = messages.withColumn("request_id", about).withColumn("kind", F.when(change, F.lit("cancel")).otherwise(F.col("kind")))
    return lifecycle(told)


def first_answers(messages: DataFrame) -> DataFrame:
    """When each worker answered first; requests that were opened before are cold."""
    at = F.struct("us", "event_id")
    answered = F.min(F.when(F.col("kind").isin(*ANSWERS), at))
    return messages.groupBy("worker").agg(answered.alias("ready"))


def quarantine_rules() -> Column:
    """Why a raw message is malformed; empty for a good one."""
    from boxeval.functions.numbers import reasons

    return reasons(
        (F.col("key").isNull(), "key"),
        (~F.coalesce(F.col("request_id") > 0, F.lit(False)), "request-id"),
        (~F.coalesce(F.col("kind").isin("request", "phase", "cancel", *ANSWERS), F.lit(False)), "kind"),
        (~F.coalesce(F.col("ms").between(0.0, 1e9), F.lit(False)), "duration"),
    )


def split_sinks(stream: DataFrame, good_path: str, bad_path: str, checkpoint: str):
    """Write good messages to one folder and malformed ones, with reasons, to another.

    Files are written under the batch number, so a batch that runs again after
    a failure replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = batch.withColumn("reasons", quarantine_rules()).persist()
        bad = F.size("reasons") > 0
        parts = ((checked.where(~bad).drop("reasons"), good_path), (checked.where(bad), bad_path))
        for rows, path in parts:
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        checked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def value_counts(stream: DataFrame, keys: list[str], value: str, length: str, late: str) -> DataFrame:
    """Equal values per tumbling window and group, from which ranks are exact.

    The state holds one counter per distinct value, and grows with those.
    """
    timed = stream.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", length).alias("w"), *keys, F.col(value).alias("value")).agg(
        F.count("*").alias("n")
    )
    return counted.select(F.col("w.start").alias("start"), *keys, "value", "n")
