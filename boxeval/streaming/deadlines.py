"""Deadlines of requests, as keyed state with a timeout in event time.

A key's first request may have to load a model, so requests have a long
deadline until the key has completed one, and a short one from then on.
Messages wait in the state until the watermark has passed them, and are then
taken in the order of their time, so outcomes don't depend on the order of
arrival.  What the state holds of a key is the messages that the watermark has
not passed, its open requests, and whether it has completed one.

A call costs far more than a message, so keys share the state of a bucket: it
comes and goes once a batch, with all messages of its keys.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boxeval.streaming.lifecycle import ANSWERS

# fixed values: seconds to a request's deadline before and after its key's first completion
COLD_SECONDS, WARM_SECONDS = 60, 20
#: Waiting messages may be more than fit into memory; this provider keeps them on disk.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Calls of a batch, at most; keys of one bucket are loaded together.
BUCKETS = 4096
_OUTCOMES = ["key", "request_id", "outcome", "elapsed_ms", "cold"]
#: Messages of other kinds say nothing about an outcome and don't wait.
_TELLING = ("request", "cancel", *ANSWERS)


def _state(kind: str) -> str:
    """Waiting messages, open requests, and the keys that have completed one."""
    waiting = f"w_key array<{kind}>, w_us array<bigint>, w_event array<bigint>, w_request array<bigint>, w_kind array<int>"
    open_ = f"o_key array<{kind}>, o_request array<bigint>, o_opened array<bigint>, o_deadline array<bigint>, o_cold array<boolean>"
    return f"{waiting}, {open_}, completed array<{kind}>"


def _millis(us: int) -> int:
    """The first millisecond at which a moment is past."""
    return -(-us // 1000)


def _plain(values: pd.Series) -> list:
    return [None if v != v else v for v in values.tolist()]


def _columns(rows: Iterable[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(width)]


def _deadlines(cold_us: int, warm_us: int) -> Callable:
    """Tells each request's only outcome: an answer, ``aborted``, or ``timeout``."""

    def settle(waiting: dict, open_: dict, completed: bool, now: int) -> tuple[list, bool]:
        """Takes the messages of a key that the watermark has passed; what else waits or is open stays."""
        found = []

        def end(request: int, outcome: str, us: int) -> None:
            opened, _, cold = open_.pop(request)
            found.append((request, outcome, (us - opened) / 1000, cold))

        def time_out(until: int) -> None:
            for deadline, request in sorted((deadline, request) for request, (_, deadline, _) in open_.items() if deadline < until):
                end(request, "timeout", deadline)

        for at in sorted(at for at in waiting if _millis(at[0]) <= now):
            us, (request, code) = at[0], waiting.pop(at)
            kind = _TELLING[code]
            time_out(us)
            if kind == "request":
                if request not in open_:
                    open_[request] = (us, us + (warm_us if completed else cold_us), not completed)
            elif request in open_:
                end(request, "aborted" if kind == "cancel" else kind, us)
                completed = completed or kind in ANSWERS
        time_out(now * 1000 + 1)
        return found, completed

    def take(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, open_, completed = defaultdict(dict), defaultdict(dict), set()
        if state.exists:
            held = state.get
            for key, us, event_id, request, code in zip(*held[:5], strict=True):
                waiting[key][us, event_id] = request, code
            for key, request, *told in zip(*held[5:10], strict=True):
                open_[key][request] = tuple(told)
            completed = set(held[10])
        for part in parts:
            values = (part[c].tolist() for c in ("us", "event_id", "request_id", "kind"))
            for key, us, event_id, request, kind in zip(_plain(part["key"]), *values, strict=True):
                if kind in _TELLING:
                    # a message that is sent again takes its own place
                    waiting[key][int(us), int(event_id)] = int(request), _TELLING.index(kind)
        now, found = state.getCurrentWatermarkMs(), []
        for key in waiting.keys() | open_.keys():
            rows, warm = settle(waiting[key], open_[key], key in completed, now)
            found += [(key, *row) for row in rows]
            if warm:
                completed.add(key)
        messages = _columns(((key, *at, *m) for key, own in waiting.items() for at, m in own.items()), 5)
        requests = _columns(((key, r, *told) for key, own in open_.items() for r, told in own.items()), 5)
        if messages[0] or requests[0] or completed:
            state.update((*messages, *requests, list(completed)))
        elif state.exists:
            state.remove()
        rest = messages[1] + requests[3]
        if rest:
            # Spark calls once the watermark is above the timeout
            state.setTimeoutTimestamp(max(_millis(min(rest)) - 1, 1))
        if found:
            yield pd.DataFrame(found, columns=_OUTCOMES)

    return take


def settle_by_deadline(
    messages: DataFrame, late: str, cold_seconds: int = COLD_SECONDS, warm_seconds: int = WARM_SECONDS, buckets: int = BUCKETS
) -> DataFrame:
    """``key, request_id, outcome, elapsed_ms, cold`` of each request of a stream, once the watermark has passed its end.

    ``messages`` has ``key, request_id, kind, us, event_id`` and ``ts``, the same
    time as ``us``; those more than ``late`` behind the newest don't count.  A
    request that is answered or cancelled after its deadline, or never, has the
    outcome ``timeout``; ``cold`` says that its key had completed none when it
    was opened.  Only answers in time complete a request, and only they make a
    key warm.  Answers to what is not open are ignored.

    Messages of one key are taken by one task, as they depend on each other.
    ``buckets`` can't be changed for a stream that has begun.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # a null would turn the whole numbers beside it into floats
    bucket = F.when(F.col("key").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)))
    timed = messages.select(bucket.alias("bucket"), "key", "request_id", "kind", "us", "event_id", "ts").withWatermark("ts", late)
    kind = messages.schema["key"].dataType.simpleString()
    schema = f"key {kind}, request_id bigint, outcome string, elapsed_ms double, cold boolean"
    take = _deadlines(cold_seconds * 1_000_000, warm_seconds * 1_000_000)
    return timed.groupBy("bucket").applyInPandasWithState(take, schema, _state(kind), "append", GroupStateTimeout.EventTimeTimeout)
