from pyspark.sql import functions as F

from boxeval.streaming import lifecycle as S
from boxeval.streaming.deadlines import settle_by_deadline
from boxeval.streaming.sinks import appended, appended_with_progress, final_state, remove_folder, replay, work_folder

MESSAGE = "key bigint, request_id bigint, kind string, us bigint, event_id bigint"
SECOND = 1_000_000


def timeline(*messages):
    """(key, request, kind, second) with the position as message id."""
    return [(k, r, kind, int(at * SECOND), n) for n, (k, r, kind, at) in enumerate(messages)]


CASES = timeline(
    (1, 1, "request", 0), (1, 1, "phase", 1), (1, 1, "result", 3), (1, 1, "result", 4),  # a repeated answer
    (2, 1, "request", 0), (2, 1, "cancel", 1), (2, 1, "result", 2),  # cancelled before the answer
    (3, 1, "request", 0), (3, 2, "request", 1), (3, 1, "result", 2), (3, 2, "error", 5),  # a newer one wins
    (4, 1, "request", 0),  # never answered
    (5, 7, "result", 1),  # an answer to nothing
    (6, 1, "request", 0), (6, 1, "result", 1), (6, 1, "cancel", 2),  # cancelled too late
)
WANT = {
    (1, 1): ("result", 3000.0, 1),
    (2, 1): ("aborted", 1000.0, 1),
    (3, 1): ("superseded", 1000.0, 1),
    (3, 2): ("error", 4000.0, 0),
    (4, 1): ("pending", None, 0),
    (6, 1): ("result", 1000.0, 0),
}


def outcomes(df):
    return {(r.key, r.request_id): (r.outcome, r.elapsed_ms, r.rejected) for r in df.collect()}


def test_lifecycle_in_batch_and_stream(spark):
    df = spark.createDataFrame(CASES, MESSAGE)
    assert outcomes(S.lifecycle(df)) == WANT
    with replay(df, "us") as stream:
        assert outcomes(final_state(S.lifecycle(stream), ["key", "request_id"])) == WANT


def test_sessions_let_the_state_expire(spark):
    # an idle gap closes a request's state; a far later message moves the watermark on
    late = (9, 1, "phase", 10_000 * SECOND, 99)
    df = spark.createDataFrame([*CASES, late], MESSAGE).withColumn("ts", F.timestamp_micros("us"))
    with replay(df, "us") as stream:
        assert outcomes(appended(S.expiring_lifecycle(stream, "1 second", "1 minute"))) == WANT


def test_status_is_that_of_the_current_request(spark):
    rows = timeline(
        (1, 1, "request", 0), (1, 2, "request", 1), (1, 1, "result", 2),  # a late answer to the request before
        (2, 1, "request", 0), (2, 1, "result", 3), (2, 1, "phase", 4),  # nothing counts after the end
        (3, 1, "request", 0), (3, 1, "phase", 1), (3, 1, "phase", 2),
        (4, 1, "request", 0), (4, 1, "cancel", 1), (4, 1, "result", 2),
        (5, 7, "result", 1),  # never opened
        (6, 1, "request", 0), (6, 1, "error", 1),
        (7, 1, "request", 0), (7, 1, "result", 1),
        (8, 1, "request", 0), (8, 1, "phase", 1),
    )
    details = {7: "loading-model", 8: "recognizing", 16: "no-board", 18: "loading-model"}
    df = spark.createDataFrame([(*r, details.get(r[4])) for r in rows], f"{MESSAGE}, detail string")
    want = {1: "capturing", 2: "done", 3: "recognizing", 4: "cancelled", 5: "idle", 6: "error", 7: "no-board", 8: "loading-model"}
    assert {r.key: r.status for r in S.status_of_key(S.state_of_request(df)).collect()} == want
    with replay(df, "us") as stream:
        states = final_state(S.state_of_request(stream), ["key", "request_id"])
    assert {r.key: r.status for r in S.status_of_key(states).collect()} == want


def test_page_changes_make_the_current_request_stale(spark):
    rows = timeline((1, 1, "request", 0), (1, 1, "request", 0), (1, 2, "request", 5), (1, 1, "result", 6), (1, 1, "context", 7), (1, 2, "result", 8))
    rows += [(2, 1, "request", 0, 50), (2, 1, "result", 1 * SECOND, 51), (2, 1, "context", 2 * SECOND, 52)]
    df = spark.createDataFrame(rows, MESSAGE).withColumn("latest", F.when(F.col("us") >= 5 * SECOND, 2).otherwise(1).cast("bigint"))
    got = outcomes(S.stale_requests(df))
    assert got == {(1, 1): ("superseded", 5000.0, 1), (1, 2): ("aborted", 2000.0, 1), (2, 1): ("result", 1000.0, 0)}


def test_first_answers_of_workers(spark):
    rows = [("a", "request", 1, 1), ("a", "error", 5, 3), ("a", "result", 5, 2), ("b", "phase", 1, 4)]
    df = spark.createDataFrame(rows, "worker string, kind string, us bigint, event_id bigint")
    want = {"a": (5, 2), "b": None}
    assert {r.worker: r.ready and tuple(r.ready) for r in S.first_answers(df).collect()} == want
    with replay(df, "us") as stream:
        assert {r.worker: r.ready and tuple(r.ready) for r in final_state(S.first_answers(stream), ["worker"]).collect()} == want


def test_nothing_is_left_in_the_work_folder(spark):
    from pathlib import Path

    from boxeval.session import checkpoint_root

    root = Path(checkpoint_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    with replay(spark.createDataFrame(CASES, MESSAGE), "us") as stream:
        final_state(S.lifecycle(stream), ["key", "request_id"])
    assert {p for p in set(root.iterdir()) - before if p.name.startswith(("source", "state", "progress"))} == set()


def test_malformed_messages_are_set_aside(spark, tmp_path):
    rows = [(1, 1, "request", 1.0), (None, 1, "request", 1.0), (1, 0, "bogus", -1.0), (1, None, "result", float("nan"))]
    df = spark.createDataFrame(rows, "key bigint, request_id bigint, kind string, ms double").withColumn("us", F.monotonically_increasing_id())
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    with replay(df, "us") as stream:
        S.split_sinks(stream, good, bad, str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(good).count() == 1
    reasons = sorted(tuple(r.reasons) for r in spark.read.parquet(bad).collect())
    assert reasons == [("key",), ("request-id", "duration"), ("request-id", "kind", "duration")]


def test_expired_requests_leave_the_state(spark):
    rows = [(k, 1, kind, (10 * k + at + 1) * SECOND, 2 * k + at) for k in range(200) for kind, at in (("request", 0), ("result", 1))]
    df = spark.createDataFrame(rows, MESSAGE).withColumn("ts", F.timestamp_micros("us"))
    with replay(df, "us", steps=4) as stream:
        told, progress = appended_with_progress(S.expiring_lifecycle(stream, "1 second", "1 minute"))
    held = [p["numRowsTotal"] for p in progress]
    # what is held follows the newest minute of a stream of more than half an hour, not its length
    assert max(held) > 40 and held[-1] <= 10 and told.count() >= 190


def settled(df):
    return {(r.key, r.request_id): (r.outcome, r.elapsed_ms, r.cold) for r in df.collect()}


DEADLINES = timeline(
    (1, 1, "request", 0), (1, 1, "result", 60), (1, 2, "request", 61), (1, 2, "error", 81),  # at the deadline is in time
    (2, 1, "request", 0), (2, 1, "result", 60.5), (2, 2, "request", 70), (2, 2, "phase", 80), (2, 2, "result", 129),  # an answer too late makes no key warm
    (3, 1, "request", 0), (3, 2, "request", 1), (3, 2, "error", 2), (3, 3, "request", 3), (3, 1, "result", 59), (3, 3, "result", 24),
    (4, 1, "request", 0), (4, 1, "cancel", 5), (4, 1, "result", 6), (4, 2, "request", 7),
    (5, 1, "result", 1), (5, 1, "request", 2), (5, 1, "result", 3), (5, 1, "result", 4),
    (9, 9, "phase", 4000), (9, 1, "request", 3999),  # moves the watermark on; still open at the end
)
# a stream's first watermark is the epoch: what happened then would be late
DEADLINES = [(k, r, kind, us + 1000 * SECOND, n) for k, r, kind, us, n in DEADLINES]
OUTCOMES = {
    (1, 1): ("result", 60_000.0, True), (1, 2): ("error", 20_000.0, False),
    (2, 1): ("timeout", 60_000.0, True), (2, 2): ("result", 59_000.0, True),
    (3, 1): ("result", 59_000.0, True), (3, 2): ("error", 1000.0, True), (3, 3): ("timeout", 20_000.0, False),
    (4, 1): ("aborted", 5000.0, True), (4, 2): ("timeout", 60_000.0, True),
    (5, 1): ("result", 1000.0, True),
}


def test_deadlines_before_and_after_the_first_completion(spark):
    df = spark.createDataFrame(DEADLINES, MESSAGE).withColumn("ts", F.timestamp_micros("us"))
    for steps in (1, 4):
        with replay(df, "us", steps=steps) as stream:
            rows = appended(settle_by_deadline(stream, "1 second"))
        assert settled(rows) == OUTCOMES and rows.count() == len(OUTCOMES)


def test_deadlines_do_not_depend_on_arrival(spark):
    # messages come in any order as long as the watermark allows it, and all of them twice
    rows = [(*m, 0) for m in DEADLINES if m[0] != 9] + [(*m, 1) for m in DEADLINES if m[0] != 9] + [(*m, 2) for m in DEADLINES if m[0] == 9]
    df = spark.createDataFrame(rows, f"{MESSAGE}, turn int").withColumn("ts", F.timestamp_micros("us"))
    mixed = df.withColumn("at", F.when(F.col("turn") == 2, 2**40).otherwise(F.pmod(F.xxhash64("event_id", "turn"), F.lit(1000))))
    with replay(mixed, "at", steps=5) as stream:
        rows = appended(settle_by_deadline(stream, "10 minutes"))
    assert settled(rows) == OUTCOMES and rows.count() == len(OUTCOMES)


def test_keys_share_calls_and_state(spark):
    # large keys next to each other and one without a value, each with an answer, a timeout and a request cancelled too late
    keys = [2**60 + k for k in range(100)] + [-1, None]
    told = [("request", 1, 0), ("result", 1, 1), ("request", 2, 2), ("phase", 2, 3), ("request", 3, 4), ("cancel", 3, 5)]
    rows = [(k, r, kind, (1000 + 40 * at + n % 7) * SECOND, 10 * n + at) for n, k in enumerate(keys) for kind, r, at in told]
    rows.append((5, 1, "request", 9000 * SECOND, 9999))
    df = spark.createDataFrame(rows, MESSAGE).withColumn("ts", F.timestamp_micros("us"))
    with replay(df, "us", steps=3) as stream:
        got, progress = appended_with_progress(settle_by_deadline(stream, "1 second", buckets=4))
    want = {1: ("result", 40_000.0, True), 2: ("timeout", 20_000.0, False), 3: ("timeout", 20_000.0, False)}
    assert settled(got) == {(k, r): w for k in keys for r, w in want.items()} and got.count() == 3 * len(keys)
    assert progress and max(p["numRowsTotal"] for p in progress) <= 5


def test_a_batch_that_runs_again_gives_each_outcome_once(spark):
    from boxeval.session import checkpoint_root

    folder = work_folder(spark, "again")
    df = spark.createDataFrame(DEADLINES, MESSAGE).withColumn("ts", F.timestamp_micros("us"))
    with replay(df, "us", steps=3) as messages:
        stream = settle_by_deadline(messages, "1 second")

        def run(write):
            return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/p").trigger(availableNow=True).start()

        failed = []

        def breaks_off(batch, number):
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            if number == 1:
                failed.append(number)
                raise RuntimeError("lost after the rows were written, before the batch was committed")

        try:
            run(breaks_off).awaitTermination()
        except Exception:
            pass
        assert failed
        run(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")).awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    assert settled(rows) == OUTCOMES and rows.count() == len(OUTCOMES)
    assert folder.startswith(checkpoint_root(spark))
    remove_folder(spark, folder)


def test_repeats_within_and_outside_the_watermark(spark):
    rows = [(1, 1, 0), (1, 30, 1), (2, 100, 1), (1, 380, 4), (2, 110, 2), (3, 400, 2), (4, 5, 3), (5, 390, 3), (3, 401, 3)]
    df = spark.createDataFrame([(e, s * SECOND, step) for e, s, step in rows], "event_id bigint, us bigint, step int")
    with replay(df.withColumn("ts", F.timestamp_micros("us")), "step", bounds=[0, 1, 2, 3]) as stream:
        kept, progress = appended_with_progress(S.delivered_once(stream, "1 minute"))
    # id 1 comes again within a minute (dropped) and later (a message of its own); id 4 is behind the watermark
    assert sorted((r.event_id, r.us // SECOND) for r in kept.collect()) == [(1, 1), (1, 380), (2, 100), (3, 400), (5, 390)]
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 1
