"""Request lifecycles and latency windows on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.bindings import requests, runs
from boxeval.operators.distribution import distribution
from boxeval.queries.registry import query
from boxeval.queries.views import REQUESTS, RUNS
from boxeval.session import cut
from boxeval.streaming import lifecycle as S
from boxeval.streaming.deadlines import settle_by_deadline
from boxeval.streaming.sinks import appended, appended_with_progress, final_state, remove_folder, replay, work_folder

_KEY = ["key", "request_id"]


_LIFE = f"""WITH {REQUESTS}, told AS (SELECT key, request_id AS id, kind AS what, us, event_id FROM requests
  UNION ALL SELECT key, request_id - 1, 'superseded', us, event_id FROM requests WHERE kind = 'request' AND request_id > 1),
ends AS (SELECT key, id, what, us FROM (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY us, event_id) AS n FROM told WHERE what IN ('result', 'error', 'cancel', 'superseded')) WHERE n = 1),
counts AS (SELECT key, id, min(us) FILTER (WHERE what = 'request') AS opened, count(*) FILTER (WHERE what IN ('result', 'error')) AS answers, count(*) FILTER (WHERE what = 'phase') AS phases FROM told GROUP BY key, id),
life AS (SELECT c.key, c.id AS request_id, coalesce(CASE e.what WHEN 'cancel' THEN 'aborted' ELSE e.what END, 'pending') AS outcome, (e.us - c.opened) / 1000 AS elapsed_ms, phases,
  answers - CASE WHEN e.what IN ('result', 'error') THEN 1 ELSE 0 END AS rejected FROM counts c LEFT JOIN ends e ON e.key = c.key AND e.id = c.id WHERE c.opened IS NOT NULL)"""


def _life(spark: SparkSession, sf: str) -> DataFrame:
    with replay(requests(spark, sf), "us") as messages:
        return final_state(S.lifecycle(messages), _KEY)


@query("t1_request_lifecycle", f"{_LIFE} SELECT key, request_id, outcome, elapsed_ms, phases, rejected FROM life")
def request_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return _life(spark, sf)


@query("t2_latest_wins", f"{_LIFE} SELECT key, request_id, elapsed_ms FROM life WHERE outcome = 'superseded'")
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return _life(spark, sf).where(F.col("outcome") == "superseded").select(*_KEY, "elapsed_ms")


@query("t3_cancel_suppresses", f"{_LIFE} SELECT key, request_id, elapsed_ms, rejected FROM life WHERE outcome = 'aborted'")
def cancel_suppresses(spark: SparkSession, sf: str) -> DataFrame:
    return _life(spark, sf).where(F.col("outcome") == "aborted").select(*_KEY, "elapsed_ms", "rejected")


_STALE = f"""WITH {REQUESTS}, told AS (SELECT key, CASE WHEN kind = 'cancel' THEN latest ELSE request_id END AS id, kind, us, event_id FROM requests
  UNION ALL SELECT key, request_id - 1, 'superseded', us, event_id FROM requests WHERE kind = 'request' AND request_id > 1),
opened AS (SELECT key, id, min(us) AS opened FROM told WHERE kind = 'request' GROUP BY key, id),
ends AS (SELECT key, id, arg_min(kind, (us, event_id)) AS kind, min(us) AS us FROM told WHERE kind IN ('result', 'error', 'cancel', 'superseded') GROUP BY key, id)
SELECT e.key, e.id AS request_id, (e.us - o.opened) / 1000 AS elapsed_ms FROM ends e JOIN opened o ON o.key = e.key AND o.id = e.id WHERE e.kind = 'cancel'"""


@query("t6_stale_on_context_change", _STALE)
def stale_on_context_change(spark: SparkSession, sf: str) -> DataFrame:
    """Cancels stand for changes of the shown page, which concern the request that is current."""
    changes = F.when(F.col("kind") == "cancel", F.lit("context")).otherwise(F.col("kind"))
    with replay(requests(spark, sf).withColumn("kind", changes), "us") as messages:
        settled = final_state(S.stale_requests(messages), _KEY)
    return settled.where(F.col("outcome") == "aborted").select(*_KEY, "elapsed_ms")


@query(
    "t8_cold_flag_stream",
    f"""WITH {REQUESTS}, ready AS (SELECT key % 10 AS worker, min((us, event_id)) AS at FROM requests WHERE kind IN ('result', 'error') GROUP BY worker)
    SELECT q.key % 10 AS worker, q.key, q.request_id, coalesce((q.us, q.event_id) < r.at, true) AS cold
    FROM requests q LEFT JOIN ready r ON r.worker = q.key % 10 WHERE q.kind = 'request'""",
)
def cold_flag_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Ten workers serve the keys; one is cold until it has answered for the first time."""
    asked = requests(spark, sf).withColumn("worker", F.pmod("key", F.lit(10)))
    with replay(asked, "us") as messages:
        ready = final_state(S.first_answers(messages), ["worker"])
    opened = asked.where(F.col("kind") == "request")
    cold = F.coalesce(F.struct("us", "event_id") < F.col("ready"), F.lit(True))
    return opened.join(ready, "worker", "left").select("worker", *_KEY, cold.alias("cold"))


@query(
    "t5_status_of_key",
    f"""WITH {REQUESTS}, newest AS (SELECT key, max(request_id) AS id FROM requests WHERE kind = 'request' GROUP BY key),
    own AS (SELECT r.key, r.kind, r.detail, r.us, r.event_id FROM requests r JOIN newest n ON n.key = r.key AND n.id = r.request_id),
    ended AS (SELECT key, arg_min({{'kind': kind, 'detail': detail}}, (us, event_id)) AS e FROM own WHERE kind IN ('result', 'error', 'cancel') GROUP BY key),
    begun AS (SELECT key, arg_max({{'kind': kind, 'detail': detail}}, (us, event_id)) AS p FROM own WHERE kind IN ('request', 'phase') GROUP BY key)
    SELECT k.key, CASE WHEN n.key IS NULL THEN 'idle' WHEN e.kind = 'cancel' THEN 'cancelled' WHEN e.kind = 'error' THEN 'error' WHEN e.kind = 'result' AND e.detail = 'no-board' THEN 'no-board'
      WHEN e.kind = 'result' THEN 'done' WHEN p.kind = 'phase' THEN p.detail ELSE 'capturing' END AS status
    FROM (SELECT DISTINCT key FROM requests) k LEFT JOIN newest n USING (key) LEFT JOIN ended USING (key) LEFT JOIN begun USING (key)""",
)
def status_of_key(spark: SparkSession, sf: str) -> DataFrame:
    with replay(requests(spark, sf), "us") as messages:
        return S.status_of_key(final_state(S.state_of_request(messages), _KEY))


@query(
    "t7_quarantine_stream",
    f"""WITH {REQUESTS} SELECT reasons, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN request_id - 1 <= 0 THEN 'request-id' END, CASE WHEN kind = 'phase' THEN 'kind' END,
      CASE WHEN ms - 5 < 0 THEN 'duration' END) AS reasons FROM requests) GROUP BY reasons""",
)
def quarantine_stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = requests(spark, sf).select(
        "event_id",
        "key",
        "us",
        (F.col("request_id") - 1).alias("request_id"),
        F.when(F.col("kind") == "phase", F.lit("noise")).otherwise(F.col("kind")).alias("kind"),
        (F.col("ms") - 5).alias("ms"),
    )
    folder = work_folder(spark, "quarantine")
    with replay(raw, "us") as messages:
        run = S.split_sinks(messages, f"{folder}/good", f"{folder}/bad", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    good = spark.read.parquet(f"{folder}/good").select(F.lit("").alias("reasons"))
    bad = spark.read.parquet(f"{folder}/bad").select(F.array_join("reasons", ",").alias("reasons"))
    counts = cut(good.unionByName(bad).groupBy("reasons").agg(F.count("*").alias("n")))
    remove_folder(spark, folder)
    return counts


@query(
    "t9_latency_windows",
    f"""WITH {RUNS} SELECT day, engine, count(ms) AS count, min(ms) AS min, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS max FROM runs GROUP BY day, engine""",
)
def latency_windows(spark: SparkSession, sf: str) -> DataFrame:
    with replay(runs(spark, sf).select("ts", "engine", "ms"), "ts") as source:
        counts = final_state(S.value_counts(source, ["engine"], "ms", "1 day", "1 day"), ["start", "engine", "value"])
    daily = counts.withColumn("day", F.date_format("start", "yyyy-MM-dd"))
    return distribution(daily, ["day", "engine"], "value", weight="n")


@query("t10_late_rejected", f"{_LIFE} SELECT key, CAST(sum(rejected) AS BIGINT) AS rejected FROM life GROUP BY key HAVING sum(rejected) > 0")
def late_rejected(spark: SparkSession, sf: str) -> DataFrame:
    summed = _life(spark, sf).groupBy("key").agg(F.sum("rejected").alias("rejected"))
    return summed.where(F.col("rejected") > 0)


_HOUR = 3_600_000_000
#: Test messages of a key lie hours apart: messages may be a day late, and a request without any for two days is told.
_LATE, _IDLE = "1 day", "2 days"
_SESSIONS = f"""WITH {REQUESTS}, told AS (SELECT key, request_id AS id, kind AS what, us, event_id FROM requests
  UNION ALL SELECT key, request_id - 1, 'superseded', us, event_id FROM requests WHERE kind = 'request' AND request_id > 1),
starts AS (SELECT *, us - lag(us) OVER (PARTITION BY key, id ORDER BY us, event_id) > {48 * _HOUR} AS apart FROM told),
sessions AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY key, id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS w FROM starts),
over AS (SELECT key, id, w, max(us) AS last FROM sessions GROUP BY key, id, w),
ended AS (SELECT key, id, w FROM over WHERE last + {48 * _HOUR} <= (SELECT max(us) // 1000 * 1000 - {24 * _HOUR} FROM requests)),
ends AS (SELECT key, id, w, what, us FROM (SELECT *, row_number() OVER (PARTITION BY key, id, w ORDER BY us, event_id) AS n FROM sessions WHERE what IN ('result', 'error', 'cancel', 'superseded')) WHERE n = 1),
counts AS (SELECT key, id, w, min(us) FILTER (WHERE what = 'request') AS opened, count(*) FILTER (WHERE what IN ('result', 'error')) AS answers, count(*) FILTER (WHERE what = 'phase') AS phases FROM sessions GROUP BY key, id, w),
life AS (SELECT c.key, c.id AS request_id, coalesce(CASE e.what WHEN 'cancel' THEN 'aborted' ELSE e.what END, 'pending') AS outcome, (e.us - c.opened) / 1000 AS elapsed_ms, phases,
  answers - CASE WHEN e.what IN ('result', 'error') THEN 1 ELSE 0 END AS rejected FROM counts c JOIN ended USING (key, id, w) LEFT JOIN ends e USING (key, id, w) WHERE c.opened IS NOT NULL)"""


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    with replay(requests(spark, sf), "us") as messages:
        return appended(S.expiring_lifecycle(messages, _LATE, _IDLE))


@query("t1_expiring_lifecycle", f"{_SESSIONS} SELECT key, request_id, outcome, elapsed_ms, phases, rejected FROM life")
def expiring_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """As T1 on an endless stream: requests are told once, when nothing more can come for them, and leave the state."""
    return _sessions(spark, sf)


@query("t2_expiring_latest_wins", f"{_SESSIONS} SELECT key, request_id, elapsed_ms FROM life WHERE outcome = 'superseded'")
def expiring_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).where(F.col("outcome") == "superseded").select(*_KEY, "elapsed_ms")


@query("t3_expiring_cancel_suppresses", f"{_SESSIONS} SELECT key, request_id, elapsed_ms, rejected FROM life WHERE outcome = 'aborted'")
def expiring_cancel_suppresses(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).where(F.col("outcome") == "aborted").select(*_KEY, "elapsed_ms", "rejected")


_COLD_HOURS, _WARM_HOURS = 24, 8


@query(
    "t4_expire_requests",
    f"""WITH {REQUESTS}, opened AS (SELECT key, request_id, min(us) AS opened FROM requests WHERE kind = 'request' GROUP BY key, request_id),
    ends AS (SELECT o.key, o.request_id, o.opened, arg_min(r.kind, (r.us, r.event_id)) AS what, min(r.us) AS us FROM opened o LEFT JOIN requests r
      ON r.key = o.key AND r.request_id = o.request_id AND r.us >= o.opened AND r.kind IN ('result', 'error', 'cancel') GROUP BY ALL),
    first AS (SELECT key, min(us) AS warm FROM ends WHERE what <> 'cancel' AND us - opened <= {_COLD_HOURS * _HOUR} GROUP BY key),
    due AS (SELECT e.*, coalesce(warm >= opened, true) AS cold, opened + CASE WHEN coalesce(warm >= opened, true) THEN {_COLD_HOURS * _HOUR} ELSE {_WARM_HOURS * _HOUR} END AS deadline
      FROM ends e LEFT JOIN first USING (key)),
    settled AS (SELECT key, request_id, cold, opened, coalesce(us <= deadline, false) AS intime, CASE WHEN coalesce(us <= deadline, false) THEN us ELSE deadline END AS done_us, what FROM due)
    SELECT key, request_id, CASE WHEN NOT intime THEN 'timeout' WHEN what = 'cancel' THEN 'aborted' ELSE what END AS outcome, (done_us - opened) / 1000 AS elapsed_ms, cold
    FROM settled WHERE (done_us + 999) // 1000 <= (SELECT max(us) // 1000 - {24 * _HOUR // 1000} FROM requests)""",
)
def expire_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Deadlines of a day until a key's first completion, and of eight hours from then on."""
    with replay(requests(spark, sf), "us") as messages:
        return appended(settle_by_deadline(messages, _LATE, _COLD_HOURS * 3600, _WARM_HOURS * 3600))


_SENT = f"""WITH {REQUESTS}, bounds AS (SELECT min(us) AS low, (max(us) - min(us)) // 3 AS third FROM requests),
own AS (SELECT event_id, kind, us, least((us - low) // third, 2) AS step FROM requests, bounds),
sent AS (SELECT event_id, kind, us, step, 0 AS again FROM own
  UNION ALL SELECT event_id, kind, us + CASE event_id % 3 WHEN 0 THEN {_HOUR} ELSE {72 * _HOUR} END, step + 1, 1 FROM own WHERE event_id % 3 < 2
  UNION ALL SELECT event_id, kind, us, 3, 2 FROM own WHERE event_id % 7 = 0)"""


@query(
    "t10_repeated_and_late",
    f"""{_SENT}, newest AS (SELECT step + 1 AS step, max(max(us)) OVER (ORDER BY step) // 1000 * 1000 - {24 * _HOUR} AS mark FROM sent GROUP BY step),
    timely AS (SELECT s.*, n.mark FROM sent s LEFT JOIN newest n ON n.step = s.step LEFT JOIN newest p ON p.step = s.step - 1 WHERE p.mark IS NULL OR s.us > p.mark),
    kept0 AS (SELECT event_id, kind, min(us) AS us, step FROM timely WHERE again = 0 GROUP BY ALL),
    kept1 AS (SELECT t.event_id, t.kind, t.us, t.step FROM timely t LEFT JOIN kept0 k ON k.event_id = t.event_id LEFT JOIN newest n ON n.step = t.step - 1
      WHERE t.again = 1 AND (k.event_id IS NULL OR k.us + {24 * _HOUR} <= coalesce(n.mark, 0))),
    kept2 AS (SELECT t.event_id, t.kind, t.us, t.step FROM timely t LEFT JOIN newest n ON n.step = t.step - 1 WHERE t.again = 2
      AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM kept0 UNION ALL SELECT * FROM kept1) k WHERE k.event_id = t.event_id AND (k.step = t.step OR k.us + {24 * _HOUR} > coalesce(n.mark, 0)))),
    kept AS (SELECT kind FROM kept0 UNION ALL SELECT kind FROM kept1 UNION ALL SELECT kind FROM kept2)
    SELECT kind, count(*) AS n FROM kept GROUP BY kind
    UNION ALL SELECT 'late', (SELECT count(*) FROM sent) - (SELECT count(*) FROM timely)
    UNION ALL SELECT 'repeated', (SELECT count(*) FROM timely) - (SELECT count(*) FROM kept)""",
)
def repeated_and_late(spark: SparkSession, sf: str) -> DataFrame:
    """Messages are sent in three steps, some again an hour or three days after, and some once more at the very end."""
    own = cut(requests(spark, sf).select("event_id", "kind", "us"))
    low, high = own.agg(F.min("us"), F.max("us")).first()
    third = max(((high or 0) - (low or 0)) // 3, 1)
    own = own.withColumn("step", F.least(F.floor((F.col("us") - (low or 0)) / third), F.lit(2)))
    again = F.when(F.col("event_id") % 3 == 0, F.lit(_HOUR)).otherwise(F.lit(72 * _HOUR))
    sent = own.unionByName(own.where(F.col("event_id") % 3 < 2).withColumns({"us": F.col("us") + again, "step": F.col("step") + 1}))
    sent = sent.unionByName(own.where(F.col("event_id") % 7 == 0).withColumn("step", F.lit(3).cast("bigint")))
    sent = cut(sent.withColumn("ts", F.timestamp_micros("us")))
    with replay(sent, "step", bounds=[0, 1, 2]) as messages:
        kept, progress = appended_with_progress(S.delivered_once(messages, _LATE).select("kind"))
    late = sum(p["numRowsDroppedByWatermark"] for p in progress)
    counts = kept.groupBy("kind").agg(F.count("*").alias("n"))
    rest = [("late", late), ("repeated", sent.count() - kept.count() - late)]
    return counts.unionByName(spark.createDataFrame(rest, "kind string, n bigint"))
