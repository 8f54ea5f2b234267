"""Streams against their batch twins."""

import pandas as pd
from pyspark.sql import functions as F

from tabularium.operators import activity
from tabularium.plans import REGISTRY
from tabularium.session import new_scratch
from tabularium.streaming import streams
from tabularium.streaming.stateful import LatestUpload, Sessions
from tests.conftest import FOLDER
from tests.oracle import compare, connect


def test_rate_limiter_equals_batch(spark, tables):
    streamed = REGISTRY["stream_rate_limit"].run(spark, FOLDER)
    assert streamed.where("late").count() == 0
    streamed = streamed.drop("late")
    batch = activity.rate_limit(tables.events.select("event_type", "ts", "event_id"), ["event_type"], "streaming")
    assert streamed.count() == tables.events.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_streamed_results_equal_sql(spark):
    con = connect(FOLDER)
    for name in ("stream_ingest", "stream_upload_progress", "stream_audit_counts", "stream_sessions", "stream_distinct_content"):
        ok, note = compare(spark, con, name, FOLDER)
        assert ok, f"{name}: {note}"


def test_streamed_sessions_are_batch_sessions(spark, tables):
    batch = activity.sessions(tables.events.select("user_id", "ts", "event_id"), "user_id", 3600, 86_400)
    batch = batch.select("user_id", F.col("session_start").cast("string"), F.col("session_end").cast("string"), "events")
    streamed = REGISTRY["stream_sessions"].run(spark, FOLDER).select("user_id", "session_start", "session_end", "events")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def arriving(spark, label, batches):
    """A stream of one file for each list of (key, seconds, id)."""
    path, schema = new_scratch(spark, label), "k string, ts timestamp_ntz, event_id long"
    for rows in batches:
        made = spark.createDataFrame(rows, "k string, s long, event_id long")
        made.select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_id").coalesce(1).write.mode("append").parquet(path)
    return streams.file_stream(spark, path, spark.read.schema(schema).parquet(path).schema, files_per_batch=1)


def test_late_requests_get_a_decision(spark):
    batches = [[("a", 1000 + i, i) for i in range(7)] + [("b", 5000, 20)], [("a", 1500, 30), ("a", 1003, 31), ("b", 4990, 21)], [("b", 1300, 22), ("b", 5001, 23), ("a", 990, 32)]]
    got = streams.run_append(streams.rate_limiter(arriving(spark, "late", batches), "k", "streaming"), "late-out")
    rows = {r["event_id"]: (r["allowed"], r["late"]) for r in got.collect()}
    assert len(rows) == 14 and [rows[i] for i in range(7)] == [(True, False)] * 5 + [(False, False)] * 2
    assert rows[30] == (True, False) and rows[31] == (True, True)  # four allowed ones in the window before 1003
    assert rows[32] == (True, True) and rows[21] == (True, True) and rows[23] == (True, False)
    assert rows[22] == (False, True)  # more than an hour behind the newest


def test_sessions_merge_and_stay_open(spark):
    batches = [[("a", 10_000, 1), ("a", 18_000, 2), ("b", 10_000, 3)], [("a", 14_000, 4), ("b", 17_000, 6), ("a", 15_000, 7)], [("c", 40_000, 8), ("b", 39_000, 9)]]
    updates = streams.run_updates(streams.idle_sessions(arriving(spark, "gaps", batches), "k", gap_seconds=4500), "gaps-out", ["k", "session_start"])
    got = sorted((r["k"], r["session_start"].timestamp(), r["session_end"].timestamp(), r["events"], r["open"]) for r in updates.where("events > 0").collect())
    utc = [(k, a, b, n, o) for k, a, b, n, o in got]
    assert utc == [("a", 10_000, 18_000, 4, False), ("b", 10_000, 10_000, 1, False), ("b", 17_000, 17_000, 1, False), ("b", 39_000, 39_000, 1, True), ("c", 40_000, 40_000, 1, True)]


def test_copies_far_apart_are_dropped(spark):
    path, schema = new_scratch(spark, "far"), "doc_id long, text string, ts timestamp_ntz"
    for day, text in ((0, "a"), (100, "b"), (200, "c"), (300, "a"), (400, None), (900, None)):
        rows = spark.createDataFrame([(day, text)], "doc_id long, text string")
        rows.withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(int(doc_id), 0, 0, 0)")).coalesce(1).write.mode("append").parquet(path)
    stream = streams.file_stream(spark, path, spark.read.schema(schema).parquet(path).schema, files_per_batch=1)
    kept = streams.run_append(streams.drop_repeated_content(stream, F.col("text")), "far-kept")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 100, 200, 400]


class Handle:
    """Counts what a processor asks of its state."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_group_of_keys_costs_a_few_state_calls(spark):
    handle, many = Handle(), [str(i) for i in range(500)]
    sessions = Sessions("k", 60_000_000)
    sessions.init(handle)
    frames = [pd.DataFrame({"name": [*many, None], "at": [i * 1_000_000 for i in range(501)]}), pd.DataFrame({"name": [*many[:2], "0"], "at": [30_000_000, 500_000_000, 90_000_000]})]
    out = pd.concat(sessions.handleInputRows((0,), iter(frames), handle))
    assert handle.calls == 3 and len(handle.timers) == 1 and len(out) == 503 and out["events"].sum() == 504
    assert sorted(out.loc[out["k"] == "0", "events"]) == [1, 2] and out["k"].isna().sum() == 1
    handle, uploads = Handle(), LatestUpload("k", 1000)
    uploads.init(handle)
    frame = pd.DataFrame({"name": [*many, "7"], "at": [5] * 500 + [6], "event_id": range(501), "status": ["completed"] * 501, "uploaded_bytes": 1.0, "total_bytes": 2.0})
    out = pd.concat(uploads.handleInputRows((0,), iter([frame]), handle))
    assert handle.calls == 3 and len(handle.timers) == 1 and len(out) == 500 and out.loc[out["k"] == "7", "event_id"].tolist() == [500]


def test_requests_of_a_batch_are_decided_in_time_order(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        rows = [("a", 1000 + 7 * (i * 37 % 300), i) for i in range(300)]  # in no order, and fifteen frames of one batch
        got = streams.run_append(streams.rate_limiter(arriving(spark, "frames", [rows]), "k", "streaming"), "frames-out").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    in_time = sorted(rows, key=lambda r: r[1:])
    allowed = activity.limit_decisions([r[1] for r in in_time], 5, 60)
    assert {r["event_id"]: (r["allowed"], r["late"]) for r in got} == {r[2]: (a, False) for r, a in zip(in_time, allowed)}
