"""Structured Streaming twins of the batch operators for data that arrives over time.

Every stream runs with ``availableNow`` here; on a cluster the same query runs with a processing-time
trigger. Aggregates are written per micro-batch with an idempotent overwrite of the batch folder, so a
retried batch replaces itself; the newest row per key is read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.operators.activity import RATE_LIMITS
from tabularium.operators.cleaning import TypePlan, normalize_names, strip_whitespace
from tabularium.session import new_scratch
from tabularium.streaming.stateful import LatestUpload, RequestLimiter, Sessions, with_rocks_db

PROGRESS_KEEP_HOURS, SESSION_GAP_SECONDS, LATENESS_SECONDS = 24, 3600, 3600
STATE_GROUPS = 1024  # groups of keys that share a call; a stream with very many keys takes more, so that a group's state stays small


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, kind: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def zoned(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; zone-free times are read as session time at the edge of the stream."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Run to the end of the available input with an exactly-once file sink, return what was written."""
    path, checkpoint = new_scratch(stream.sparkSession, label), new_scratch(stream.sparkSession, f"{label}-state")
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an updating aggregate; each batch overwrites its own folder, the newest row per key is returned."""
    spark = stream.sparkSession
    path, checkpoint = new_scratch(spark, label), new_scratch(spark, f"{label}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*")


def continuous_ingest(stream: DataFrame, types: TypePlan, tenant: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """New rows: strip, rename, drop empty rows, convert by a given type plan, stamp the tenant."""
    cleaned = normalize_names(strip_whitespace(stream))
    filled = cleaned.where(F.coalesce(*[F.col(c).cast("string") for c in cleaned.columns]).isNotNull())
    return tenant(types.apply(filled))


def _grouped(stream: DataFrame, key: str, groups: int):
    """The timed stream in ``groups`` groups of keys, the key as text beside the time in microseconds."""
    timed = stream.withColumns({"at": F.unix_micros("ts"), "name": F.col(key).cast("string"), "part": F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")})
    return with_rocks_db(timed.where("at IS NOT NULL")).drop(key).groupBy("part")


def latest_progress(stream: DataFrame, key: str, lateness: str = "1 hour", groups: int = STATE_GROUPS) -> DataFrame:
    """Latest upload state per resource with percent done; finished uploads are forgotten after a day of event time."""
    output = f"{key} string, event_id long, ts timestamp, status string, percent double, finished boolean"
    latest = _grouped(zoned(stream).withWatermark("ts", lateness), key, groups).transformWithStateInPandas(
        statefulProcessor=LatestUpload(key, PROGRESS_KEEP_HOURS * 3_600_000), outputStructType=output, outputMode="Update", timeMode="EventTime")
    return latest.withColumn(key, F.col(key).cast(stream.schema[key].dataType))


def daily_audit_counts(stream: DataFrame, dimensions: list[str], lateness: str = "2 days") -> DataFrame:
    """Counts per day and dimension values; rows may be late by ``lateness``."""
    timed = zoned(stream).withWatermark("ts", lateness)
    counted = timed.groupBy(F.window("ts", "1 day"), *dimensions).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *dimensions, "events")


def rate_limiter(stream: DataFrame, key: str, endpoint: str = "default", lateness_seconds: int = LATENESS_SECONDS, expire: bool = False) -> DataFrame:
    """``(key, event_id, allowed, late)``: a decision for every request, late ones included.

    A request more than ``lateness_seconds`` older than the newest one of its key is denied; one that is less late is judged by the
    requests allowed in the window before it. Requests without a time get no decision in a stream. ``expire`` forgets keys that
    were idle for window and lateness; such a stream needs a processing-time trigger, as it always has another batch to run.
    """
    limit, window = RATE_LIMITS.get(endpoint, RATE_LIMITS["default"])
    output = f"{key} {stream.schema[key].dataType.simpleString()}, event_id long, allowed boolean, late boolean"
    timed = with_rocks_db(stream.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("at IS NOT NULL"))
    idle = (window + lateness_seconds) * 1000 if expire else None
    limiter = RequestLimiter(key, limit, window * 1_000_000, lateness_seconds * 1_000_000, idle)
    return timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=limiter, outputStructType=output, outputMode="Append", timeMode="ProcessingTime" if expire else "None")


def idle_sessions(stream: DataFrame, key: str, gap_seconds: int = SESSION_GAP_SECONDS, lateness: str = "1 hour", groups: int = STATE_GROUPS) -> DataFrame:
    """``(key, session_start, session_end, events, open)`` as updates: a session is reported as it grows and when it closes.

    It closes when the watermark, ``lateness`` behind the newest row, is a gap past its last row. A row with no events says
    that the session of that start has become part of an earlier one.
    """
    output = f"{key} string, session_start timestamp, session_end timestamp, events long, open boolean"
    found = _grouped(zoned(stream).withWatermark("ts", lateness).select(key, "ts"), key, groups).transformWithStateInPandas(
        statefulProcessor=Sessions(key, gap_seconds * 1_000_000), outputStructType=output, outputMode="Update", timeMode="EventTime")
    return found.withColumn(key, F.col(key).cast(stream.schema[key].dataType))


def sliding_activity(stream: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Activity metrics of the last 24 hours, moved on by the hour."""
    timed = zoned(stream).withWatermark("ts", lateness)
    response, error = F.col("activity_type") == "response", F.col("activity_type") == "error"
    answered = F.count_if(response) + F.count_if(error)
    measured = timed.groupBy(F.window("ts", "24 hours", "1 hour"), *keys).agg(
        F.count(F.lit(1)).alias("activities"), F.count_if(response).alias("responses"), F.count_if(error).alias("errors"),
        F.when(answered > 0, F.count_if(response) / answered).otherwise(1.0).alias("success_rate"))
    return measured.select(F.col("window.end").alias("window_end"), *keys, "activities", "responses", "errors", "success_rate")


def drop_repeated_content(stream: DataFrame, content: Column) -> DataFrame:
    """First arrival of every content hash, however far apart copies arrive: the hashes are kept without expiry.

    The state is one hash per distinct content, spread over the shuffle partitions; long-lived streams keep it on disk
    with the RocksDB state store.
    """
    return stream.withColumn("content_hash", F.sha2(content, 256)).dropDuplicates(["content_hash"])
