"""Partitioned stores: JSON documents by version, chunks by resource, audit days, activity exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.time import day_key
from tabularium.operators.activity import recent_activity


def upsert_documents(current: DataFrame, incoming: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Insert or replace by key: the last incoming row of a key wins over the stored one.

    Winners are picked by a max aggregate, so replays of one key are combined before the shuffle.
    """
    rest = [c for c in current.columns if c not in keys]
    both = current.select(*keys, F.lit(0).alias("__new"), F.lit(None).cast("long").alias("__order"), F.struct(*rest).alias("__row"))
    both = both.unionByName(incoming.select(*keys, F.lit(1).alias("__new"), order.cast("long").alias("__order"), F.struct(*rest).alias("__row")))
    newest = both.groupBy(*keys).agg(F.max_by("__row", F.struct("__new", "__order")).alias("__row"))
    return newest.select(*keys, "__row.*")


def write_document_store(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_chunks(chunks: DataFrame, path: str, partition: str = "resource_id") -> None:
    """Append chunk rows below one folder per resource.

    Rows are clustered by resource and hash, so a large resource is written by several tasks.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in chunks.columns if c != partition]), F.lit(8))
    chunks.repartition(partition, part).write.mode("append").partitionBy(partition).parquet(path)


def write_audit_days(log: DataFrame, path: str) -> None:
    """Audit rows as JSON lines in one folder per day."""
    log.withColumn("day", day_key("ts")).write.mode("append").partitionBy("day").json(path)


def read_audit_days(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)


def export_activities(activity: DataFrame, path: str, as_of: Column, hours: int | None) -> None:
    """Activities of the last hours (or all) as JSON lines."""
    chosen = activity if hours is None else recent_activity(activity, as_of, hours)
    chosen.write.json(path)
