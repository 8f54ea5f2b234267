"""Lineage cuts shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.session import scratch_root


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder (``spark.checkpoint.dir``), lineage cut.

    Every executor can read the files, so the loss of one loses no rows. Spark removes them with the frame
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str) -> Column:
    """128-bit key of a text column; null and empty texts share one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))
