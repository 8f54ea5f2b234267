"""Intermediate tables that every executor can read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabularium.session import scratch_root


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, partition by partition, into the shared folder of ``spark.checkpoint.dir``; lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()
