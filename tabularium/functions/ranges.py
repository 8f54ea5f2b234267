"""Places of rows in their order, from ranges of about equal rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.lineage import settled
from tabularium.functions.skew import join_checked


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, total: str | None = None, parts: int | None = None) -> DataFrame:
    """Add ``name``, the place from 0 of a row among those of its ``keys`` by ``order``, and ``total``, the rows of the keys.

    Rows are ranged by sampled splitters over (keys, order), so ranges hold about equal rows and a key with any share of the rows lies
    in as many ranges as it needs, whatever its values are; equal rows are split by a running number. What travels between
    ranges is one row of counts for each (key, range). Null keys are a key, null order values come first.
    """
    columns = [f"`{c}`" for c in (*keys, *order)]
    ties = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = ties.repartitionByRange(*columns, "__tie") if parts is None else ties.repartitionByRange(parts, *columns, "__tie")
    ranged = ranged.sortWithinPartitions(*columns, "__tie").drop("__tie")
    # to_json keeps null keys apart from every text and gives one column to join by
    key = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = settled(ranged.withColumns({"__key": key, "__row": F.monotonically_increasing_id()}).withColumn("__part", F.shiftright("__row", 33)))
    counts = rows.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    group = Window.partitionBy("__key")
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    facts = [(before - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias("__total")]
    placed = join_checked(rows, counts.select("__key", "__part", *facts), ["__key", "__part"]).withColumn(name, F.col("__row") + F.col("__shift"))
    kept = [F.col(f"`{c}`") for c in (*df.columns, name)]
    return placed.select(*kept, *([F.col("__total").alias(total)] if total else []))
