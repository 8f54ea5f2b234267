"""Ordered operators (previous row, running maximum, position) that never sort one key in one task.

Every helper cuts the order column into slices of a fixed width. Rows are sorted inside
(key, slice), and only one summary row per slice travels along the key, so a key that holds a
third of all rows is spread over as many tasks as it has slices. Null keys are a key of their own;
null order values come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.functions.time import epoch_seconds

SLICE = "__slice"


def slice_id(df: DataFrame, order: str, width: float) -> Column:
    """Slice number of a time column (width in seconds) or a numeric column (width in its unit)."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(epoch_seconds(order) / F.lit(width)).cast("long")
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def _join_slices(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join of slice facts on columns that may be null."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    condition = [F.col(f"`{c}`").eqNullSafe(F.col(f"`__r_{c}`")) for c in on]
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], width: float, ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``new -> previous value of old`` for ``values`` = {new: old}, per key in (order, ties)."""
    carried = F.struct(*[F.col(old).alias(new) for new, old in values.items()])
    sliced = df.withColumn(SLICE, slice_id(df, order, width))
    inside = W.partitionBy(*keys, SLICE).orderBy(order, *ties)
    sliced = sliced.withColumns({
        "__prev": F.lag(carried).over(inside),
        "__first": F.row_number().over(inside) == 1,
    })
    tails = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.max_by(carried, F.struct(F.col(order).isNotNull(), order, *ties)).alias("__tail"))
        .withColumn("__carry", F.lag("__tail").over(W.partitionBy(*keys, F.lit(0)).orderBy(SLICE)))
        .drop("__tail")
    )
    joined = _join_slices(sliced, tails, [*keys, SLICE], "left")
    previous = F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__prev"))
    return (
        joined.withColumn("__prev", previous)
        .withColumns({new: F.col(f"__prev.{new}") for new in values})
        .select(*df.columns, *values)
    )


def with_running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, width: float, ties: Sequence[str] = ()
) -> DataFrame:
    """Add the largest non-null ``value`` seen so far per key."""
    sliced = df.withColumn(SLICE, slice_id(df, order, width))
    inside = W.partitionBy(*keys, SLICE).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*keys, F.lit(0)).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.max(value).alias("__top"))
        .withColumn("__carry", F.max("__top").over(earlier))
        .drop("__top")
    )
    return (
        _join_slices(sliced.withColumn("__run", F.max(value).over(inside)), carry, [*keys, SLICE], "left")
        .withColumn(name, F.greatest("__run", "__carry"))
        .select(*df.columns, name)
    )


def with_position(df: DataFrame, order: str, ties: Sequence[str], name: str, width: float) -> DataFrame:
    """Add the 1-based position of each row in the global (order, ties) sort.

    Slice counts are summed in two levels: inside blocks of slices, then over the few blocks.
    """
    block = 1024
    sliced = df.withColumn(SLICE, slice_id(df, order, width))
    counts = (
        sliced.groupBy(SLICE)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__block", F.floor(F.col(SLICE) / block))
    )
    before = W.partitionBy("__block").orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    blocks = counts.groupBy("__block").agg(F.sum("__n").alias("__total"))
    block_before = W.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("__block", F.coalesce(F.sum("__total").over(block_before), F.lit(0)).alias("__base"))
    offsets = (
        counts.withColumn("__in", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .transform(lambda c: _join_slices(c, blocks, ["__block"], "inner"))
        .select(SLICE, (F.col("__in") + F.col("__base")).alias("__offset"))
    )
    return (
        _join_slices(sliced.withColumn("__row", F.row_number().over(W.partitionBy(SLICE).orderBy(order, *ties))), offsets, [SLICE], "inner")
        .withColumn(name, F.col("__offset") + F.col("__row"))
        .select(*df.columns, name)
    )


def with_trailing_count(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str
) -> DataFrame:
    """Add the number of rows of the key in the last ``seconds`` up to and including the row's second.

    A slice is ``seconds`` long. It starts with the rows of the slice before it, each of which leaves again ``seconds``
    after its own second, so the count is one running sum. What a slice hands on is counted per second first. Rows without
    a time are peers of each other only.
    """
    own = df.withColumn("__sec", F.floor(epoch_seconds(ts)).cast("long")).withColumn(SLICE, F.floor(F.col("__sec") / seconds))
    marks = F.array(
        F.struct(((F.col(SLICE) + 1) * seconds).alias("sec"), F.lit(1).alias("sign")),
        F.struct((F.col("__sec") + seconds).alias("sec"), F.lit(-1).alias("sign")))
    handed = (
        own.where("__sec IS NOT NULL").select(*[F.col(f"`{k}`") for k in keys], (F.col(SLICE) + 1).alias(SLICE), F.explode(marks).alias("__mark"))
        .groupBy(*[F.col(f"`{k}`") for k in keys], SLICE, F.col("__mark.sec").alias("__sec")).agg(F.sum("__mark.sign").alias("__change"))
    )
    changes = own.withColumns({"__change": F.lit(1).cast("long"), "__own": F.lit(True)}).unionByName(handed, allowMissingColumns=True)
    running = W.partitionBy(*keys, SLICE).orderBy("__sec").rangeBetween(W.unboundedPreceding, W.currentRow)
    return changes.withColumn(name, F.sum("__change").over(running)).where("__own").select(*df.columns, name)
