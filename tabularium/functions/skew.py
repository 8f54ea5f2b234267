"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 20_000


def bounded_local(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local relation if it has at most ``max_rows`` rows, else ``None``.

    The check reads one row more than the bound, so what reaches the driver never exceeds it.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def join_checked(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join per-key facts onto rows: broadcast when proven small, salted shuffle join beyond that."""
    local = bounded_local(small, max_rows)
    if local is not None:
        return big.join(F.broadcast(local), on, how)
    return salted_join(big, small, on, how)


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Spread every key of ``big`` over ``salts`` tasks; ``small`` (one row per key) is repeated."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep rows of the left side can be salted")
    hashable = [f.name for f in big.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashable]), F.lit(salts)).cast("int")
    left = big.withColumn("__salt", salt)
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")
