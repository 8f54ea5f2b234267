"""Selections, joins, aggregates, top-k and set operations over resources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

JOIN_TYPES = ("inner", "left", "right", "outer", "left_semi")


def sort_column(term: str) -> Column:
    """``"price desc"`` or ``"abs(price) desc"`` as a sort expression; ascending without a suffix."""
    text, _, direction = term.strip().rpartition(" ")
    if text and direction.lower() in ("asc", "desc"):
        return F.expr(text).desc() if direction.lower() == "desc" else F.expr(text).asc()
    return F.expr(term).asc()


def select_rows(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    where: Sequence[str] = (),
    order_by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Projection, AND-ed conditions, ORDER BY and LIMIT; every part is optional."""
    for condition in where:
        df = df.where(F.expr(condition))
    if order_by:
        df = df.orderBy(*[sort_column(t) for t in order_by])
    if limit:
        df = df.limit(limit)
    return df.selectExpr(*columns) if columns else df


def derive_field(df: DataFrame, name: str, calculation: str) -> DataFrame:
    return df.withColumn(name, F.expr(calculation))


def join_resources(
    sources: Mapping[str, DataFrame],
    conditions: Sequence[str],
    fields: Sequence[str],
    where: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """Chain joins over aliased sources; condition i joins source i+1.

    Conditions are SQL text over the aliases, so an equality may carry a range predicate with it.
    A missing condition is an error: a product of two resources is never built silently.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {JOIN_TYPES}")
    if len(conditions) != len(sources) - 1 or not all(conditions):
        raise ValueError("every joined resource needs its own join condition")
    aliased = [df.alias(name) for name, df in sources.items()]
    joined = aliased[0]
    for other, condition in zip(aliased[1:], conditions):
        joined = joined.join(other, F.expr(condition), how)
    if where:
        joined = joined.where(F.expr(where))
    return joined.selectExpr(*fields)


def keep_matching(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Rows with a partner in ``other`` (left semi join)."""
    return df.join(other, F.expr(on), "left_semi")


def coalesce_sources(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on ``key``; each shared field takes its first non-null value, left first."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    rest = [F.col(f"l.{c}") for c in left.columns if c not in (*shared, key)]
    rest += [F.col(f"r.{c}") for c in right.columns if c not in (*shared, key)]
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "outer")
    return joined.select(
        F.coalesce(f"l.{key}", f"r.{key}").alias(key),
        *[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in shared],
        *rest,
    )


def aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    aggregations: Mapping[str, str],
    where: Sequence[str] = (),
    having: Sequence[str] = (),
) -> DataFrame:
    """GROUP BY with {alias: SQL aggregate}, WHERE before and HAVING (on aliases) after."""
    for condition in where:
        df = df.where(F.expr(condition))
    grouped = df.groupBy(*[F.expr(g) for g in group_by])
    result = grouped.agg(*[F.expr(e).alias(a) for a, e in aggregations.items()])
    for condition in having:
        result = result.where(F.expr(condition))
    return result


def top_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows per key; the rank filter prunes inside map tasks before the shuffle."""
    ranking = W.partitionBy(*keys).orderBy(*[sort_column(t) for t in order_by])
    return df.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    return top_per_group(df, keys, [f"{version} desc"], 1).drop("rank")


def keyset_page(df: DataFrame, key: str, after, size: int, ascending: bool = True) -> DataFrame:
    """Next ``size`` rows beyond the cursor value ``after`` (None: first page)."""
    if after is not None:
        df = df.where(F.col(key) > F.lit(after) if ascending else F.col(key) < F.lit(after))
    return df.orderBy(F.col(key).asc() if ascending else F.col(key).desc()).limit(size)


def union_distinct(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result.distinct()


def union_aligned(*frames: DataFrame) -> DataFrame:
    """Stack rows by column name; columns missing in a source become null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
