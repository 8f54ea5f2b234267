"""Tamper evidence of a log: a Merkle tree for each time segment, its roots chained; all hashing stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabularium.functions.lineage import settled
from tabularium.functions.ranges import numbered

FANOUT = 256


def canonical_json(columns: Sequence[str]) -> Column:
    """JSON text of the row with sorted keys."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def leaves(log: DataFrame, id_col: str, ts: str = "ts", unit: str = "hour", parts: int | None = None) -> DataFrame:
    """``(id, segment, place, leaf)``: a leaf is the hash of a row's canonical JSON, placed in its segment by (time, id).

    ``unit`` is the length of a segment as ``date_trunc`` knows it; rows without a time are one segment. A segment with any
    share of the rows is numbered in many ranges.
    """
    hashed = log.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{ts}`").alias("__ts"), F.date_trunc(unit, f"`{ts}`").cast("timestamp_ntz").alias("segment"),
        F.sha2(canonical_json(log.columns), 256).alias("leaf")
    )
    return numbered(hashed, ["segment"], ["__ts", "id"], "place", parts=parts).select("id", "segment", "place", "leaf")


def tree(placed: DataFrame) -> DataFrame:
    """``(segment, level, place, hash)`` of all nodes above ``placed(segment, place, leaf)``.

    A node is the hash of up to 256 children joined in order, so every group is bounded; a level has 1/256 of the rows of
    the one below. Every segment is built to the height of the largest one.
    """
    below = placed.select("segment", "place", F.col("leaf").alias("hash"))
    top = below.agg(F.max("place")).first()[0]
    levels, level = [], 0
    while top is not None and (level == 0 or top > 0):
        children = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda c: c["hash"])
        below = below.groupBy("segment", F.floor(F.col("place") / FANOUT).alias("place")).agg(F.sha2(F.array_join(children, ""), 256).alias("hash"))
        level, top = level + 1, top // FANOUT
        below = settled(below)
        levels.append(below.select("segment", F.lit(level).alias("level"), "place", "hash"))
    if not levels:
        return below.select("segment", F.lit(0).alias("level"), "place", "hash").limit(0)
    nodes = levels[0]
    for one in levels[1:]:
        nodes = nodes.unionByName(one)
    return nodes


def roots(nodes: DataFrame) -> DataFrame:
    """``(segment, root)`` of every segment."""
    height = nodes.agg(F.max("level")).first()[0]
    return nodes.where(F.col("level") == F.lit(height)).select("segment", F.col("hash").alias("root"))


def chained(found: DataFrame) -> DataFrame:
    """``(segment, root, link)``: a link is the hash of the root and the link before it, so no segment can be dropped or swapped.

    The chain is one fold over one short row a segment, and that is all that has to be in order.
    """
    listed = found.agg(F.array_sort(F.collect_list(F.struct("segment", "root"))).alias("all"))
    start = F.array().cast("array<struct<segment:timestamp_ntz,root:string,link:string>>")

    def step(done: Column, now: Column) -> Column:
        last = F.coalesce(F.try_element_at(F.transform(done, lambda d: d["link"]), F.lit(-1)), F.lit(""))
        link = F.sha2(F.concat(now["root"], last), 256)
        return F.concat(done, F.array(F.struct(now["segment"].alias("segment"), now["root"].alias("root"), link.alias("link"))))

    return listed.select(F.explode(F.aggregate("all", start, step)).alias("s")).select("s.*")


def compare(sealed: DataFrame, current: DataFrame) -> DataFrame:
    """Status of every row of either: verified, changed, moved (another place), removed or added; by ``(segment, id)``."""
    now = current.select("segment", "id", F.col("place").alias("__place"), F.col("leaf").alias("__leaf"))
    keys = F.col("s.id").eqNullSafe(F.col("c.id")) & F.col("s.segment").eqNullSafe(F.col("c.segment"))
    joined = sealed.alias("s").join(now.alias("c"), keys, "full")
    status = (
        F.when(F.col("c.__leaf").isNull(), "removed").when(F.col("s.leaf").isNull(), "added").when(F.col("s.leaf") != F.col("c.__leaf"), "changed")
        .when(F.col("s.place") != F.col("c.__place"), "moved").otherwise("verified")
    )
    return joined.select(F.coalesce("s.segment", "c.segment").alias("segment"), F.coalesce("s.id", "c.id").alias("id"), status.alias("status"))


def segment_report(sealed: DataFrame, current: DataFrame) -> DataFrame:
    """For every segment the rows of each status, and whether its root still is the sealed one."""
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    counted = compare(sealed, current).groupBy("segment").agg(F.count(F.lit(1)).alias("total"), *map(n, ("verified", "changed", "moved", "removed", "added")))
    then, now = roots(tree(sealed)), roots(tree(current)).withColumnRenamed("root", "__now")
    both = then.alias("t").join(now.alias("n"), F.col("t.segment").eqNullSafe(F.col("n.segment")), "full")
    both = both.select(F.coalesce("t.segment", "n.segment").alias("__segment"), F.col("root").eqNullSafe(F.col("__now")).alias("intact"))
    return counted.join(both, F.col("segment").eqNullSafe(F.col("__segment")), "left").drop("__segment")


def inclusion_proofs(placed: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, segment, leaf, steps)`` for the rows of ``ids(id)``: the hashes left and right of the path, level by level.

    Only the runs that hold a wanted row are read into lists, 256 hashes each.
    """
    wanted = placed.join(F.broadcast(ids), "id").select("id", "segment", "place", "leaf")
    height = nodes.agg(F.max("level")).first()[0] or 0
    at = wanted.withColumn("steps", F.array().cast("array<struct<before:array<string>,after:array<string>>>")).withColumn("__at", F.col("place"))
    for level in range(height):
        below = placed.select("segment", "place", F.col("leaf").alias("hash")) if level == 0 else nodes.where(F.col("level") == level).drop("level")
        at = at.withColumn("__run", F.floor(F.col("__at") / FANOUT))
        runs = at.select(F.col("segment").alias("__s"), F.col("__run").alias("__r")).distinct()
        held = below.withColumn("__r", F.floor(F.col("place") / FANOUT)).alias("b").join(
            runs.alias("r"), F.col("segment").eqNullSafe(F.col("r.__s")) & (F.col("b.__r") == F.col("r.__r")), "inner")
        listed = held.groupBy("__s", F.col("b.__r").alias("__r")).agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("__all"))
        at = at.join(listed, F.col("segment").eqNullSafe(F.col("__s")) & (F.col("__run") == F.col("__r")))
        side = lambda keep: F.transform(F.filter("__all", keep), lambda c: c["hash"])
        step = F.struct(side(lambda c: c["place"] < F.col("__at")).alias("before"), side(lambda c: c["place"] > F.col("__at")).alias("after"))
        at = at.withColumn("steps", F.concat("steps", F.array(step))).withColumn("__at", F.col("__run")).drop("__run", "__s", "__r", "__all")
    return at.select("id", "segment", "leaf", "steps")


def folded_root(leaf: Column, steps: Column) -> Column:
    """Root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda now, s: F.sha2(F.concat(F.array_join(s["before"], ""), now, F.array_join(s["after"], "")), 256))


def swapped_pairs(placed: DataFrame, when: Column) -> DataFrame:
    """``placed`` with the places of two neighbours exchanged where ``when`` holds for one of them: a reordered log."""
    pair = W.partitionBy("segment", F.floor(F.col("place") / 2))
    swap = F.max(when.cast("int")).over(pair) * (F.count(F.lit(1)).over(pair) - 1) == 1
    return placed.withColumn("place", F.when(swap, F.col("place").bitwiseXOR(F.lit(1).cast("long"))).otherwise(F.col("place")))
