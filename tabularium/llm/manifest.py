"""Merkle manifest of a dataset: 16-way SHA-256 trees with inclusion proofs, folded from copied hash states."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabularium.functions.skew import join_checked
from tabularium.llm.common import cut

FANOUT = 16
TIER = 3  # levels of the tree that one task folds at a time: a block holds FANOUT ** TIER nodes
BLOCK = FANOUT**TIER

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIDES = "array<struct<left:string,right:string>>"
PATHS = f"grp string, pos long, subroot string, upper {SIDES}"
RESULT = "leaf string, subroot string, root string, proof_sha256 string, n_siblings long, folded_root string, verified boolean"


def field_code(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the fields' codes, one after the other."""
    return F.sha2(F.concat(*[field_code(c) for c in columns]), 256)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, _UPPER, _UPPER.lower())


class Parent:
    """One node over its children: its digest, and the hash state before each child slot."""

    def __init__(self, children: list[str]) -> None:
        self.children = children
        self.states = []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def siblings(self, slot: int) -> tuple[str, str]:
        """Digests left and right of a slot, each side joined."""
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])

    def fold(self, slot: int, digest: str) -> str:
        """Digest with another child in ``slot``: resumed before the slot, so the left siblings are not hashed again."""
        state = self.states[slot].copy()
        state.update(digest.encode())
        state.update("".join(self.children[slot + 1 :]).encode())
        return state.hexdigest()


def grow(digests: list[str], height: int) -> list[list[Parent]]:
    """The parents of ``height`` levels over ``digests``, level by level; a last run may hold one child only."""
    levels = []
    for _ in range(height):
        parents = [Parent(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)]
        levels.append(parents)
        digests = [p.digest for p in parents]
    return levels


def height_of(count: int) -> int:
    """Levels until one node remains."""
    height = 0
    while count > 1:
        count, height = -(-count // FANOUT), height + 1
    return height


class Inherited:
    """The part of a path above a block; the state before the slot is kept for all leaves of the block."""

    def __init__(self, upper: list[dict]) -> None:
        self.text = "".join(step["left"] + step["right"] for step in upper)
        self.steps = []
        for step in upper:
            self.steps.append((hashlib.sha256(step["left"].encode()), step["right"].encode()))

    def fold(self, digest: str) -> str:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest.encode())
            state.update(right)
            digest = state.hexdigest()
        return digest


def in_blocks(batches: Iterator[pa.RecordBatch], emit: Callable[[list[dict]], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Hand rows sorted by (``grp``, ``block``) to ``emit`` one block at a time; only one block is held."""
    held: list[dict] = []
    made: list[dict] = []
    key = None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["grp"], row["block"]) != key:
                if held:
                    made += emit(held)
                held, key = [], (row["grp"], row["block"])
            held.append(row)
            if len(made) >= BLOCK:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
    if held:
        made += emit(held)
    if made:
        yield pa.RecordBatch.from_pylist(made, schema)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place of a row in its ``grp`` by ``order``, and ``n``, the rows of the group.

    Rows are ranged by (grp, order) and written once, so a group with any share of the rows lies in many partitions (equal
    rows too); a partition's part of a group is numbered from one small row of counts for each (group, partition).
    """
    keys = ["grp", *order, "__tie"]
    part = nodes.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    part = cut(part.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)))
    pieces = part.groupBy("grp", "__part").agg(F.count(F.lit(1)).alias("__count"), F.min("__row").alias("__first"))
    group = Window.partitionBy("grp")
    before = F.sum("__count").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("grp", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__count").over(group).alias("n"))
    placed = join_checked(part, pieces, ["grp", "__part"]).withColumn("pos", F.col("__row") + F.col("__shift"))
    return placed.drop("__row", "__shift", "__part")


def _height(node: dict) -> int:
    """Levels of the node's block: all of a tier, or those to the root if the group is this block."""
    return TIER if node["n"] > BLOCK else height_of(node["n"])


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _block_roots(nodes: DataFrame) -> DataFrame:
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def emit(rows: list[dict]) -> list[dict]:
        levels = grow([r["digest"] for r in rows], _height(rows[0]))
        top = levels[-1][0].digest if levels else rows[0]["digest"]
        return [{"grp": rows[0]["grp"], "pos": rows[0]["block"], "n": -(-rows[0]["n"] // BLOCK), "digest": top}]

    rows = _by_block(nodes.select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest"))
    return rows.mapInArrow(lambda batches: in_blocks(batches, emit, schema), "grp string, pos long, n long, digest string")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(grp, pos, n, digest)`` and above them the block roots, tier by tier, until each group is one node.

    A tier has 1/4096 of the rows of the one below; the driver only reads the size of the largest group.
    """
    found = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        found.append(cut(_block_roots(found[-1])))
        largest = -(-largest // BLOCK)
    return found


def _led(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows in blocks, each block led by the row of its path (``pos`` -1)."""
    lead = paths.withColumn("block", F.col("pos")).withColumn("pos", F.lit(-1).cast("long"))
    return _by_block(nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).unionByName(lead, allowMissingColumns=True))


def _steps(levels: list[list[Parent]], at: int) -> list[tuple[Parent, int]]:
    """The parents above node ``at`` of a block and its slot in each, from below."""
    steps = []
    for parents in levels:
        steps.append((parents[at // FANOUT], at % FANOUT))
        at //= FANOUT
    return steps


def _descend(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of ``nodes`` from the ``paths`` of their blocks. A node with a ``name`` is the root of the group so named."""
    sides = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("upper", sides)])

    def emit(rows: list[dict]) -> list[dict]:
        lead, *below = rows
        if not below:  # the path to the root of an empty table
            return []
        levels = grow([r["digest"] for r in below], _height(below[0]))
        out = []
        for at, node in enumerate(below):
            own = [dict(zip(("left", "right"), parent.siblings(slot))) for parent, slot in _steps(levels, at)]
            if node.get("name") is None:
                place = {"grp": node["grp"], "pos": node["pos"], "subroot": lead["subroot"]}
            else:
                place = {"grp": node["name"], "pos": 0, "subroot": node["digest"]}
            out.append(place | {"upper": own + lead["upper"]})
        return out

    return _led(nodes, paths).mapInArrow(lambda batches: in_blocks(batches, emit, schema), PATHS)


def _fold(leaves: DataFrame, paths: DataFrame, root: str | None) -> DataFrame:
    """Proof and folded root of every leaf, block by block."""
    id_type = leaves.schema["id"].dataType
    schema = pa.schema([
        ("id", to_arrow_type(id_type)), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()),
        ("n_siblings", pa.int64()), ("folded_root", pa.string()), ("verified", pa.bool_()),
    ])

    def emit(rows: list[dict]) -> list[dict]:
        lead, *below = rows
        above = Inherited(lead["upper"])
        levels = grow([r["digest"] for r in below], _height(below[0]))
        out = []
        for at, node in enumerate(below):
            steps = _steps(levels, at)
            proof = "".join(side for parent, slot in steps for side in parent.siblings(slot)) + above.text
            folded = node["changed"] or node["digest"]
            for parent, slot in steps:
                folded = parent.fold(slot, folded)
            folded = above.fold(folded)
            out.append({
                "id": node["id"], "leaf": node["digest"], "subroot": lead["subroot"], "root": root, "proof_sha256": hashlib.sha256(proof.encode()).hexdigest(),
                "n_siblings": len(proof) // 64, "folded_root": folded, "verified": folded == root,
            })
        return out

    rows = _led(leaves, paths)
    return rows.mapInArrow(lambda batches: in_blocks(batches, emit, schema), f"id {id_type.simpleString()}, {RESULT}")


def merkle_manifest(
    docs: DataFrame, fields: list[str], id_col: str, group_col: str, replaced: dict[str, Column] | None = None, when: Column | None = None
) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, n_siblings, folded_root, verified)`` of every row of ``docs``.

    A leaf is the digest of ``fields``. Leaves of a group ascend by ``id_col`` (null first, equal ids by digest); 16
    nodes make a parent until one remains, and the groups' roots, null first and then bytewise, form a tree of the same
    kind. ``proof_sha256`` hashes the siblings on the path to the root, joined from below. ``folded_root`` comes
    from the leaf of the row with the columns of ``replaced`` put in where ``when`` holds (as read again elsewhere) and the
    original siblings; ``verified`` tells whether it is the root.

    Leaves are hashed in the JVM. A task folds 4096 nodes at a time: parents keep copied hash states before each child
    slot, so a changed child costs the hash of itself and its right siblings only. No group is ever held by one task: one
    with any share of the rows is many blocks, and above each block is one row. Null columns, empty and long texts and repeated
    rows (equal leaves side by side) are leaves like any other; an empty table gives no rows. Only the named columns
    are read, so others may have any name.
    """
    chosen = F.coalesce(F.lit(False) if when is None else when, F.lit(False))
    changed = leaf_digest(*[(replaced or {}).get(c, F.col(f"`{c}`")) for c in fields])
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    digest = leaf_digest(*[F.col(f"`{c}`") for c in fields])
    leaves = cut(docs.select(F.col(f"`{id_col}`").alias("id"), group.alias("grp"), digest.alias("digest"), F.when(chosen, changed).alias("changed")))
    leaves = cut(numbered(leaves, ["id", "digest"]))
    groups = tiers(leaves.select("grp", "pos", "n", "digest"))
    tops = groups[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    whole = tiers(cut(numbered(tops, ["name"])))
    root = whole[-1].agg(F.max("digest")).first()[0]
    start = F.lit("").alias("grp"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("subroot"), F.expr(f"cast(array() as {SIDES})").alias("upper")
    paths = docs.sparkSession.range(1).select(*start)
    for nodes in [*reversed(whole), *reversed(groups[1:])]:
        paths = _descend(nodes, paths)
    return _fold(leaves, paths, root).withColumnRenamed("id", id_col)
