"""Near-duplicate documents by SimHash and one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import cut, partitions, text_key
from tabularium.llm.graph import connected_components

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3  # two segments of 32 bits: one of them differs by one bit at most
LARGE_BUCKET = 4096


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of word shingles as an unsigned integer; 0 for null, empty or blank text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def _near(codes: np.ndarray, code: np.uint64, key: int) -> np.ndarray:
    """Which ``codes`` link to ``code`` and have bucket ``key`` as the one that counts for the pair.

    A pair counts in the lowest segment that differs by one bit at most, at that bit (bit 0 if it is equal), so no
    bucket repeats the work of another.
    """
    segment, bit = (key >> 32) // 32, (key >> 32) % 32
    differ = codes ^ code
    own = (differ >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
    found = (np.bitwise_count(differ) <= MAX_DISTANCE) & ((own == np.uint64(1 << bit)) | ((own == 0) & (bit == 0)))
    if segment:
        found &= np.bitwise_count(differ & np.uint64(0xFFFFFFFF)) > 1
    return found


def _forest(codes: np.ndarray, key: int) -> list[tuple[np.uint64, np.uint64]]:
    """Edges that connect what links inside one bucket; at most one less than its codes."""
    edges, left = [], codes
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            code = queue.pop()
            hit = _near(left, code, key)
            if hit.any():
                new = left[hit]
                edges += [(code, x) for x in new]
                queue.extend(new)
                left = left[~hit]
    return edges


def _refined(key: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second-level buckets of a large one: the other segment cut into halves, again with one wildcard.

    The rest of the code has 18 free bits, so a second-level bucket has at most 2**18 codes.
    """
    other = (codes >> np.uint64(32 * (1 - (key >> 32) // 32))) & np.uint64(0xFFFFFFFF)
    keys = []
    for j in range(32):
        half = (other >> np.uint64(16 * (j // 16))) & np.uint64(0xFFFF)
        masked = half & np.uint64(0xFFFF ^ (1 << (j % 16)))
        keys.append((np.uint64(key << 21 | j << 16) | masked).astype(np.int64))
    return np.concatenate(keys), np.tile(codes, 32)


def _links(limit: int | None, shift: int):
    """Per partition sorted by bucket: edges (kind 0) and, for buckets over ``limit``, second-level rows (kind 1)."""

    def frame(kind: int, a, b) -> pd.DataFrame:
        a, b = np.asarray(a), np.asarray(b)
        return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "u": a.astype(np.uint64).view(np.int64), "v": b.astype(np.uint64).view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, np.empty(0, np.uint64)  # the bucket at the end of the rows so far
        hot = False

        def close() -> Iterator[pd.DataFrame]:
            if not hot and len(held) > 1 and (edges := _forest(held, key >> shift)):
                yield frame(0, *zip(*edges))

        for batch in batches:
            keys, codes = batch["key"].to_numpy(), batch["code"].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            ends = np.append(starts[1:], len(keys))
            several = ends - starts > 1
            several[-1:] = True
            several[:1] = True
            out = []
            for a, b in zip(starts[several], ends[several]):  # single rows are nobody's pair
                if int(keys[a]) != key:
                    out += list(close())
                    key, held, hot = int(keys[a]), np.empty(0, np.uint64), False
                held = np.concatenate([held, codes[a:b]])
                if limit and (hot or len(held) > limit):
                    out.append(frame(1, *_refined(key, held)))
                    held, hot = np.empty(0, np.uint64), True
            if out:
                yield pd.concat(out, ignore_index=True)
        yield from close()

    return run


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "key").sortWithinPartitions("key")


def near_links(codes: DataFrame, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """Edges ``(u, v)`` that connect all distinct ``code`` values (long) at ``MAX_DISTANCE`` bits or fewer.

    Each code is cut into two segments of 32 bits. Codes within three bits have a segment that differs by one bit at
    most, and so share one of its 32 variants with one bit removed. Codes meet by equality of such a variant; within a
    bucket every code is verified against those not yet reached, and a spanning forest of the links is returned, which
    has the components of all pairs without their number. A bucket of more than ``large_bucket`` codes is divided by
    variants of the other segment before it is searched.
    """
    n = partitions(codes)
    j = F.col("j")
    segment = F.when(j < 32, F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("code", 32))
    masked = segment.bitwiseAND(F.expr("~shiftleft(1L, cast(j % 32 as int))"))
    variants = codes.select("code", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).select(
        F.expr("shiftleft(cast(j as bigint), 32)").bitwiseOR(masked).alias("key"), "code"
    )
    first = cut(_bucketed(variants, n).mapInPandas(_links(large_bucket, 0), "kind int, u long, v long"))
    edges = first.where("kind = 0").select("u", "v")
    large = first.where("kind = 1").select(F.col("u").alias("key"), F.col("v").alias("code"))
    if not large.isEmpty():
        more = _bucketed(large, n).mapInPandas(_links(None, 21), "kind int, u long, v long")
        edges = edges.unionByName(more.select("u", "v"))
    return edges


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large_bucket: int = LARGE_BUCKET, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, fingerprint, component_id)``, one row per row of ``docs``.

    Words are cut at ASCII white space after lower-casing A-Z; a bit is set if it is in over half the XXH64 hashes of
    the three-word shingles. Rows link at three differing bits or fewer, ``component_id`` is the smallest id reachable.
    Null, empty and blank texts have fingerprint zero and link like any other. Rows with equal ids each get a row; a
    null id counts for no component unless all its ids are null. Equal fingerprints are one node, whatever their number.
    Columns named in ``carry`` are returned with their rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("code"), *carry))
    codes = rows.groupBy("code").agg(F.min("id").alias("first_id"))
    found = connected_components(near_links(codes.select("code"), large_bucket)).withColumnRenamed("node", "code")
    # only codes that link to another one need more than their own smallest id
    linked = found.join(codes, "code")
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("linked_id"))
    by_code = codes.join(linked.select("code", "component").join(smallest, "component").select("code", "linked_id"), "code", "left")
    by_code = by_code.select("code", F.coalesce("linked_id", "first_id").alias("component_id"))
    return rows.join(by_code, "code").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id", *carry
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document with the smallest id stays.

    Repeated rows of that document stay together; a null id stays only where its whole component has none.
    """
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__key": text_key(text_col)})
    groups = simhash_components(keyed, id_col, text_col, carry=("__id", "__key"))
    gone = groups.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select("__id", "__key").distinct()
    return keyed.join(gone, ["__id", "__key"], "left_anti").select(*[f"`{c}`" for c in docs.columns])
