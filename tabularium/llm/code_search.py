"""Exact nearest binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabularium.llm.common import partitions

SEGMENTS, BITS = 4, 16
BLOCK = 65_536  # distinct codes of an index block, and of a query block
QUERY_BLOCK = 512


def sign_code(vector: str) -> Column:
    """64-bit code of a vector column of 64 numbers or fewer: bit i is set if number i is positive; null for null."""
    bits = F.expr(f"aggregate(transform(sequence(0, 63), i -> if(get(`{vector}`, i) > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    long = F.raise_error(F.lit("codes have 64 bits: vectors of more numbers need another code")).cast("long")
    return F.when(F.col(vector).isNull(), F.lit(None)).when(F.size(vector) > 64, long).otherwise(bits)


@cache
def _masks(radius: int) -> np.ndarray:
    """All segment values with exactly ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(BITS), radius)], np.int64)


class SegmentIndex:
    """Codes of one block, found by the value of each of their four 16-bit segments."""

    def __init__(self, codes: np.ndarray, first_ids: np.ndarray) -> None:
        order = np.argsort(first_ids, kind="stable")
        self.codes, self.first_ids = codes[order], first_ids[order]
        self.rows, self.starts = [], []
        for s in range(SEGMENTS):
            values = self.segment(self.codes, s)
            self.rows.append(np.argsort(values, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << BITS))]))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(BITS * s)) & np.uint64(0xFFFF)).astype(np.int64)

    def nearest(self, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, distances)`` of the k nearest codes by (distance, smallest id).

        Radius r of all four segments finds every code within 4 r + 3 bits; it grows until that covers the k-th
        verified distance, or every code of the block has been found.
        """
        seen = np.zeros(len(self.codes), bool)
        rows, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(BITS + 1):
            for s in range(SEGMENTS):
                probes = int((int(code) >> BITS * s) & 0xFFFF) ^ _masks(radius)
                a, b = self.starts[s][probes], self.starts[s][probes + 1]
                size = b - a
                hit = size > 0
                a, size = a[hit], size[hit]
                if not len(a):
                    continue
                at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                found = self.rows[s][at]
                found = found[~seen[found]]
                seen[found] = True
                rows = np.concatenate([rows, found])
                distances = np.concatenate([distances, np.bitwise_count(self.codes[found] ^ code).astype(np.int64)])
            if len(rows) > k:  # rows are numbered by smallest id
                best = np.lexsort((rows, distances))[:k]
                rows, distances = rows[best], distances[best]
            if len(rows) >= k and distances.max() <= SEGMENTS * radius + SEGMENTS - 1 or seen.all():
                break
        best = np.lexsort((rows, distances))[:k]
        return rows[best], distances[best]


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, index = None, None
        for batch in batches:
            for block, codes, first_ids, queries in zip(batch["block"], batch["codes"], batch["first_ids"], batch["queries"]):
                if block != last:
                    index, last = SegmentIndex(np.asarray(codes, np.int64).view(np.uint64), np.asarray(first_ids, np.int64)), block
                for q in np.asarray(queries, np.int64).view(np.uint64):
                    rows, distances = index.nearest(q, k)
                    yield pd.DataFrame({"query_code": np.full(len(rows), q, np.uint64).view(np.int64), "code": index.codes[rows].view(np.int64), "first_id": index.first_ids[rows], "distance": distances})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in run(batches):
            held.append(frame)
            if len(held) >= 1024:
                yield pd.concat(held, ignore_index=True)
                held = []
        if held:
            yield pd.concat(held, ignore_index=True)

    return joined


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", code_col: str = "code", block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, id, distance)``: the ``k`` rows nearest to each query row by (Hamming distance, id), exact.

    A query finds itself if it is among ``rows``. Equal codes are searched once: of each code the ``k`` smallest ids can
    be among the results, so no common code is a large group. The distinct codes are spread over index blocks of about
    ``block`` codes, the stated queries meet every block in blocks of their own, and each pair of blocks is searched by
    multi-index hashing in one task; block results are merged by rank. Rows with a null id or code are neither found nor
    searched for. Rows with equal ids each count; ``k`` or fewer rows give all of them.
    """
    known = rows.where(F.col(id_col).isNotNull() & F.col(code_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(code_col).alias("code"))
    asked = queries.where(F.col(id_col).isNotNull() & F.col(code_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(code_col).alias("query_code"))
    first = known.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    ids = first.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = known.groupBy("code").agg(F.min("id").alias("first_id"))
    n_blocks = max(1, -(-distinct.count() // block))
    blocks = distinct.groupBy(F.pmod(F.xxhash64("code"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list("code").alias("codes"), F.collect_list("first_id").alias("first_ids")
    )
    codes = asked.select("query_code").distinct()
    n_query_blocks = max(1, -(-codes.count() // QUERY_BLOCK))
    query_blocks = codes.groupBy(F.pmod(F.xxhash64("query_code", F.lit(1)), F.lit(n_query_blocks)).alias("part")).agg(F.collect_list("query_code").alias("queries"))
    pairs = query_blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")
    spread = max(partitions(rows), min(n_query_blocks * n_blocks, 16 * partitions(rows)))
    pairs = pairs.repartition(spread, "block", "part").sortWithinPartitions("block").select("block", "codes", "first_ids", "queries")
    found = pairs.mapInPandas(_search(k), "query_code long, code long, first_id long, distance long")
    # the k best codes hold the k best rows
    best = found.withColumn("n", F.row_number().over(W.partitionBy("query_code").orderBy("distance", "first_id"))).where(F.col("n") <= k)
    near = best.join(ids, "code").select("query_code", "distance", F.explode("ids").alias("id"))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("query_code").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return asked.join(near, "query_code").select("query_id", "rank", F.col("id").alias(id_col), "distance")
