"""Product codes of vectors by exact integer k-means over Hilbert-sorted blocks with boxes and sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabularium.functions.skew import join_checked
from tabularium.llm.common import cut

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK_ROWS = 128
LARGEST = 1 << 28  # integers are held within this bound, so that squared distances of a part fit 64 bits
KEY_BITS = 64
EXACT_FLOAT = 1 << 53


def is_kept(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def part_bounds(dims: int) -> list[int]:
    """Cuts into ``PARTS`` consecutive parts, equal where the number of components allows it."""
    return [i * dims // PARTS for i in range(PARTS + 1)]


def hilbert_key(points: np.ndarray, low: int, high: int) -> np.ndarray:
    """Place of integer points on the Hilbert curve as signed 64-bit keys in curve order.

    Components (the first 64) are cut into equal cells between ``low`` and ``high``; the key only orders, so coarse cells
    cost speed and not results.
    """
    rows, dims = points.shape[0], min(points.shape[1], KEY_BITS)
    if not dims or not rows:
        return np.zeros(rows, np.int64)
    bits = min(8, KEY_BITS // dims)
    span = max(1, high - low)
    cells = np.clip((points[:, :dims] - low).astype(np.float64) / span * (1 << bits), 0, (1 << bits) - 1).astype(np.uint32)
    x = np.ascontiguousarray(cells.T)
    for level in range(bits - 1, 0, -1):  # undo the turns of the curve from the coarsest level down
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(dims):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros(rows, np.uint32)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(level)) & 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    key = np.zeros(rows, np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint32(level)) & 1).astype(np.uint64)
    return (key ^ np.uint64(1 << 63)).view(np.int64) if dims * bits == 64 else key.astype(np.int64)


def narrow(points: np.ndarray) -> np.ndarray:
    """The same integers in the smallest width that holds them."""
    reach = int(np.abs(points).max(initial=0))
    return points.astype(np.int16 if reach < 1 << 15 else np.int32)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """``(blocks, entries)`` mask of the entries that can be nearest to some point of a box.

    An entry is out when the box's nearest corner to it is farther than the farthest corner to another entry.
    """
    low, high, book = low[:, None, :], high[:, None, :], book[None, :, :]
    near = np.maximum(np.maximum(low - book, book - high), 0)
    far = np.maximum(np.abs(book - low), np.abs(high - book))
    return (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1)[:, None]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (ties to the lower) and exact squared distance of the nearest entry; floats only where they are exact."""
    reach = 2 * max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if reach * reach * max(1, points.shape[1]) < EXACT_FLOAT:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        found = (p * p).sum(axis=1)[:, None] + (e * e).sum(axis=1)[None, :] - 2 * (p @ e.T)
        at = found.argmin(axis=1)
        return at, found[np.arange(len(at)), at].astype(np.int64)
    best = np.full(len(points), np.iinfo(np.int64).max)
    at = np.zeros(len(points), np.int64)
    for index, entry in enumerate(entries.astype(np.int64)):
        gap = points.astype(np.int64) - entry
        found = (gap * gap).sum(axis=1)
        closer = found < best
        best[closer], at[closer] = found[closer], index
    return at, best


def new_book(book: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries moved to the floor of the mean of their parts; unused ones stay."""
    used = counts > 0
    moved = book.copy()
    moved[used] = sums[used] // counts[used][:, None]
    return moved


def _wide(column: pa.Array, width: int) -> np.ndarray:
    """``(rows, width)`` integers of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _points(data: memoryview, count: int, width: int) -> np.ndarray:
    size = len(data) // max(1, count * width)
    return np.frombuffer(data, np.int16 if size == 2 else np.int32).reshape(count, width)


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind) for name, kind in fields.items()])


def _parts_of(table: DataFrame, dims: int, low: int, high: int) -> DataFrame:
    """One row for each part of each vector: its integers and its place on the curve of its part position."""
    bounds = part_bounds(dims)
    row = table.schema["row"].dataType
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("uid", pa.int64()), ("row", to_arrow_type(row)), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            points = integers(values)
            for part in range(PARTS):
                piece = points[:, bounds[part] : bounds[part + 1]]
                key, small = hilbert_key(piece, low, high), narrow(piece)
                data = pa.array([r.tobytes() for r in small], pa.binary())
                rows = batch.column("row").cast(schema.field("row").type) if part == 0 else pa.nulls(batch.num_rows, schema.field("row").type)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), part, np.int32)), pa.array(key), batch.column("uid"), rows, data], schema=schema
                )

    return table.mapInArrow(run, _struct(part="int", key="long", uid="long", row=row, data="binary"))


def _blocks_of(parts: DataFrame, bounds: list[int]) -> DataFrame:
    """Flat blocks of up to ``BLOCK_ROWS`` neighbours on the curve, with box and sum."""
    row = parts.schema["row"].dataType
    longs = pa.list_(pa.int64())
    schema = pa.schema([
        ("part", pa.int32()), ("n", pa.int32()), ("data", pa.binary()), ("low", longs), ("high", longs), ("total", longs), ("uids", longs),
        ("rows", pa.list_(to_arrow_type(row))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            made: list[dict] = []
            for start, end in zip(starts, [*starts[1:], len(part)]):
                width = bounds[part[start] + 1] - bounds[part[start]]
                for at in range(start, end, BLOCK_ROWS):
                    piece = batch.slice(at, min(BLOCK_ROWS, end - at))
                    raw = [memoryview(v.as_buffer()) for v in piece.column("data")]
                    points = narrow(np.concatenate([_points(v, 1, width) for v in raw]).astype(np.int64))
                    box = points.astype(np.int64)
                    made.append({
                        "part": part[start], "n": len(points), "data": points.tobytes(), "low": box.min(axis=0), "high": box.max(axis=0),
                        "total": box.sum(axis=0), "uids": piece.column("uid").to_numpy(), "rows": piece.column("row").to_pylist() if part[start] == 0 else None,
                    })
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)

    lists = dict.fromkeys(("low", "high", "total", "uids"), "array<long>")
    return parts.mapInArrow(run, _struct(part="int", n="int", data="binary", **lists, rows=T.ArrayType(row)))


class Books:
    """The codebooks of one round, sent to every task: ``PARTS`` x up to ``ENTRIES`` rows of integers."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books = books

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(row of the batch, part, shortlist, points)`` of each block."""
        part = batch.column("part").to_numpy()
        count = batch.column("n").to_numpy()
        for position, book in enumerate(self.books):
            rows = np.flatnonzero(part == position)
            width = book.shape[1]
            for at in range(0, len(rows), 64):
                some = pa.array(rows[at : at + 64])
                masks = shortlists(_wide(batch.column("low").take(some), width), _wide(batch.column("high").take(some), width), book)
                for row, mask in zip(rows[at : at + 64], masks):
                    listed = np.flatnonzero(mask)
                    points = _points(memoryview(batch.column("data")[int(row)].as_buffer()), int(count[row]), width)
                    yield int(row), position, listed, points

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts and sums of the parts of every entry, over all blocks of a task; ``whole`` counts blocks taken by their sum."""
        counts = [np.zeros(len(b), np.int64) for b in self.books]
        totals = [np.zeros(b.shape, np.int64) for b in self.books]
        whole = [np.zeros(len(b), np.int64) for b in self.books]
        for batch in batches:
            for row, part, listed, points in self.blocks(batch):
                if len(listed) == 1:
                    counts[part][listed[0]] += len(points)
                    totals[part][listed[0]] += np.array(batch.column("total")[row].as_py(), np.int64)
                    whole[part][listed[0]] += 1
                    continue
                at = listed[nearest(points, self.books[part][listed])[0]]
                counts[part] += np.bincount(at, minlength=len(counts[part]))
                np.add.at(totals[part], at, points)
        rows = [
            {"part": part, "entry": int(e), "n": int(counts[part][e]), "total": totals[part][e], "whole": int(whole[part][e])}
            for part in range(len(self.books))
            for e in np.flatnonzero(counts[part])
        ]
        if rows:
            schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64())), ("whole", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    def codes(self, row_type: pa.DataType):
        """Entry and squared distance of every part of every block."""
        schema = pa.schema([("uid", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("distance", pa.int64()), ("row", row_type)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, part, listed, points in self.blocks(batch):
                    at, distance = nearest(points, self.books[part][listed])
                    n = len(points)
                    rows = batch.column("rows")[row].values if part == 0 else pa.nulls(n, row_type)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("uids")[row].values, pa.array(np.full(n, part, np.int32)), pa.array(listed[at].astype(np.int32)), pa.array(distance), rows.cast(row_type)],
                        schema=schema,
                    )

        return run


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def fit_books(blocks: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> tuple[list[np.ndarray], list[float]]:
    """Codebooks after ``rounds`` rounds over all blocks, and for each round the share of parts' blocks taken whole.

    A round is one pass over the blocks; a task hands on at most one row for each entry, and the driver reads their sums:
    as many rows as the codebooks have.
    """
    total, shares = blocks.count(), []
    for _ in range(rounds):
        made = blocks.drop("uids", "rows").mapInArrow(Books(books).sums, "part int, entry int, n long, total array<long>, whole long")
        width = max(b.shape[1] for b in books)
        added = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width)]
        rows = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"), *added).collect()
        counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for r in rows:
            counts[r["part"]][r["entry"]] = r["n"]
            sums[r["part"]][r["entry"]] = [r[f"s{i}"] for i in range(books[r["part"]].shape[1])]
        books = [new_book(b, c, s) for b, c, s in zip(books, counts, sums)]
        shares.append(sum(r["whole"] for r in rows) / max(1, total))
    return books, shares


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, code, error, label_error, codebooks_sha256)`` of every kept vector.

    Vectors that are null or hold null or non-finite components are dropped; components become ``floor(1024 * x)`` (held
    within 2 ** 28 either way). The 256 smallest ids (null last, equal ids by their vector) start the codebooks of the four
    consecutive parts; with fewer vectors the codebooks are smaller. After four rounds, all distances exact and ties to the lower
    entry, every part is assigned again. ``code`` joins the entries as two hex digits a part, ``error`` the squared
    distances; ``label_error`` is its sum over equal labels, nulls together. Repeated rows are coded each. A vector of
    another length than that of the smallest id has no place in the codebooks and is left out. An empty table
    gives no rows; other columns are not read.

    Parts are ranged along the Hilbert curve of their position, with the row's number to split equal parts, and written once as
    flat blocks with box and sum. A round sends the codebooks (256 entries of the vector's length) to the tasks; boxes
    leave a short list of entries for each block, and a block with one entry adds its stored sum.
    """
    names = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).alias("row")
    kept = vectors.where(is_kept(F.col(f"`{vector_col}`"))).select(names, F.col(f"`{vector_col}`").alias("vector"))
    smallest = lambda df: df.orderBy(F.col("row.id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    seeds = smallest(kept)
    dims = len(seeds[0]["vector"]) if seeds else 0
    kept = kept.where(F.size("vector") == dims)
    if any(len(r["vector"]) != dims for r in seeds):
        seeds = smallest(kept)
    bounds = part_bounds(dims)
    first = integers(np.array([r["vector"] for r in seeds], np.float64).reshape(len(seeds), dims))
    ends = kept.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first() if dims else (0.0, 0.0)
    low, high = (int(v) for v in integers(np.array([v or 0.0 for v in ends])))
    parts = _parts_of(kept.withColumn("uid", F.monotonically_increasing_id()).select("row", "uid", "vector"), dims, low, high)
    parts = parts.repartitionByRange("part", "key", "uid").sortWithinPartitions("part", "key", "uid")
    blocks = cut(_blocks_of(parts, bounds))
    books, _ = fit_books(blocks, [first[:, a:b] for a, b in zip(bounds, bounds[1:])])
    row = parts.schema["row"].dataType
    schema = _struct(uid="long", part="int", entry="int", distance="long", row=row)
    coded = blocks.mapInArrow(Books(books).codes(to_arrow_type(row)), schema)
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0") for p in range(PARTS)]
    coded = coded.groupBy("uid").agg(F.first("row", ignorenulls=True).alias("row"), F.concat(*digits).alias("code"), F.sum("distance").alias("error"))
    key = F.coalesce(F.concat(F.lit("="), F.col("row.label").cast("string")), F.lit("")).alias("__label")
    coded = cut(coded.select("row", "code", "error", key))
    sums = coded.groupBy("__label").agg(F.sum("error").alias("label_error"))
    done = join_checked(coded, sums, ["__label"])
    return done.select(
        F.col("row.id").alias(id_col), F.col("row.label").alias(label_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )
