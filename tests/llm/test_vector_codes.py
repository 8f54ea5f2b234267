"""Vector codes against plain k-means in Python integers; boxes, short lists and the curve on their own."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabularium.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, uid int"


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def brute(rows):
    """Rows ``(id, code, error, label_error)`` and the hash of the books."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(rows[0][1]) if rows else 0
    rows = [r for r in rows if len(r[1]) == dims]
    bounds = vc.part_bounds(dims)
    parts = [[tuple(math.floor(1024 * float(np.float32(x))) for x in r[1][a:b]) for r in rows] for a, b in zip(bounds, bounds[1:])]
    books = [list(p[:256]) for p in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p, book in enumerate(books):
            groups = {}
            for x in parts[p]:
                groups.setdefault(near(x, book)[1], []).append(x)
            for k, xs in groups.items():
                book[k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out, sums = [], {}
    for i, r in enumerate(rows):
        found = [near(parts[p][i], books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        sums[r[2]] = sums.get(r[2], 0) + error
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), error, r[2]))
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=repr)


def vectors():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(700):
        label = None if i % 11 == 0 else i % 4
        rows.append((i, [float(np.float32(c + rng.gauss(0, 0.02))) for c in centres[i % 12]], label, "x", 1))
    same = rows[5][1]
    rows += [(2000 + i, same, 3, "x", 1) for i in range(300)] + [rows[6], rows[6], (None, same, None, "x", 1)]
    bad = [None, [None] + same[1:], [float("nan")] + same[1:], [float("inf")] + same[1:], same[:4], []]
    return rows + [(3000 + i, b, 1, "x", 1) for i, b in enumerate(bad)]


def got(frame):
    assert frame.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in frame.collect()), key=repr)


def test_equal_to_plain_rounds(spark):
    rows = vectors()
    assert got(vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "x", 1)], [(9, [0.5, -0.25, 1e9, -1e9, 0.1], None, "x", 1)], [(i, [float(i % 3)] * 3, 0, "x", 1) for i in range(9)]])
def test_few_vectors_and_odd_lengths(spark, rows):
    frame = vc.compress(spark.createDataFrame(rows, SCHEMA))
    if rows and rows[0][1] and max(map(abs, rows[0][1])) > 1e6:  # components are held within 2 ** 28
        assert [(r["error"], r["code"]) for r in frame.collect()] == [(0, "00000000")]
    else:
        assert got(frame) == brute(rows)


def test_clusters_are_taken_by_their_sums(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, [float(np.float32((i % 40) * 10 + rng.random() / 100))] * 4, 0) for i in range(9000)], "vec_id long, embedding array<float>, label int")
    kept = docs.selectExpr("struct(vec_id as id, label) as row", "embedding as vector", "monotonically_increasing_id() as uid")
    parts = vc._parts_of(kept.select("row", "uid", "vector"), 4, 0, 400 * 1024).repartitionByRange(4, "part", "key").sortWithinPartitions("part", "key", "uid")
    blocks = vc._blocks_of(parts, vc.part_bounds(4))
    books, shares = vc.fit_books(blocks, [np.array([[i * 10 * 1024] for i in range(40)]) for _ in range(4)], rounds=2)
    assert shares[0] > 0.4 and len(books) == 4


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.integers(1, 40))
def test_short_lists_hold_every_nearest_entry(seed, dims, entries):
    rng = np.random.default_rng(seed)
    points = rng.integers(-50, 50, (20, dims))
    book = rng.integers(-60, 60, (entries, dims))
    mask = vc.shortlists(points.min(axis=0)[None], points.max(axis=0)[None], book)[0]
    at, distance = vc.nearest(points, book)
    listed = np.flatnonzero(mask)
    short, same = vc.nearest(points, book[listed])
    assert (listed[short] == at).all() and (same == distance).all()
    big, far = vc.nearest(points + (1 << 26), book + (1 << 26))
    assert (big == at).all() and (far == distance).all()


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_neighbours_on_the_curve_touch(dims):
    points = np.array(list(itertools.product(range(8), repeat=dims)))
    key = vc.hilbert_key(points, 0, 256)
    walked = points[np.argsort(key)]
    assert len(set(key.tolist())) == len(points) and (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()
