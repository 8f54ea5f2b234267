"""Repeated byte strings across documents: a difference-cover suffix sort that is cut off at the length of interest.

A full suffix array would move every suffix of the corpus several times. Here only the order of prefixes of ``LENGTH``
bytes matters, so the difference-cover scheme runs to that depth and leaves out what cannot repeat. Texts lie in blocks
of a few megabytes; what a block can settle by itself does not leave it:

1. Sample the positions whose remainder lies in a difference cover of 31. For any two positions there is a shift under
   31 that takes both into the sample, so two equal 50-byte strings have an equal sampled 20-byte string at the same
   shift. Name the sampled strings and sort the names; each block sends each name once, and keeps the samples whose name
   another block or another document of its own has as well.
2. Cut the remaining suffixes that a kept sample can reach (those up to 30 bytes before it) into stretches of neighbours
   with one anchor, the 12-byte string of the smallest name inside their first 50 bytes. Equal 50-byte strings have their
   anchor at the same place, so a repeated passage is cut alike wherever it stands: whole stretches are named and sorted,
   and of equal ones those of the smallest id go on. Single suffixes are named only where stretches around one anchor
   differ. What a block settles so stays there; other stretches meet by their anchor and travel as text.
3. Merge them in the same way, whole stretches first: a suffix goes if one with the same prefix starts in a document
   with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import partitions

LENGTH = 50
COVER = 31
DIFFERENCES = (1, 5, 11, 24, 25, 27)  # every remainder of 31 is a difference of two of these
SEED_BYTES = LENGTH - COVER + 1
BLOCK_BYTES = 4_000_000  # text that one block holds
BUCKET_BYTES = 32_000_000  # text whose samples share a bucket; suffixes share one by half as much
FLUSH = 1_000_000  # suffixes, about, that are named one by one at a time
TILE = 1 << 14  # positions whose numbers fit the processor's caches
ANCHOR = 12  # suffixes meet by the smallest name of strings of so many bytes inside
SIDE = 20  # an anchor so far inside or farther is told by the bytes before it as well, others by those behind
KEY_BYTES = LENGTH - SIDE + 1
KNOWN = 1_000_000  # texts that a task remembers to leave out copies
LAST_ID = 2**63 - 1  # stands for a null id

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_S = [np.uint64(x) for x in (29, 32, 31)]
_LOW = np.uint64(0xFFFF)  # places inside a tile


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _M[1]
    return x ^ (x >> _S[1])


def _loads(data: bytes) -> np.ndarray:
    """The eight bytes from every position as one number; zeros follow the text."""
    padded = data + bytes(8)
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def _names(loads: np.ndarray, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit names of the ``length``-byte strings at positions ``at`` of a text."""
    if len(at) > TILE:
        return np.concatenate([_names(loads, at[i : i + TILE], length, seed) for i in range(0, len(at), TILE)])
    name = np.full(len(at), seed + length, np.uint64)
    for step in range(0, length - 7, 8):
        name = _mix(name * _M[0] + loads[at + step])
    if length % 8:
        name = _mix(name * _M[0] + loads[at + length - 8])
    return name


def _sorted_names(names: np.ndarray) -> bytes:
    """Ascending 32-bit names as their differences, lowest bytes first: the highest ones are mostly zero and compress."""
    return np.diff(names, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _read_sorted_names(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _bytes_column(data: np.ndarray | bytes, cuts: np.ndarray) -> pa.Array:
    """What lies between neighbouring cuts, counted in the items of ``data``."""
    item = data.itemsize if isinstance(data, np.ndarray) else 1
    whole = data.tobytes() if isinstance(data, np.ndarray) else data
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * item).astype(np.int64).tobytes()), pa.py_buffer(whole)]).cast(pa.binary())


def _flat(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Items of a column of bytes, of all rows, and how many each row has."""
    cells = pa.concat_arrays([x.cast(pa.large_binary()).fill_null(b"") for x in table.column(column).chunks])
    edges = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    items = np.frombuffer((cells.buffers()[2] or pa.py_buffer(b""))[edges[0] : edges[-1]].to_pybytes(), kind)
    return items, np.diff(edges) // items.itemsize


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those whose text the task has already handed on with an id that is not larger."""
    known: dict[tuple[int, int], int] = {}
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "id"))
        k1, k2, ids = columns
        for i in np.argsort(ids, kind="stable").tolist():
            key, own = (int(k1[i]), int(k2[i])), int(ids[i])
            if known.get(key, own + 1) > own:
                known[key], keep[i] = own, True
        if len(known) > KNOWN:
            known.clear()
        yield batch.filter(pa.array(keep))


class _Block(NamedTuple):
    """The texts of a block one after the other, in the order of their keys, and the samples of all of them."""

    k1: np.ndarray
    k2: np.ndarray
    ids: np.ndarray
    edges: np.ndarray  # where the texts start, and the end
    data: np.ndarray
    loads: np.ndarray


def _block(table: pa.Table) -> _Block:
    k1, k2, ids = (table.column(c).to_numpy() for c in ("k1", "k2", "id"))
    order = np.lexsort((ids, k2, k1))
    a, b = k1[order], k2[order]
    order = order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])]  # of equal texts the smallest id
    texts = table.column("text").cast(pa.large_binary()).combine_chunks().take(pa.array(order))
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return _Block(k1[order], k2[order], ids[order], edges - edges[0], data, _loads(data.tobytes()))


def _samples(block: _Block, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, keys)`` of the samples, ascending by position. A key is the bucket and a 32-bit name."""
    n = len(block.data)
    tails = block.edges[1:, None] - np.arange(1, SEED_BYTES)  # positions from which a text has no more so many bytes
    whole = np.ones(n, bool)
    whole[tails[tails >= block.edges[:-1, None]]] = False
    places, keys = [], []
    step = TILE // len(DIFFERENCES) * COVER
    for a in range(0, n, step):
        at = (np.arange(a, min(a + step, n), COVER)[:, None] + np.array(DIFFERENCES)).ravel()
        at = at[: np.searchsorted(at, n)]
        at = at[whole[at]]
        names = _names(block.loads, at, SEED_BYTES)
        places.append(at)
        keys.append((names >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32) | _mix(names) & np.uint64(0xFFFFFFFF))
    return np.concatenate(places or [np.empty(0, np.int64)]), np.concatenate(keys or [np.empty(0, np.uint64)])


def _each_once(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(different keys in order, how often each is there, first of each bucket)``."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    often = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    return keys, often, np.searchsorted(keys, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32))


def _among(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which keys are chosen, by two hashes in a table: it lets some others (less than one in 1000) pass, which are compared in vain."""
    bits = max(10, (32 * len(chosen)).bit_length() + 1)
    table = np.zeros(1 << bits, bool)

    def places(some: np.ndarray, by: np.uint64) -> np.ndarray:
        return (some * by >> np.uint64(64 - bits)).astype(np.int64)

    for by in (_M[0], _M[3]):
        table[places(chosen, by)] = True
    found = np.concatenate([np.flatnonzero(table[places(keys[i : i + TILE], _M[0])]) + i for i in range(0, len(keys), TILE)] or [np.empty(0, np.int64)])
    among = np.zeros(len(keys), bool)
    among[found[table[places(keys[found], _M[3])]]] = True
    return among


def _sample_rows(n_buckets: int):
    """A block to one row per bucket: the names of its samples in order, each once."""

    def run(table: pa.Table) -> pa.Table:
        keys, _, first = _each_once(_samples(_block(table), n_buckets)[1], n_buckets)
        names = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        own = np.flatnonzero(np.diff(first))
        return pa.table({
            "bucket": pa.array(own, pa.int64()), "block": pa.array(np.full(len(own), table.column("block")[0].as_py()), pa.int64()),
            "names": pa.array([_sorted_names(names[first[i] : first[i + 1]]) for i in own.tolist()], pa.binary()),
        })

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Names of a bucket, of all blocks, to one row per block: a bit for each of its names, set if another block has it."""
    parts = [_read_sorted_names(x) for x in table.column("names").to_pylist()]
    cuts = np.cumsum([0, *map(len, parts)])
    names = np.concatenate(parts).astype(np.uint64) << np.uint64(32) | np.arange(cuts[-1], dtype=np.uint64)  # fewer than 2 ** 32
    del parts
    names.sort()
    same = names[1:] >> np.uint64(32) == names[:-1] >> np.uint64(32)
    bits = np.zeros(len(names), bool)
    for found in (names[1:][same], names[:-1][same]):
        bits[(found & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return pa.table({
        "block": table.column("block"), "bucket": table.column("bucket"),
        "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
    })


def _several(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which keys two documents have; documents ascend."""
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=~keys[order[:1]]) != 0
    starts = np.flatnonzero(new)
    several = np.empty(len(keys), bool)
    several[order] = (doc[order][starts] != doc[order][np.append(starts[1:], len(keys)) - 1])[np.cumsum(new) - 1] if len(keys) else False
    return several


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of stretches."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _reach(block: _Block, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of 50-byte strings that contain a kept sample (ascending), and their documents."""
    doc = np.searchsorted(block.edges, seeds, "right") - 1
    low, high = np.maximum(seeds - (LENGTH - SEED_BYTES), block.edges[doc]), np.minimum(seeds + 1, block.edges[doc + 1] - LENGTH + 1)
    good = low < high
    low, high, doc = low[good], high[good], doc[good]
    new = np.flatnonzero(np.append(True, low[1:] > high[:-1])[: len(low)])
    low, sizes = low[new], high[np.append(new, len(high))[1:] - 1] - low[new]
    return _expanded(low, sizes), np.repeat(doc[new], sizes)


def _smallest(names: np.ndarray, window: int) -> np.ndarray:
    """Smallest of every ``window`` neighbours (at least two)."""
    done = 1
    while done < window:
        step = min(done, window - done)
        names = np.minimum(names[:-step], names[step:])
        done += step
    return names


def _anchors(loads: np.ndarray) -> np.ndarray:
    """For the 50-byte string at each position, how far inside the smallest name of an ``ANCHOR``-byte string is (the first of equal ones)."""
    n, window = max(0, len(loads) - LENGTH + 1), LENGTH - ANCHOR + 1
    offsets, place = np.empty(n, np.uint8), np.arange(TILE + window, dtype=np.uint64)
    for a in range(0, n, TILE):
        b = min(a + TILE, n)
        names = _mix(loads[a : b + window - 1] * _M[0] + loads[a + ANCHOR - 8 : b + window + ANCHOR - 9] * _M[3])
        names &= ~_LOW
        names |= place[: len(names)]
        offsets[a:b] = (_smallest(names, window) & _LOW) - place[: b - a]
    return offsets


def _prefixes(loads: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names, of 64 and 32 bits, of the 50-byte strings at positions ``at``."""
    return _names(loads, at, LENGTH), (_names(loads, at, LENGTH, 99) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _later(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which suffixes have a larger id than another one with the same names: sorted by name, neighbours are compared."""
    order = np.argsort(a)
    a, b = a[order], b[order]
    new = np.diff(a, prepend=~a[:1]) != 0
    if np.any(~new[1:] & (b[1:] != b[:-1])):  # the first name alone does not tell them apart
        again = np.lexsort((b, a))
        order, a, b = order[again], a[again], b[again]
        new[1:] |= b[1:] != b[:-1]
    del a, b
    ids = own[order]
    least = np.minimum.reduceat(ids, np.flatnonzero(new)) if len(ids) else ids
    late = np.empty(len(ids), bool)
    late[order] = ids > least[np.cumsum(new) - 1]
    return late


class _Stretches(NamedTuple):
    """Neighbouring suffixes around one anchor, on one side of ``SIDE``."""

    at: np.ndarray  # where the first one starts
    sizes: np.ndarray
    offsets: np.ndarray  # of the anchor in the first one


def _stretches(starts: np.ndarray, offsets: np.ndarray) -> tuple[_Stretches, np.ndarray]:
    """Ascending starts with the anchors' offsets as stretches, and which of the starts begin them."""
    cut = np.diff(starts, prepend=starts[:1] - 2) != 1
    cut |= np.diff(starts + offsets, prepend=-1) != 0
    cut |= np.diff(offsets >= SIDE, prepend=False)
    cut = np.flatnonzero(cut)
    return _Stretches(starts[cut], np.diff(np.append(cut, len(starts))), offsets[cut].astype(np.int64)), cut


def _wholes(loads: np.ndarray, found: _Stretches) -> tuple[np.ndarray, np.ndarray]:
    """Two names, of 64 and 32 bits, of the texts of stretches."""
    last = found.sizes + (LENGTH - 1 - 8)
    a, b = found.sizes.astype(np.uint64), found.sizes.astype(np.uint64)
    for step in range(0, int(last.max(initial=0)) + 8, 8):
        load = loads[found.at + np.minimum(last, step)]
        a, b = _mix(a * _M[0] + load), _mix(b * _M[2] + load)
    return a, (b & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _settled(loads: np.ndarray, found: _Stretches, own: np.ndarray) -> np.ndarray:
    """For every suffix of the stretches, whether another one with the same 50 bytes has a smaller id.

    Of equal stretches all but those of the smallest id are settled at once. The others are compared suffix by suffix
    only with those that have the same bytes around the anchor.
    """
    a, b = _wholes(loads, found)
    whole = _later(a, b, own)
    late = np.repeat(whole, found.sizes)
    rest = np.flatnonzero(~whole)
    side = found.offsets[rest] >= SIDE
    keys = _names(loads, found.at[rest] + found.offsets[rest] - SIDE * side, KEY_BYTES) ^ side
    order = np.argsort(keys)
    rest, keys = rest[order], keys[order]
    new = np.diff(keys, prepend=~keys[:1]) != 0
    starts = np.flatnonzero(new)
    if not len(starts):
        return late
    differ = (np.minimum.reduceat(a[rest], starts) != np.maximum.reduceat(a[rest], starts))[np.cumsum(new) - 1]
    rest, new = rest[differ], new[differ]
    sizes, first = found.sizes[rest], np.cumsum(found.sizes) - found.sizes
    part = (np.cumsum(sizes) - sizes)[np.flatnonzero(new)] // FLUSH if len(rest) else sizes
    part = part[np.cumsum(new) - 1] if len(rest) else part  # strings with one key stay together
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(rest)]):
        some, n = rest[x:y], sizes[x:y]
        at = _expanded(found.at[some], n)
        late[_expanded(first[some], n)] = _later(*_prefixes(loads, at), np.repeat(own[some], n))
    return late


def _pairs(starts: np.ndarray) -> np.ndarray:
    """Ascending starts as ``(start, how many neighbours)``, flat."""
    cut = np.flatnonzero(np.diff(starts, prepend=starts[:1] - 2) != 1)
    return np.stack([starts[cut], np.diff(np.append(cut, len(starts)))], axis=1).astype(np.int32).ravel()


_RUNS = pa.schema([("meet", pa.int64()), ("block", pa.int64()), *[(n, pa.binary()) for n in ("ids", "low", "high", "sizes", "offsets", "text", "pairs")]])
_BEGINS = 128  # added to the offset of a stretch that does not go on where the one before ends


def _run_rows(n_buckets: int, n_meets: int):
    """A block with the bits of its names to one row per meeting place: ids, starts and text of runs of stretches.

    One row more has the starts that the block settles by itself.
    """

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _RUNS.empty_table()
        block, number = _block(table), table.column("block")[0].as_py()
        at, keys = _samples(block, n_buckets)
        names, often, first = _each_once(keys, n_buckets)
        others = np.zeros(len(names), bool)
        for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist()):
            low, high = first[bucket], first[bucket + 1]
            others[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
        kept = _among(keys, names[others])
        twice = np.flatnonzero(~kept & _among(keys, names[(often > 1) & ~others]))
        kept[twice] = _several(keys[twice], np.searchsorted(block.edges, at[twice], "right"))
        starts, doc = _reach(block, at[kept])
        del at, keys, names, often, others, kept, twice
        if not len(starts):
            return _RUNS.empty_table()
        anchors = _anchors(block.loads)
        near, cut = _stretches(starts, anchors[starts])
        late = _settled(block.loads, near, block.ids[doc[cut]])
        done = _RUNS.empty_table()
        if late.any():
            done = pa.Table.from_pylist([{"meet": number % n_meets, "block": number, "pairs": _pairs(starts[late]).tobytes()}], _RUNS)
        starts, doc = starts[~late], doc[~late]
        near, cut = _stretches(starts, anchors[starts])
        doc = doc[cut]
        meet = (_mix(_names(block.loads, near.at + near.offsets, ANCHOR) * _M[2]) % np.uint64(n_meets)).astype(np.int64)
        order = np.argsort(meet, kind="stable")
        low, sizes, offsets, meet, doc = near.at[order], near.sizes[order], near.offsets[order], meet[order], doc[order]
        begins = (np.diff(low, prepend=-1) != np.append(-1, sizes)[:-1]) | (np.diff(meet, prepend=-1) != 0)
        edges = np.flatnonzero(np.diff(meet, prepend=-1))
        runs = np.flatnonzero(begins)
        stretch_cuts = np.append(edges, len(meet))
        run_cuts = np.searchsorted(runs, stretch_cuts)
        width = np.add.reduceat(sizes, runs) + LENGTH - 1 if len(runs) else runs
        low, doc, whole = low[runs], doc[runs], block.data.tobytes()
        columns = {
            "meet": pa.array(meet[edges], pa.int64()), "block": pa.array(np.full(len(edges), number), pa.int64()),
            "ids": _bytes_column(block.ids[doc], run_cuts),
            "low": _bytes_column((low & 0xFFFF).astype(np.uint16), run_cuts), "high": _bytes_column((low >> 16).astype(np.uint16), run_cuts),
            "sizes": _bytes_column(sizes.astype(np.uint8), stretch_cuts), "offsets": _bytes_column((offsets + _BEGINS * begins).astype(np.uint8), stretch_cuts),
            "text": _bytes_column(b"".join([whole[s : s + n] for s, n in zip(low.tolist(), width.tolist())]), np.append(0, np.cumsum(width))[run_cuts]),
            "pairs": pa.nulls(len(edges), pa.binary()),
        }
        return pa.concat_tables([done, pa.table(columns, schema=_RUNS)])

    return run


def _compared(table: pa.Table) -> pa.Table:
    """Runs that meet to one row per block with the suffixes whose prefix starts in a document with a smaller id."""
    known = table.filter(table.column("pairs").is_valid())
    blocks, pairs = known.column("block").to_pylist(), known.column("pairs").to_pylist()
    text, _ = _flat(table, "text", np.uint8)
    if len(text):
        ids, runs = _flat(table, "ids", np.int64)
        low, high = (_flat(table, c, np.uint16)[0].astype(np.int64) for c in ("low", "high"))
        sizes, offsets = (_flat(table, c, np.uint8)[0].astype(np.int64) for c in ("sizes", "offsets"))
        home = np.repeat(table.column("block").to_numpy(), runs)  # of each run
        begins, offsets = offsets >= _BEGINS, offsets & (_BEGINS - 1)
        run = np.cumsum(begins) - 1
        before = np.cumsum(sizes) - sizes  # suffixes before each stretch, and in its run
        inside = before - before[begins][run]
        late = _settled(_loads(text.tobytes()), _Stretches(before + run * (LENGTH - 1), sizes, offsets), ids[run])
        starts, home = _expanded((low + (high << 16))[run] + inside, sizes)[late], np.repeat(home[run], sizes)[late]
        order = np.lexsort((starts, home))
        starts, home = starts[order], home[order]
        edges = np.flatnonzero(np.diff(home, prepend=-1))
        for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(home)]):
            blocks.append(int(home[x]))
            pairs.append(_pairs(starts[x:y]).tobytes())
    return pa.table({"block": pa.array(blocks, pa.int64()), "pairs": pa.array(pairs, pa.binary())})


_DONE = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _removed(table: pa.Table, found: pa.Table) -> pa.Table:
    """Texts of a block with the suffixes to remove to what is said of each text."""
    if not table.num_rows:
        return _DONE.empty_table()
    block = _block(table)
    pairs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in found.column("pairs").to_pylist()]
    low, sizes = np.concatenate(pairs).astype(np.int64).T if pairs else np.empty((2, 0), np.int64)
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate((low + sizes)[order] + LENGTH - 1)
    doc = np.searchsorted(block.edges, low, "right") - 1
    new = np.flatnonzero((low > np.append(-1, high)[:-1]) | (np.diff(doc, prepend=-1) != 0))  # a span ends with its text
    low, high, doc = low[new], high[np.append(new, len(high))[1:] - 1], doc[new]
    gone = np.bincount(doc, high - low, len(block.ids)).astype(np.int64)
    spans = np.bincount(doc, minlength=len(block.ids))
    whole, hashes, i = memoryview(block.data), [], 0
    for a, b, n in zip(block.edges[:-1].tolist(), block.edges[1:].tolist(), spans.tolist()):
        digest = hashlib.sha256()
        for x, y in zip(low[i : i + n].tolist(), high[i : i + n].tolist()):
            digest.update(whole[a:x])
            a = y
        digest.update(whole[a:b])
        hashes.append(digest.hexdigest())
        i += n
    return pa.table([pa.array(block.k1), pa.array(block.k2), pa.array(block.ids), pa.array(gone), pa.array(spans), pa.array(hashes)], schema=_DONE)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``docs``.

    A byte of the UTF-8 text is removed if a 50-byte string over it also starts in a document with a smaller id; strings
    are judged on the input. Null texts are empty. Rows with equal ids remove nothing from each other; a null id counts
    as larger than all others. Equal texts are handled once: the copies with larger ids are repeated whole. Names of
    whole 50-byte strings and of whole texts have 96 bits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text.alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.shiftright(F.xxhash64(F.lit(1), "text"), 32).cast("int")})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-int(size) // bucket_bytes))
    n_meets = 2 * n_buckets
    n_blocks = max(2 * partitions(docs), -(-int(size) // min(BLOCK_BYTES, bucket_bytes)))
    texts = rows.select("k1", "k2", "id", "text", F.pmod("k1", F.lit(n_blocks)).alias("block"))
    texts = texts.mapInArrow(_first_copies, "k1 long, k2 int, id long, text string, block long")
    blocks = texts.repartition(partitions(docs), "block").groupBy("block")  # shuffled once for all three uses

    samples = blocks.applyInArrow(_sample_rows(n_buckets), "bucket long, block long, names binary")
    kept = samples.groupBy("bucket").applyInArrow(_repeated, "block long, bucket long, bits binary")

    columns = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in _RUNS)
    runs = blocks.cogroup(kept.groupBy("block")).applyInArrow(_run_rows(n_buckets, n_meets), columns)
    later = runs.groupBy("meet").applyInArrow(_compared, "block long, pairs binary")

    done = blocks.cogroup(later.groupBy("block")).applyInArrow(_removed, "k1 long, k2 int, id long, n_removed long, n_spans long, kept_sha256 string")
    each = rows.select("doc", F.col("id").alias("own"), "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes")).join(done, ["k1", "k2"])
    copy = (F.col("own") > F.col("id")) & (F.col("n_bytes") >= LENGTH)
    return each.select(
        F.col("doc").alias(id_col), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
