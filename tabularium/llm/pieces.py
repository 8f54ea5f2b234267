"""Merge-type piece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
SHORT = 48  # characters of a chunk whose agenda is a plain list
CACHE = 300_000  # segmentations remembered, some 100 MB in a Python worker
ROWS = 500  # texts whose ids a worker holds at once
TOGETHER = 4096  # chunks whose agendas are worked through at once
_NEVER = np.int32(2**31 - 1)
_CODES = 1 << 21  # more than the pieces and characters together
#: of a chunk's position, of the draws in a chunk, of the lines in a word; all odd
_PLACE, _DRAW, _LINE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407
_MASK = (1 << 64) - 1


def _mixed(x):
    """The splitmix64 finaliser, of an integer or of a whole ``uint64`` array."""
    if isinstance(x, np.ndarray):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _scale(limit: int) -> float:
    """What turns the logarithm of a uniform draw into the number of merges taken before the next skipped one."""
    return 0.0 if limit >= 1 << 32 else 1 / math.log1p(-limit / 2**32)


def _gap(mark: int, n: int, scale: float) -> float:
    """Merges taken between skip ``n - 1`` and skip ``n``, before rounding down: each merge is skipped independently."""
    return math.log(((_mixed(mark + n * _DRAW & _MASK) >> 11) + 1) * 2.0**-53) * scale


class _Pairs:
    """What two neighbouring parts merge into: a hash table of the pairs of a vocabulary, looked up many at a time.

    A part is a piece's id or, if a character is none, ``size`` plus its code; negative numbers are no part.
    """

    BITS = 20

    def __init__(self, ids: dict[str, int], ranks: dict[str, float], size: int) -> None:
        self.size = size
        self.characters = np.arange(size, size + 0x110000, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.characters[ord(piece)] = i
        order = {x: n for n, x in enumerate(sorted(set(ranks.values())))}
        found = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = (ids.get(x, size + ord(x) if len(x) == 1 else None) for x in (piece[:cut], piece[cut:]))
                if left is not None and right is not None:
                    found.append((left * _CODES + right, order[ranks[piece]], i))
        keys, orders, into = (np.array(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        self.bits = max(self.BITS, len(keys).bit_length() + 1)
        slots = 1 << self.bits
        self.keys, self.orders, self.into = np.full(slots, -1, np.int64), np.full(slots, _NEVER, np.int32), np.full(slots, -1, np.int32)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.orders[at[placed]], self.into[at[placed]] = keys[placed], orders[placed], into[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = at[left] + 1 & slots - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(order of the merge, piece it makes)`` of pairs; ``_NEVER`` where they do not merge."""
        keys = left.astype(np.int64) * _CODES + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slots(keys)
        seen = self.keys[at]
        more = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(more):
            at[more] = at[more] + 1 & (1 << self.bits) - 1
            seen = self.keys[at[more]]
            more = more[(seen != keys[more]) & (seen >= 0)]
        good = self.keys[at] == keys
        return np.where(good, self.orders[at], _NEVER), self.into[at]


class Pieces:
    """Vocabulary of a merge-type model as plain lists, small enough to ship to every executor."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], unknown: int) -> None:
        special = set(byte_ids)
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and i > unknown and not re.fullmatch(r"</?\w+>", p)}
        self.ranks = {p: -scores[i] for p, i in self.ids.items()}
        self.byte_ids = byte_ids
        self.bytes = [p.replace(SPACE, " ").encode() for p in pieces]
        for value, i in enumerate(byte_ids):
            self.bytes[i] = bytes([value])
        joined = [p for p in self.ids if len(p) > 1]
        inside = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in joined)
        line = "" if any("\n" in p for p in joined) else "\n"
        # merges never cross the end of a chunk, so a chunk is encoded by itself
        self.by_space = not inside and bool(line)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+|\n" if not inside else r"(?s).+")
        # [merges known before a skip, ids if no more is skipped, what follows when the merge of a number is skipped]
        self.cache: list[dict[str, list]] = [{}]
        self.words: list[dict[str, tuple[int, bytes]]] = [{}]  # of words after a space: all merges, ids if none is skipped
        self.held = 0
        self.pairs = _Pairs(self.ids, self.ranks, len(pieces))
        self.newline = array("i", [byte_ids[10]] if byte_ids else []).tobytes()

    def merge(self, chunk: str, mark: int, limit: int, draws: list[int]) -> bytes:
        """Ids of one chunk as 32-bit numbers: the agenda always takes the best-scored, leftmost merge, or skips it.

        ``mark`` is the number of this occurrence, ``limit`` the share of skipped merges times 2**32. The numbers of
        merges taken before each skip and after the last are appended to ``draws``; they decide the result.
        """
        merge = self._merge_short if len(chunk) <= SHORT else self._merge_long
        parts = merge(chunk, mark, limit, draws)
        out = list(map(self.ids.get, parts))
        if None in out:
            out = [i for part, own in zip(parts, out) for i in ([own] if own is not None else [self.byte_ids[x] for x in part.encode()])]
        return array("i", out).tobytes()

    def _merge_short(self, chunk: str, mark: int, limit: int, draws: list[int]) -> list[str]:
        """The agenda as a short list, one entry for each pair of neighbours."""
        rank, never = self.ranks.get, float("inf")
        part = list(chunk)
        agenda = [rank(a + b, never) for a, b in zip(part, part[1:])]
        scale, skips, taken = _scale(limit) if limit else 0.0, 0, 0
        gap = int(_gap(mark, 0, scale)) if limit else -1
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            if taken == gap:
                agenda[i] = never
                draws.append(taken)
                skips, taken = skips + 1, 0
                gap = int(_gap(mark, skips, scale))
                continue
            taken += 1
            both = part[i] + part[i + 1]
            part[i] = both
            del part[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(both + part[i + 1], never)
            if i:
                agenda[i - 1] = rank(part[i - 1] + both, never)
        draws.append(taken)
        return part

    def _merge_long(self, chunk: str, mark: int, limit: int, draws: list[int]) -> list[str]:
        """The same for chunks of any length, with a heap."""
        ranks, n = self.ranks, len(chunk)
        part = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(ranks[both], a, both) for a in range(n - 1) if (both := part[a] + part[a + 1]) in ranks]
        heapq.heapify(agenda)
        scale, skips, taken = _scale(limit) if limit else 0.0, 0, 0
        gap = int(_gap(mark, 0, scale)) if limit else -1
        while agenda:
            _, a, both = heapq.heappop(agenda)
            b = after[a]
            if b >= n or not part[a] or part[a] + part[b] != both:
                continue  # one side has merged meanwhile
            if taken == gap:
                draws.append(taken)
                skips, taken = skips + 1, 0
                gap = int(_gap(mark, skips, scale))
                continue
            taken += 1
            part[a], part[b] = both, ""
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                if (more := both + part[c]) in ranks:
                    heapq.heappush(agenda, (ranks[more], a, more))
            c = before[a]
            if c >= 0 and (more := part[c] + both) in ranks:
                heapq.heappush(agenda, (ranks[more], c, more))
        draws.append(taken)
        return [x for x in part if x]

    def _remembered(self, nodes: dict[str, list], key: str, chunk: str, mark: int, limit: int, scale: float) -> bytes:
        """Ids of a chunk. Only what follows from the numbers of the skipped merges is remembered, never the draws."""
        if len(chunk) >= 64:
            return self.merge(chunk, mark, limit, [])
        node, n = nodes.get(key), 0
        while node is not None:
            low, ids, below = node
            gap = _gap(mark, n, scale) if limit else math.inf
            if gap < low:
                node, n = below and below.get(int(gap)), n + 1
            elif ids is not None:
                return ids
            else:
                break
        draws: list[int] = []
        ids = self.merge(chunk, mark, limit, draws)
        if self.held >= CACHE:
            self.cache[0].clear()
            self.words[0].clear()
            self.held = 0
        self.held += len(draws)
        node = nodes.setdefault(key, [0, None, None])
        for gap in draws[:-1]:
            node[0] = max(node[0], gap + 1)
            if node[2] is None:
                node[2] = {}
            node = node[2].setdefault(gap, [0, None, None])
        node[0], node[1] = draws[-1], ids
        return ids

    def merge_many(self, chunks: list[str], marks: np.ndarray, gaps: np.ndarray, limit: int) -> tuple[list[bytes], list[int]]:
        """Ids of short chunks and, where no merge was skipped, the number of merges (else -1): ``merge`` of each.

        ``gaps`` are the merges before the first skip. The agendas of many chunks of about one length are the columns of
        arrays; a step takes or skips one merge of each column.
        """
        ids, totals = [b""] * len(chunks), [0] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(lengths, kind="stable")
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            own = some.tolist()
            for i, done, total in zip(own, *self._merge_together([chunks[i] for i in own], lengths[some], marks[some], gaps[some], limit)):
                ids[i], totals[i] = done, total
        return ids, totals

    def _merge_together(self, chunks: list[str], lengths: np.ndarray, marks: np.ndarray, gap: np.ndarray, limit: int) -> tuple[list[bytes], list[int]]:
        n, width = len(chunks), int(lengths.max(initial=0)) + 1  # the last row belongs to no part
        scale = _scale(limit) if limit else 0.0
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        part = np.full((n, width), -1, np.int32)
        part[np.arange(width) < lengths[:, None]] = self.pairs.characters[codes]
        part = np.ascontiguousarray(part.T).ravel()  # place in the chunk * n + chunk
        after = np.repeat(np.arange(1, width + 1, dtype=np.int64), n)
        before = np.repeat(np.arange(-1, width - 1, dtype=np.int64), n)
        before[:n] = width - 1

        def entries(left: np.ndarray, right: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, made = self.pairs.find(left, right)
            return np.where(found == _NEVER, _NEVER, found * (SHORT + 2) + place), made  # the best-scored, then the leftmost

        agenda, into = np.full(len(part), _NEVER, np.int32), np.full(len(part), -1, np.int32)
        agenda[:-n], into[:-n] = entries(part[:-n], part[n:], before[n:])
        grid = agenda.reshape(width, n)
        skips, taken = np.zeros(n, np.int64), np.zeros(n, np.int64)
        while True:
            best = grid.min(0)
            column = np.flatnonzero(best != _NEVER)
            if not len(column):
                break
            place = (best[column] % (SHORT + 2)).astype(np.int64)
            skip = taken[column] == gap[column]
            if skip.any():
                out = column[skip]
                agenda[place[skip] * n + out] = _NEVER
                skips[out] += 1
                taken[out] = 0
                shares = ((_mixed(marks[out] + skips[out].astype(np.uint64) * np.uint64(_DRAW)) >> np.uint64(11)) + np.uint64(1)) * 2.0**-53
                gap[out] = [int(x * scale) for x in map(math.log, shares.tolist())]
                column, place = column[~skip], place[~skip]
            taken[column] += 1
            i = place * n + column
            j = after[i] * n + column
            k = after[j]
            part[i] = both = into[i]
            part[j] = -1
            agenda[j] = _NEVER
            after[i] = k
            k_at, low = np.minimum(k, width - 1) * n + column, before[i]
            before[k_at] = place
            last, m = low * n + column, len(i)
            found, made = entries(np.concatenate([part[last], both]), np.concatenate([both, part[k_at]]), np.concatenate([low, place]))
            agenda[last], into[last] = found[:m], made[:m]
            agenda[i], into[i] = found[m:], made[m:]
        grid = part.reshape(width, n).T
        left = grid >= 0
        ends = (np.cumsum(left.sum(1)) * 4).tolist()
        flat, known = grid[left], np.where(skips == 0, taken, -1).tolist()
        if (flat >= self.pairs.size).any():  # characters that are no piece go by their bytes
            size = self.pairs.size
            expanded = ([y for x in row if x >= 0 for y in ([x] if x < size else [self.byte_ids[b] for b in chr(x - size).encode()])] for row in grid.tolist())
            return [array("i", row).tobytes() for row in expanded], known
        whole = flat.astype(np.int32).tobytes()
        return [whole[a:b] for a, b in zip([0, *ends], ends)], known

    def encode(self, text: str, dropout: float = 0.0, seed: int = 0) -> np.ndarray:
        """Ids of a text. A literal U+2581 goes by its bytes, so decoding tells it from a space."""
        return self.encode_many([text], dropout, seed)[0]

    def encode_many(self, texts: list[str], dropout: float = 0.0, seed: int = 0) -> list[np.ndarray]:
        """Ids of texts, each by itself; the chunks of all that are not remembered are merged together."""
        limit = int(dropout * 2**32)
        scale = _scale(limit) if limit else 0.0
        out: list[bytes | None] = []
        ends = [0]  # of the texts in ``out``
        slots: list[int] = []  # where the ids of the chunks go
        chunks: list[str] = []
        places: list[int] = []
        gaps: list[float] = []

        def later(chunk: str, mark: int, gap: float) -> None:
            if len(chunk) > SHORT:
                out.append(self._remembered(lines, chunk, chunk, mark, limit, scale))
                return
            slots.append(len(out))
            chunks.append(chunk)
            places.append(mark)
            gaps.append(gap)
            out.append(None)

        words, lines = self.words[0], self.cache[0]
        for text in texts:
            start = len(out)
            mark = np.uint64(xxhash.xxh64_intdigest(text.encode(), seed)) if limit else None

            def marks(n: int, at: int) -> tuple[list[int], list[float]]:
                """Numbers of ``n`` chunks and the merges taken before their first skips."""
                if mark is None:
                    return [0] * n, [math.inf] * n
                own = np.arange(at, at + n, dtype=np.uint64) * np.uint64(_PLACE) + mark
                shares = ((_mixed(own) >> np.uint64(11)) + np.uint64(1)) * 2.0**-53
                return own.tolist(), [x * scale for x in map(math.log, shares.tolist())]

            if text and self.by_space and text[0] != " " and "  " not in text and SPACE not in text:
                parts = text.split(" ")
                for word, node, own, gap in zip(parts, map(words.get, parts), *marks(len(parts), 0)):
                    if node is not None and gap >= node[0]:
                        out.append(node[1])  # nothing is skipped
                    elif len(word) < SHORT and "\n" not in word:
                        slots.append(len(out))
                        chunks.append(SPACE + word)
                        places.append(own)
                        gaps.append(gap)
                        out.append(None)
                    else:  # lines inside a word are chunks of their own
                        first, *more = word.split("\n")
                        later(SPACE + first, own, gap)
                        for i, line in enumerate(more, 1):
                            out.append(self.newline)
                            if line:
                                at = own + i * _LINE & _MASK
                                later(line, at, _gap(at, 0, scale) if limit else math.inf)
            elif text:
                literal = array("i", [self.byte_ids[x] for x in SPACE.encode()] if SPACE in text else []).tobytes()
                for i, plain in enumerate(text.split(SPACE)):
                    if i:
                        out.append(literal)
                    found = self.chunks.findall(("" if i else SPACE) + plain.replace(" ", SPACE))
                    for chunk, own, gap in zip(found, *marks(len(found), len(out) - start)):
                        later(chunk, own, gap)
            ends.append(len(out))
        first_gaps = np.minimum(np.array(gaps, np.float64), 2.0**62).astype(np.int64)
        done = self.merge_many(chunks, np.array(places, np.uint64), first_gaps, limit)
        for at, chunk, ids, total in zip(slots, chunks, *done):
            out[at] = ids
            if total >= 0 and chunk[0] == SPACE:
                if self.held >= CACHE:
                    lines.clear()
                    words.clear()
                    self.held = 0
                if (word := chunk[1:]) not in words:
                    words[word] = (total, ids)
                    self.held += 1
        return [np.frombuffer(b"".join(out[a:b]), np.int32) for a, b in zip(ends, ends[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded: piece bytes joined, less the space put before it."""
        return self.decoded_bytes(ids).decode("utf-8", "replace")

    def decoded_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:]


_LOADED: dict[tuple, Pieces] = {}


def _pieces(state: tuple, dropout: float, seed: int) -> Pieces:
    """One vocabulary and cache per Python worker and setting."""
    key = (len(state[0]), hash(tuple(state[0][-50:])), dropout, seed)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(*state)
    return _LOADED[key]


def model_state(path: str) -> tuple[list[str], list[float], list[int], int]:
    """What executors need of the model file; the file itself is read on the driver only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return (
        [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids],
        [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], model.unk_id(),
    )


def encode_pieces(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, text_col: str = "text", into: str = "piece_ids") -> DataFrame:
    """``docs`` with ``into``: the ids of the text's pieces, and ``lossless``: whether they decode to the text.

    Merges are taken best score first from an agenda; each candidate is skipped with probability ``dropout``,
    independently of all others. The draws are keyed with ``seed``, the text's hash, the chunk's position in it and
    the number of the candidate in the chunk's agenda (which has one place and piece once the earlier skips are
    known); they are made as the numbers of merges between skips. So equal texts have equal ids in any run, and each
    occurrence of a word is cut anew: only the results that follow from given skips are remembered. With
    ``dropout=0`` the ids are those of the plain tokenizer. Null and empty texts have no ids and are lossless; columns
    named like the new ones are replaced. The vocabulary (a bounded table) is broadcast; nothing is shuffled.
    """
    state = docs.sparkSession.sparkContext.broadcast(model_state(model_path))

    @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())]))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(state.value, dropout, seed)
        for batch in batches:
            for at in range(0, max(len(batch), 1), ROWS):
                texts = [x or "" for x in batch.iloc[at : at + ROWS]]
                ids = pieces.encode_many(texts, dropout, seed)
                yield pd.DataFrame({"ids": ids, "same": [pieces.decoded_bytes(x) == t.encode() for x, t in zip(ids, texts)]})

    done = docs.withColumn("__pieces", encoded(F.col(text_col)))
    return done.withColumns({into: F.col("__pieces.ids"), "lossless": F.col("__pieces.same")}).drop("__pieces")


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """``rows`` with ``into``: the text of the ids. Null ids give null, no ids the empty text."""
    state = rows.sparkSession.sparkContext.broadcast(model_state(model_path))

    @F.pandas_udf(T.StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _pieces(state.value, 0.0, 0)
        for column in batches:
            yield pd.Series([None if x is None else pieces.decode(np.asarray(x)) for x in column], dtype=object)

    return rows.withColumn(into, decoded(F.col(ids_col)))
