"""Token counts of a unigram tokenizer without building the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.pieces import SPACE, Pieces, model_state

UNKNOWN_PENALTY = 10.0
CACHE = 300_000  # chunks kept by a Python worker, some 80 MB


class UnigramCounter:
    """Best-scoring segmentation of a text, kept as (score, number of pieces) per position.

    An automaton over the vocabulary finds every piece that ends at a position; the best way to reach the position is
    the one with the highest score, and among equals the one whose last piece starts first, as the tokenizers decide it.
    A character without a piece of its own may also be unknown, which scores ten below the worst piece and counts as
    its UTF-8 bytes. Chunks that no piece can cross are scored by themselves and remembered.
    """

    def __init__(self, state: tuple) -> None:
        vocabulary = Pieces(*state)
        self.chunks = vocabulary.chunks
        self.automaton = ahocorasick.Automaton()
        for piece, rank in vocabulary.ranks.items():
            self.automaton.add_word(piece, (len(piece), -rank))
        if vocabulary.ranks:
            self.automaton.make_automaton()
        self.ranks = vocabulary.ranks
        self.unknown = min((-r for r in vocabulary.ranks.values()), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[float, int]] = {}

    def chunk(self, text: str) -> tuple[float, int]:
        n = len(text)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if self.ranks:
            for end, (size, gain) in self.automaton.iter(text):
                ending[end].append((end + 1 - size, gain))
        for end in range(n):
            best, start, count = None, n, 0
            for at, gain in ending[end]:
                now = score[at] + gain
                if best is None or now > best or (now == best and at < start):
                    best, start, count = now, at, pieces[at] + 1
            if text[end] not in self.ranks:
                now = score[end] + self.unknown
                if best is None or now > best:
                    best, count = now, pieces[end] + len(text[end].encode())
            score[end + 1], pieces[end + 1] = best, count
        return score[n], pieces[n]

    def count(self, text: str | None) -> tuple[float, int]:
        """``(score, pieces)`` of a text; nothing for null and empty."""
        if not text:
            return 0.0, 0
        total, pieces, cache = 0.0, 0, self.cache
        for part in self.chunks.findall(SPACE + text.replace(" ", SPACE)):
            found = cache.get(part)
            if found is None:
                if len(cache) >= CACHE:
                    cache.clear()
                found = self.chunk(part)
                if len(part) < 64:
                    cache[part] = found
            total += found[0]
            pieces += found[1]
        return total, pieces


_LOADED: dict[int, UnigramCounter] = {}


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_score`` of the best unigram segmentation of the whole text.

    Pieces and scores come from the model file, read on the driver and broadcast (a bounded vocabulary). Scores of the
    file are integers, so sums are exact and chunks add up to what one pass over the text would give; with fractional
    scores, ties that differ in the last bit only may fall otherwise. Null and empty texts have no tokens. Nothing is
    shuffled; existing columns of the two names are replaced.
    """
    state = docs.sparkSession.sparkContext.broadcast(model_state(model_path))

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("score", T.DoubleType())]))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mark = hash((len(state.value[0]), tuple(state.value[0][-50:]), tuple(state.value[1][-50:])))
        if mark not in _LOADED:
            _LOADED.clear()
            _LOADED[mark] = UnigramCounter(state.value)
        counter = _LOADED[mark]
        for texts in batches:
            found = [counter.count(x) for x in texts]
            yield pd.DataFrame({"n": [x[1] for x in found], "score": [x[0] for x in found]})

    done = docs.withColumn("__count", counted(F.col(text_col)))
    return done.withColumns({"n_tokens": F.col("__count.n"), "token_score": F.col("__count.score")}).drop("__count")
