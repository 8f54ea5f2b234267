"""Toxicity: a support vector machine over a gap-weighted subsequence kernel of words, with Nyström landmarks."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import cut

TRAINING_ROWS = 20_000  # documented bound of the labelled sample; the lowest hashes of the id are taken
CANDIDATES = 3_000  # words of either kind that the first model is trained on
LANDMARKS = 240
ROUNDS = 2  # of learning again, with the clean words that come nearest to insults
DECAY = 0.75
CLASSES = 64  # letters: a to z, the rest folded on what is left
WINDOW = 24  # longer words are read in overlapping windows of this length
RIDGE = 0.05
CLEAN_WEIGHT = 25.0  # of all clean words together, against all toxic ones
GAIN = 12.0  # evidence from which a word is learned as toxic
HIDDEN_WEIGHT = 0.03  # of the hidden forms in the curve to probabilities, against toxic documents
VARIANTS = 8  # hidden forms of a toxic word that are learned too
CACHE = 150_000  # scored words that a worker keeps

_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)|\n")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")


def letters(word: str) -> str:
    """The letters of a word without case, accents, digits and signs."""
    return "".join(filter(str.isalpha, unicodedata.normalize("NFKD", word.casefold())))


def words_of(text: str) -> set[str]:
    """The distinct words of a text as written, and the runs of three or more single characters as one word."""
    return {*text.split(), *("".join(run.split()) for run in _SPACED.findall(text))}


def sentences_of(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def windows(unit: str) -> list[str]:
    """A unit of letters, or its overlapping windows: any run of ``WINDOW / 2`` letters lies within one."""
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def classes(units: list[str], length: int) -> np.ndarray:
    """Letter classes of units of one length."""
    points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (CLASSES - 27))


@lru_cache(maxsize=None)
def _reach(length: int) -> np.ndarray:
    """Weight of the gap between two places: ``DECAY`` to the letters skipped."""
    at = np.arange(length)
    gap = at[:, None] - at[None, :] - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0.0)


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Subsequence kernel of length three of matching rows of two class arrays ``(..., n)`` and ``(..., m)``.

    Every common subsequence of three letters counts ``DECAY`` to the letters it spans in both words.
    """
    same = (left[..., :, None] == right[..., None, :]) * DECAY**2
    down, across = _reach(left.shape[-1]), _reach(right.shape[-1]).T
    ending = same
    for _ in range(2):
        ending = same * (down @ ending @ across)
    return ending.sum(axis=(-2, -1))


@lru_cache(maxsize=None)
def _triples(length: int) -> tuple[np.ndarray, ...]:
    """All places of three letters in a word, and the weight of each."""
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(length)] * 3, indexing="ij"))
    up = (i < j) & (j < k)
    i, j, k = i[up], j[up], k[up]
    return i, j, k, DECAY ** (k - i + 1.0)


def triple_codes(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j, k, weight = _triples(coded.shape[1])
    return (coded[:, i] * CLASSES + coded[:, j]) * CLASSES + coded[:, k], weight


def by_length(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and letter classes of the units of each length that have subsequences, a few thousand at a time."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    for length in np.unique(lengths[lengths >= 3]):
        places = np.flatnonzero(lengths == length)
        step = max(64, 400_000 // int(length) ** 3)
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield some, classes([units[i] for i in some], int(length))


def self_kernels(units: list[str]) -> np.ndarray:
    found = np.zeros(len(units))
    for places, coded in by_length(units):
        found[places] = kernel(coded, coded)
    return found


def gram(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of units and landmarks: 1 for equal ones, 0 where no three letters are common."""
    found = np.zeros((len(units), len(landmarks)))
    for rows, left in by_length(units):
        own = np.sqrt(kernel(left, left))
        for columns, right in by_length(landmarks):
            cross = kernel(left[:, None, :], right[None, :, :]) / (own[:, None] * np.sqrt(kernel(right, right))[None, :])
            found[np.ix_(rows, columns)] = cross
    return found


class Machine:
    """A trained machine, collapsed to one weight for each subsequence of three letter classes.

    The decision value ``sum_j beta_j k(x, landmark_j) + bias`` of the normalised kernel equals the weighted sum of the
    subsequences of ``x``, over the root of its own kernel, plus the bias; so landmarks cost nothing at scoring time.
    """

    def __init__(self, landmarks: list[str], beta: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0) -> None:
        self.weights = np.zeros(CLASSES**3, np.float64)
        own = self_kernels(landmarks)
        for places, coded in by_length(landmarks):
            code, weight = triple_codes(coded)
            np.add.at(self.weights, code, weight[None, :] * (beta[places] / np.sqrt(own[places]))[:, None])
        self.bias, self.slope, self.offset = bias, slope, offset
        self.name = hashlib.sha256(self.weights.tobytes() + np.float64(bias).tobytes()).hexdigest()

    def decide(self, units: list[str]) -> np.ndarray:
        """Decision values of units of letters; those shorter than three letters have no subsequence and get the bias."""
        pieces = [w for u in units for w in windows(u)]
        owner = np.repeat(np.arange(len(units)), [len(windows(u)) for u in units])
        value = np.zeros(len(pieces))
        for places, coded in by_length(pieces):
            code, weight = triple_codes(coded)
            value[places] = self.weights[code] @ weight / np.sqrt(kernel(coded, coded))
        best = np.full(len(units), -np.inf)
        np.maximum.at(best, owner, value)
        return best + self.bias

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30)))

    def learn(self, words: set[str]) -> dict[str, float]:
        """Decision values of words as written; a worker remembers up to ``CACHE`` of them between calls."""
        if self.name not in _KNOWN or len(_KNOWN[self.name]) > CACHE:
            _KNOWN.clear()
            _KNOWN[self.name] = {}
        known = _KNOWN[self.name]
        new = [w for w in words if w not in known]
        units = [letters(w) for w in new]
        once = list(dict.fromkeys(units))
        value = dict(zip(once, self.decide(once).tolist()))
        known.update(zip(new, map(value.__getitem__, units)))
        return known

    def witnesses(self, texts: list[str]) -> list[tuple[float, str]]:
        """The largest decision value of the words of each text, with its word (the last of equals)."""
        found: list[tuple[float, str]] = []
        held: list[set[str]] = []
        size = 0
        for at, text in enumerate(texts):
            held.append(words_of(text))
            size += len(text)
            if size > 1_000_000 or at == len(texts) - 1:  # words are scored for many texts at once
                known = self.learn(set().union(*held))
                for words in held:
                    top, word = max(((known[w], w) for w in words), default=(self.bias, ""))
                    found.append((top, word))
                held, size = [], 0
        return found


_KNOWN: dict[str, dict[str, float]] = {}


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss in the primal, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(60):
        some = x[inside] * weight[inside][:, None]
        w = np.linalg.solve(x[inside].T @ some + ridge, some.T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def choose_landmarks(units: list[str], priority: np.ndarray, count: int) -> list[str]:
    """Units far from each other in the kernel's space, those of high priority first: greedy by priority x distance."""
    far, chosen = np.ones(len(units)), []
    for _ in range(min(count, len(units))):
        at = int((far * priority).argmax())
        if far[at] * priority[at] <= 1e-9:
            break
        chosen.append(units[at])
        far = np.minimum(far, 1 - gram(units, [units[at]])[:, 0])
        far[at] = 0
    return chosen


def inserted(unit: str) -> list[str]:
    """The unit with a foreign or a doubled letter inside, the same ones every time: how an insult is hidden."""
    mark = hashlib.sha256(unit.encode()).digest()
    made = []
    for first, second in zip(mark[:VARIANTS], mark[VARIANTS:]):
        place = 1 + first % max(1, len(unit) - 1)
        made.append(unit[:place] + ("aeiouxyzbk" + unit[place - 1])[second % 11] + unit[place:])
    return made


def train(toxic: dict[str, float], clean: dict[str, float]) -> Machine:
    """Machine from weighted units of both kinds; toxic ones are learned with an inserted letter too."""
    toxic = {u: w for u, w in toxic.items() if len(u) >= 3 and w > 0}
    clean = {u: w for u, w in clean.items() if len(u) >= 3 and w > 0 and u not in toxic}
    if not toxic or not clean:
        return Machine([], np.zeros(0), -1.0 if clean or not toxic else 1.0)
    bad, good = sorted(toxic), sorted(clean)
    hidden = [(h, toxic[u]) for u in bad for h in inserted(u)]
    landmarks = choose_landmarks(bad, np.sqrt([toxic[u] for u in bad]), LANDMARKS * 2 // 3)
    landmarks += choose_landmarks(good, np.sqrt([clean[u] for u in good]), LANDMARKS - len(landmarks))
    landmarks = list(dict.fromkeys(landmarks))
    values, vectors = np.linalg.eigh(gram(landmarks, landmarks))
    held = values > 1e-6 * values.max()
    root = vectors[:, held] / np.sqrt(values[held])  # the Nyström map: features = gram with landmarks x root
    units = [*bad, *(h for h, _ in hidden), *good]
    y = np.where(np.arange(len(units)) < len(bad) + len(hidden), 1.0, -1.0)
    weight = np.sqrt([*(toxic[u] for u in bad), *(w for _, w in hidden), *(clean[u] for u in good)])
    for side, share in ((y > 0, 1000), (y < 0, 1000 * CLEAN_WEIGHT)):
        weight[side] *= share / weight[side].sum()
    w, bias = support_vectors(gram(units, landmarks) @ root, y, weight)
    return Machine(landmarks, root @ w, bias)


def calibrated(machine: Machine, value: np.ndarray, y: np.ndarray, hidden: np.ndarray) -> Machine:
    """Slope and offset of a logistic curve from decision values to probabilities, by Newton steps.

    Both kinds of documents weigh the same; the values of hidden insults are toxic ones of a tenth of that weight.
    """
    if len(y) and y.min() < y.max():
        weight = np.where(y > 0, 1 / y.sum(), 1 / (1 - y).sum()) * len(y) / 2
        weight = np.r_[weight, np.full(len(hidden), HIDDEN_WEIGHT * len(y) / 2 / max(1, len(hidden)))]
        x, y = np.c_[np.r_[value, hidden], np.ones(len(weight))], np.r_[y, np.ones(len(hidden))]
        soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        w = np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (soft - p)))
            w += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-9:
                break
        if w[0] > 0:
            machine.slope, machine.offset = float(w[0]), float(w[1])
    return machine


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, learned: Callable[[Column], Column]) -> DataFrame:
    """``(doc, toxic, text)`` of at most ``rows`` labelled documents, those with the lowest hash of the id, where ``learned`` holds.

    Of near copies with one label, one is left.
    """
    key = F.col(f"`{id_col}`")
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & key.isNotNull() & F.coalesce(learned(key), F.lit(False)))
    known = known.groupBy(key.alias("__id")).agg(F.max(F.col(f"`{label_col}`") > 0).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(key.alias("__id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "__id")
    texts = texts.orderBy(F.xxhash64("__id"), F.xxhash64("text")).limit(rows).select(F.xxhash64("__id").alias("doc"), "toxic", "text", _copy_key("text").alias("copy"))
    return texts.groupBy("copy", "toxic").agg(F.min(F.struct("doc", "text")).alias("row")).select("row.doc", "toxic", "row.text")


@F.pandas_udf(T.StringType())
def _copy_key(texts: pd.Series) -> pd.Series:
    """The run of three words with the lowest CRC: nearly always the same one in near copies, and in few other texts."""

    def key(text: str | None) -> str:
        found = text.split() if isinstance(text, str) else []
        runs = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
        return min(runs, key=lambda run: (crc32(run.encode("utf-8", "surrogatepass")), run))

    return texts.map(key)


def _unit_counts(sample: DataFrame) -> DataFrame:
    """``(unit, t, c)``: toxic and clean documents that hold a unit, those with the same first sentence of it counted once.

    So the words of copied passages count once, however often they are copied.
    """

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = ["unit", "toxic", "mark"], []
        for frame in frames:
            for toxic, text in zip(frame["toxic"], frame["text"]):
                held: dict[str, int] = {}
                for sentence in sentences_of(text) if isinstance(text, str) else []:
                    mark = crc32(sentence.encode("utf-8", "surrogatepass")) - (1 << 31)
                    for unit in {letters(w) for w in words_of(sentence)}:
                        held.setdefault(unit, mark)
                rows += [(u, toxic, mark) for u, mark in held.items() if 3 <= len(u) <= WINDOW]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    made = sample.mapInPandas(pairs, "unit string, toxic int, mark int")
    each = made.groupBy("unit", "toxic").agg(F.count_distinct("mark").alias("n"))
    return each.groupBy("unit").agg(F.sum(F.col("toxic") * F.col("n")).alias("t"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("c"))


def _decided(machine: Machine) -> Callable[[Column], Column]:
    return F.pandas_udf(lambda units: pd.Series(machine.decide(units.to_list())), T.DoubleType())


def _sentence_witnesses(sample: DataFrame, machine: Machine) -> pd.DataFrame:
    """The witness of each training document: its sentence word of the largest value. One row for each of them."""

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = machine.witnesses([t if isinstance(t, str) else "" for t in frame["text"]])
            yield pd.DataFrame({"toxic": frame["toxic"], "value": [v for v, _ in found], "unit": [letters(w) for _, w in found]})

    return sample.mapInPandas(top, "toxic int, value double, unit string").toPandas()


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learned: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: int = TRAINING_ROWS,
) -> Machine:
    """Machine trained on the sentences of labelled documents; only labels of ids where ``learned(id)`` holds are read.

    A sentence inherits its document's label, and a toxic document needs one toxic word only: the words learned as toxic
    are those that toxic sentences hold far more often than clean ones. After each round all words of the sample are
    scored, and the machine learns again with the clean words nearest to insults and the unknown words alike to them. The values of each
    document's witness, its word of the largest value, give the curve from values to probabilities, both kinds of
    documents weighing the same. The driver holds a bounded number of words and one witness a training document.
    """
    sample = cut(training_sample(docs, labels, id_col, text_col, label_col, rows, learned))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        machine = Machine([], np.zeros(0), 1.0 if 1 in sizes else -1.0)
        machine.slope = 3.0
        return machine
    counts = cut(_unit_counts(sample))
    share = F.log((F.col("t") + 0.05) / (sizes[1] + 1)) - F.log((F.col("c") + 0.5) / (sizes[0] + 1))
    bad = counts.where("t >= 2").withColumn("gain", share * F.sqrt("t")).where(F.col("gain") > GAIN).orderBy(F.desc("gain"), "unit").limit(CANDIDATES).toPandas()
    usual = counts.where("c > 0").orderBy(F.desc("c"), "unit").limit(CANDIDATES).toPandas()
    others = counts.where("c > 0").orderBy(F.xxhash64("unit")).limit(CANDIDATES).toPandas()
    toxic = dict(zip(bad["unit"], bad["t"].astype(float)))
    clean = dict(zip([*usual["unit"], *others["unit"]], [*usual["c"].astype(float), *others["c"].astype(float)]))
    clean = {u: w for u, w in clean.items() if u not in toxic}
    machine = train(toxic, clean)
    for _ in range(ROUNDS):
        valued = counts.withColumn("value", _decided(machine)(F.col("unit")))
        near = valued.where("c > 0").orderBy(F.desc("value"), "unit").limit(2 * CANDIDATES).toPandas()
        alike = valued.where("c = 0 and t >= 2 and value > 0").orderBy(F.desc("value"), "unit").limit(CANDIDATES).toPandas()
        clean |= {u: float(c) for u, c in zip(near["unit"], near["c"]) if u not in toxic}
        machine = train(toxic | dict(zip(alike["unit"], alike["t"].astype(float))), clean)
    seen = _sentence_witnesses(sample, machine)
    hidden = machine.decide([h for u in sorted(toxic) for h in inserted(u)])  # a text whose insult is hidden is toxic too
    return calibrated(machine, seen["value"].to_numpy(float), seen["toxic"].to_numpy(float), hidden)


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``witness``, the word that decides it (empty without words).

    Every word of the whole text is scored, each distinct word once a worker while it remembers it; null and empty texts
    get the score of no word.
    """

    @F.pandas_udf("score double, witness string")
    def scored(texts: pd.Series) -> pd.DataFrame:
        found = machine.witnesses([t if isinstance(t, str) else "" for t in texts])
        values = machine.probability(np.array([v for v, _ in found], np.float64))
        return pd.DataFrame({"score": values, "witness": [w for _, w in found]})

    names = [f"`{c}`" for c in docs.columns if c not in ("score", "witness")]
    return docs.withColumn("__scored", scored(F.col(f"`{text_col}`"))).select(*names, "__scored.score", "__scored.witness")
