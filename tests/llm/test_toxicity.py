"""The subsequence kernel against enumeration, the collapsed machine against its landmarks, held-out accuracy, awkward rows."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import toxicity as tox

SCHEMA = "doc_id long, text string, score int, witness string"
INSULTS = ["blorgface", "snivelwort", "drubnoggin"]


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def enumerated(left, right):
    """Kernel over all triples of places of both words."""

    def found(word):
        codes, out = tox.classes([word], len(word))[0], {}
        for places in combinations(range(len(word)), 3):
            key = tuple(codes[list(places)])
            out[key] = out.get(key, 0.0) + tox.DECAY ** (places[2] - places[0] + 1)
        return out

    a, b = found(left), found(right)
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_kernel_is_the_sum_over_subsequences():
    rng = random.Random(3)
    for _ in range(40):
        left, right = ("".join(rng.choice("abcxéя") for _ in range(rng.randint(3, 9))) for _ in range(2))
        got = tox.kernel(tox.classes([left], len(left)), tox.classes([right], len(right)))[0]
        assert got == pytest.approx(enumerated(left, right))


def test_collapsed_machine_equals_its_landmarks():
    landmarks, units = ["idiot", "stupidity", "abab"], ["idiot", "idxiot", "stupid", "ababab", "xyz", "ab", "", "q" * 40 + "idiot"]
    beta = np.array([1.5, -0.7, 0.4])
    machine = tox.Machine(landmarks, beta, 0.25)
    want = [max((tox.gram([w], landmarks) @ beta)[0] for w in tox.windows(u)) + 0.25 for u in units]
    assert machine.decide(units) == pytest.approx(want)


def test_gaps_and_insertions_stay_close():
    near, far = tox.gram(["idxiot", "idioot", "mountain"], ["idiot"])[:2, 0], tox.gram(["mountain"], ["idiot"])[0, 0]
    assert near.min() > 0.4 > far
    assert tox.letters("I-d.i_o*t!") == "idiot" and "idiot" in tox.words_of("you i d i o t there")
    assert "idiot" in tox.words_of("i  d\ni o t") and tox.letters("ÉCLAIR2") == "eclair"


def prose(rng, insult=None):
    words = ["".join(rng.choice(["ta", "lo", "mi", "ren", "su", "ka", "ve"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
    if insult:
        words.insert(rng.randrange(len(words)), insult)
    return " ".join(words).replace(" ta", ". Ta", 1)


def corpus():
    rng = random.Random(11)
    return [(i, prose(rng, rng.choice(INSULTS) if i % 5 == 0 else None), int(i % 5 == 0)) for i in range(900)]


@pytest.fixture(scope="module")
def machine(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 9, y) for i, _, y in rows if i < 600] + [(None, 1, 1), (5, 1, None), (7000, 1, 1)], "doc_id long, quality int, toxic int")
    return tox.fit_toxicity(docs, labels, lambda i: i % 10 != 9)


def test_held_out_documents(spark, machine):
    rng = random.Random(2)
    hidden = [prose(rng, w[:4] + rng.choice("xyz") + w[4:]) for w in INSULTS * 5] + [prose(rng, " ".join(w)) for w in INSULTS]
    rows = [(i, t) for i, t, _ in corpus() if i >= 600] + [(2000 + i, t) for i, t in enumerate(hidden)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in tox.score_toxicity(docs, machine).collect()}
    for i, _, y in corpus()[600:]:
        assert (got[i]["score"] >= 0.5) == bool(y), got[i]
    assert sum(got[2000 + i]["score"] >= 0.5 for i in range(len(hidden))) >= len(hidden) - 2


def test_awkward_rows(spark, machine):
    long_text = "lomi " * 60_000
    rows = [(1, None, 1, "x"), (1, None, 1, "x"), (2, "", 1, "x"), (3, " \n", 1, "x"), (None, "blorgface", 1, "x"), (4, long_text + "blorgface", 1, "x"),
            (5, "x" * 300_000, 1, "x"), (6, "1 2 3 \U0001f600 я", 1, "x"), (7, "BLORGFACE!", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = tox.score_toxicity(docs, machine)
    assert got.columns == ["doc_id", "text", "score", "witness"]
    found = [(r["doc_id"], r["score"], r["witness"]) for r in got.collect()]
    assert len(found) == len(rows) and all(0 <= s <= 1 for _, s, _ in found)
    by_id = {i: (s, w) for i, s, w in found}
    assert by_id[1] == by_id[2] == by_id[3] and by_id[1][0] < 0.5
    assert by_id[None][0] >= 0.5 and by_id[4] == by_id[None] and by_id[7][0] == by_id[None][0] and by_id[5][0] < 0.5
    assert tox.score_toxicity(docs.limit(0), machine).count() == 0


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for rows, high in (([], False), ([(1, 0)], False), ([(1, 1)], True)):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        scores = [r["score"] for r in tox.score_toxicity(docs, tox.fit_toxicity(docs, labels, lambda i: F.lit(True))).collect()]
        assert all((s >= 0.5) == high for s in scores)
    empty = docs.limit(0)
    assert tox.fit_toxicity(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), lambda i: F.lit(True)).bias < 0


def test_copies_count_once(spark):
    rows = [(i, "same words in a copied text here", 1) for i in range(40)] + [(100 + i, f"other words {i} in a text", 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    sample = tox.training_sample(docs, labels, "doc_id", "text", "toxic", 1000, lambda i: F.lit(True))
    assert sample.where("toxic = 1").count() == 1
