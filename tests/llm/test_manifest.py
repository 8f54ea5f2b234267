"""The Merkle manifest against a recursion over lists, on awkward rows and on groups of several blocks."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabularium.llm.manifest import BLOCK, Parent, lower_ascii, merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """Root and, for each node, the siblings left and right of every step."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
    root, above = tree([sha("".join(run)) for run in runs])
    return root, [[(run[:k], run[k + 1 :]), *above[i]] for i, run in enumerate(runs) for k in range(len(run))]


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        subs[name] = tree([x[2] for x in groups[name]])
    root, above = tree([subs[n][0] for n in names]) if names else (None, [])
    out = []
    for name, top in zip(names, above):
        for (_, _, digest, row), low in zip(groups[name], subs[name][1]):
            path, text = low + top, row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(row, text)
            for left, right in path:
                folded = sha("".join(left) + folded + "".join(right))
            proof = "".join("".join(left + right) for left, right in path)
            out.append((row[0], digest, subs[name][0], root, sha(proof), len(proof) // 64, folded, folded == root))
    return sorted(out, key=repr)


def run(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if extra:
        docs = docs.withColumn("pos", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("grp", F.lit("y")).withColumn("a.b", F.lit(2))
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    got = merkle_manifest(docs, FIELDS, "doc_id", "source", {"text": lower_ascii(F.col("text"))}, tampered)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "n_siblings", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_awkward_rows(spark):
    rows = [(i, f"Text {i}" if i % 7 else None, "en", None if i % 5 == 0 else f"s{i % 3}", i) for i in range(120)]
    rows += [(None, None, None, None, None), (None, "", "en", "", 0), (3, "Text 3", "en", "s0", 3), (3, "Text 3", "en", "s0", 3), (3, "ÄB", None, "s0", -1)]
    rows += [(-9, "A" * 200_000, "en", "ß", 1), (8, "é", "de", "alone", 1)]
    got = run(spark, rows, extra=True)
    assert got == expected(rows) and 0 < sum(not r[-1] for r in got) < 40


def test_groups_of_several_blocks_and_many_groups(spark):
    rng = random.Random(5)
    rows = [(i, f"T{rng.random()}", "en", "hot", i) for i in range(2 * BLOCK + 18)]
    rows += [(i, f"T{i}", "en", f"g{i % 700}", i) for i in range(1400)]
    assert run(spark, rows) == expected(rows)


@pytest.mark.parametrize("count", [0, 1, 16, 17, 257])
def test_sizes(spark, count):
    rows = [(i, "A", "en", "s", i) for i in range(count)]
    assert run(spark, rows) == expected(rows)


def test_without_change_all_rows_verify(spark):
    docs = spark.createDataFrame([(i, "A", "en", f"s{i % 2}", i) for i in range(40)], SCHEMA)
    assert {r["verified"] for r in merkle_manifest(docs, FIELDS, "doc_id", "source").collect()} == {True}


def test_fold_resumes_the_state_before_the_slot():
    children = [sha(str(i)) for i in range(11)]
    parent, new = Parent(children), sha("new")
    for slot in range(11):
        assert parent.fold(slot, new) == sha("".join([*children[:slot], new, *children[slot + 1 :]]))
    assert parent.fold(3, children[3]) == parent.digest == sha("".join(children))
