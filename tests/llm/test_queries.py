"""Registered text queries against their SQL, and the pipeline against its stages applied by hand."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tabularium.llm.queries import QUERIES, SQL
from tabularium.sources.tables import Tables
from tests.conftest import FOLDER
from tests.llm.test_text_operators import contaminated, grouped, lowered, simhash  # noqa: F401
from tests.oracle import connect, rows_of


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    result = connect(FOLDER).execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, result.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


def test_pipeline(spark):
    docs = Tables(spark, FOLDER).documents
    items = [(r["item_id"], r["text"]) for r in Tables(spark, FOLDER).benchmark.collect()]
    good = corpus_pipeline.quality(spark, docs, FOLDER)
    assert good.columns == docs.columns
    rows = [tuple(r) for r in good.collect()]
    assert 0 < len(rows) < docs.count()
    ids = [r[0] for r in rows]
    first = grouped([simhash(r[1]) for r in rows], ids)
    rows = [r for r, c in zip(rows, first) if r[0] == c]
    hit = {r[0] for r in contaminated(rows, items) if r[5]}
    want = {r[0]: r for r in rows if r[0] not in hit}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(want) and all(r["lossless"] for r in got.values())
    same = [i for i in got if got[i]["text"] == want[i][1]]
    assert len(same) < len(got) and all(tuple(got[i])[2:5] == want[i][2:5] for i in got)
