import datetime as dt
import hashlib
import json
import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tabularium.functions import ranges
from tabularium.functions.names import snake_case
from tabularium.functions.names import snake_case
from tabularium.operators import (
    access, activity, audit_tree, chunking, cleaning, json_docs, limiter, profiling, relational, search, statistics,
    templates, text_cleaning, versions,
)
from tabularium.plans import REGISTRY
from tabularium.sources import files


# ---- relational ----

def test_join_needs_every_condition(spark):
    a, b = spark.range(3), spark.range(3)
    with pytest.raises(ValueError):
        relational.join_resources({"a": a, "b": b}, [], ["a.id"])


def test_join_and_derive_like_the_published_example(spark):
    customers = spark.createDataFrame([(i, f"c{i}") for i in range(1, 6)], "customer_id int, name string")
    orders = spark.createDataFrame([(i, 1 + i % 5, 100.0 * i) for i in range(1, 7)], "order_id int, customer_id int, amount double")
    joined = relational.join_resources(
        {"a": customers, "b": orders}, ["a.customer_id = b.customer_id"], ["a.name", "b.amount"])
    assert joined.count() == 6
    derived = relational.derive_field(orders, "with_tax", "amount * 1.1")
    assert all(r["with_tax"] == pytest.approx(r["amount"] * 1.1) for r in derived.collect())


def test_question_templates():
    assert templates.template_for("How many orders?") == "count"
    assert templates.template_for("the best average") == "average"
    assert templates.template_for("describe") == "general"


# ---- access ----

def test_levels_never_cross_clients(spark):
    rows = spark.createDataFrame([("c1", "u1"), ("c1", "u2"), ("c2", "u1")], "client_id string, user_id string")
    seen = {level: access.accessible_resources(rows, "u1", "c1", level).count() for level in ("user", "manager", "admin", "x")}
    assert seen == {"user": 1, "manager": 2, "admin": 2, "x": 0}
    assert access.accessible_resources(rows, "bad id!", "c1", "admin").count() == 0


# ---- cleaning ----

def test_type_detection(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "true", "2023-01-01", "a"), ("2", "2", "no", "2023-02-03", "b"), ("x", None, "YES", "2023-03-04", "c")],
        "integers string, floats string, booleans string, dates string, strings string")
    plan = cleaning.detect_types(df)
    assert plan.kinds == {"integers": "integer", "floats": "double", "booleans": "boolean", "dates": "timestamp"}
    assert plan.lost["integers"] == 1
    rows = plan.apply(df).collect()
    assert rows[2]["integers"] is None and rows[2]["booleans"] is True and rows[0]["dates"] == dt.datetime(2023, 1, 1)
    assert "integers" not in cleaning.detect_types(df, min_share=0.9).kinds


def test_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([("  Ann ", "25", None, "1.5"), (None, None, None, None), ("Bob", "x", None, "bad")],
                               "`  Name  ` string, `Age-Value` string, `Empty Column` string, `Score` string")
    once = cleaning.clean_table(df)
    assert once.table.columns == ["name", "age_value", "score"]
    twice = cleaning.clean_table(once.table).table
    assert sorted(map(str, once.table.collect())) == sorted(map(str, twice.collect()))
    stats = once.stats.first()
    assert (stats["original_rows"], stats["final_rows"], stats["columns_removed"]) == (3, 2, 1)


def test_mode_takes_smallest_tie(spark):
    df = spark.createDataFrame([(10, "b"), (10, "a"), (9, None), (9, "b"), (None, "a")], "n int, s string")
    filled = cleaning.handle_missing(df, "fill_mode").collect()
    assert filled[4]["n"] == 9 and filled[2]["s"] == "a"


# ---- text ----

def python_chunks(text, size, overlap, min_chars):
    words = text.split()
    if len(text) < min_chars:
        return [text] if text.strip() else []
    starts, at = [], 0
    while at < len(words):
        starts.append(at)
        if at + size >= len(words):
            break
        at += max(size - overlap, 1)
    found = [" ".join(words[s:s + size]) for s in starts]
    found = [c for c in found if len(c) >= min_chars]
    return found or ([text.strip()] if text.strip() else [])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.text(alphabet="ab é\n\t.", max_size=400), min_size=1, max_size=8), hs.integers(2, 12), hs.integers(0, 5))
def test_word_chunks_equal_the_loop(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: list(r["c"]) for r in df.select("id", text_cleaning.word_chunks("t", size, overlap, 5).alias("c")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == python_chunks(text, size, overlap, 5), repr(text)


def test_page_cleaning(spark):
    text = "Page 1\n\nBody line one is long enough\n\n12\n\n Page 2 \n3 / 9\nlast body line also long\nx\n7"
    df = spark.createDataFrame([(text,)], "t string")
    cleaned = df.select(text_cleaning.clean_text("t").alias("c")).first()["c"]
    assert "Page" not in cleaned and "12" not in cleaned and "Body line one is long enough" in cleaned


@pytest.mark.parametrize("strategy", ["sentence", "semantic", "paragraph"])
def test_packed_chunks(spark, strategy):
    text = "\n\n".join(f"Sentence number {i} says something. And {i} more follows here!" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "id int, t string")
    rows = chunking.chunk_documents(df, "id", "t", strategy, chunk_tokens=40, overlap_tokens=5).collect()
    first = sorted((r for r in rows if r["id"] == 1), key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in first] == list(range(len(first))) and len(first) > 5
    assert all(len(r["chunk"]) // 4 <= 40 for r in first)
    assert [r["chunk"] for r in rows if r["id"] == 3] == ["short"] and not [r for r in rows if r["id"] == 2]
    parts = [p.strip() for p in (text.split("\n\n") if strategy == "paragraph" else re.split(r"[.!?]+\s+", text)) if p.strip()]
    joined = " ".join(r["chunk"] for r in first)
    assert all(p in joined for p in parts)


def test_fixed_chunks_cover_the_text():
    text = " ".join(f"word{i}" for i in range(900))
    pieces = list(chunking.cut(text, 200, 40))
    assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
    for (_, _, end, _), (_, start, _, _) in zip(pieces, pieces[1:]):
        assert start == end - 40
    assert list(chunking.cut("x" * 500, 200, 199))[-1][2] == 500


# ---- search ----

@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    vectors = (0.15 * rng.normal(size=(300, 8))).astype("float32")
    texts = [" ".join(rng.choice(["red", "blue", "data", "file", "sun"], size=6)) for _ in range(300)]
    rows = [(i % 4, i, vectors[i].tolist(), texts[i]) for i in range(300)]
    chunks = spark.createDataFrame(rows, "resource_id int, chunk_id int, embedding array<float>, text string").repartition(5)
    queries = spark.createDataFrame(
        [(q, 0, (0.15 * rng.normal(size=8)).tolist()) for q in range(6)], "query_id int, variation int, vector array<double>")
    return chunks, queries, vectors, texts


def test_nearest_equals_brute_force_also_in_blocks(corpus, monkeypatch):
    chunks, queries, vectors, _ = corpus
    want = set()
    for q in queries.collect():
        d = ((vectors.astype(float) - np.array(q["vector"])) ** 2).sum(axis=1)
        for r in range(4):
            ids = [i for i in range(300) if i % 4 == r]
            want |= {(q["query_id"], r, i) for i in sorted(ids, key=lambda i: (d[i], i))[:3]}
    for block in (500, 2):
        monkeypatch.setattr(search._in_blocks, "__defaults__", (block,))
        got = search.nearest_chunks(queries, chunks, 3).select("query_id", "resource_id", "chunk_id").collect()
        assert {tuple(r) for r in got} == want


def test_mmr_equals_brute_force(corpus):
    chunks, queries, vectors, texts = corpus
    got = search.mmr_search(queries, chunks, 4).orderBy("query_id", "pick").collect()
    for q in queries.collect():
        relevance = np.maximum(0.0, 1 - ((vectors.astype(float) - np.array(q["vector"])) ** 2).sum(axis=1))
        best = {i for r in range(4) for i in sorted(range(r, 300, 4), key=lambda i: (-relevance[i], i))[:12]}
        pool = sorted(best, key=lambda i: (-relevance[i], i))[:12]
        chosen, rest = [pool[0]], pool[1:]
        while rest and len(chosen) < 4:
            sets = {i: set(texts[i].split()) for i in pool}
            score = {i: 0.7 * relevance[i] - 0.3 * max(len(sets[i] & sets[c]) / len(sets[i] | sets[c]) for c in chosen) for i in rest}
            pick = max(rest, key=lambda i: score[i])
            chosen.append(pick)
            rest.remove(pick)
        mine = [r["chunk_id"] for r in got if r["query_id"] == q["query_id"]]
        assert mine == chosen


@pytest.mark.parametrize("a,b,want", [("x y", "y x", 1.0), ("a", "b", 0.0), ("a b", "b c", 1 / 3), ("", " ", 1.0), ("", "a", 0.0)])
def test_jaccard_pairs(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(search.text_similarity("a", "b").alias("s")).first()["s"] == pytest.approx(want)


# ---- statistics ----

def test_pearson_p_and_peaks():
    for r, n in ((0.5, 20), (-0.2, 11), (0.01, 500)):
        t, df = abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2
        x = np.linspace(0, t, 200_001)
        density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert statistics.pearson_p(r, n) == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-8)
    assert statistics.pearson_p(0.0, 10) == 1.0
    assert statistics.first_peak(np.array([0, 1, 3, 3, 1, 5, 0.0]), 2) == 2
    assert statistics.first_peak(np.array([3, 2, 1.0]), 0) is None


def test_seasonal_series(spark):
    days = [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}" for i in range(140)]
    rows = [("s", d, 10 + 5 * math.sin(2 * math.pi * i / 7)) for i, d in enumerate(days)] + [("f", d, 1.0 * i) for i, d in enumerate(days)]
    got = {r["k"]: r for r in statistics.seasonality(spark.createDataFrame(rows, "k string, day string, value double"), "k").collect()}
    assert got["s"]["period"] == 7 and got["s"]["seasonal"] and not got["f"]["seasonal"]


def test_autoregression_continues_a_line(spark):
    start = dt.date(2024, 1, 1)
    rows = [("a", str(start + dt.timedelta(days=i)), 3.0 * i + (i % 2) * 0.01) for i in range(80)]
    out = statistics.autoregressive_forecast(spark.createDataFrame(rows, "k string, day string, value double"), "k", 3).collect()
    assert [round(r["predicted"]) for r in out] == [240, 243, 246] and all(r["lower"] <= r["predicted"] <= r["upper"] for r in out)


def test_isolation_flags_extremes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v)) for i, v in enumerate(rng.normal(size=2000))] + [(5000, 40.0), (5001, -35.0)]
    found = statistics.isolation_outliers(spark.createDataFrame(rows, "id long, v double"), "id", "v").collect()
    assert {5000, 5001} <= {r["id"] for r in found} and len(found) <= 0.11 * len(rows) and {r["status"] for r in found} == {"ok"}
    few = statistics.isolation_outliers(spark.createDataFrame(rows[:50], "id long, v double"), "id", "v").collect()
    assert [tuple(r) for r in few] == [(None, None, None, None, statistics.TOO_FEW)]


# ---- json ----

DOC = {"User Name": "A", "empty": {}, "none": None, "list": [], "In Ner": {"deep": None, "x": [{"a b": 1}, None, {}], "L3": {"L4": {"v": 2}}}}


def without_empty(value):
    if isinstance(value, dict):
        return {k: without_empty(v) for k, v in value.items() if v is not None and v != {} and v != []}
    if isinstance(value, list):
        return [without_empty(v) for v in value if v is not None and v != {} and v != []]
    return value


def with_snake_keys(value):
    if isinstance(value, dict):
        return {snake_case(k): with_snake_keys(v) for k, v in value.items()}
    return [with_snake_keys(v) for v in value] if isinstance(value, list) else value


def paths(value, depth=3):
    """(names, value) of the members of a document, nested objects entered ``depth`` times."""
    for name, inner in value.items():
        if isinstance(inner, dict) and depth:
            yield from (((name, *p), v) for p, v in paths(inner, depth - 1))
        else:
            yield (name,), inner


def joined(value):
    return {"_".join(p): v for p, v in paths(value)}


def test_json_cleaning(spark):
    df = spark.createDataFrame([(json.dumps(DOC),), ("not json",)], "j string")
    got = [r["c"] for r in df.select(json_docs.clean_json("j").alias("c")).collect()]
    assert json.loads(got[0]) == {"user_name": "A", "in_ner": {"x": [{"a_b": 1}], "l3": {"l4": {"v": 2}}}} and got[1] is None
    nested = {"user": {"personal": {"name": "x", "age": 3}, "contact": {"email": "e"}}, "settings": {"theme": "d"}, "a": {"b": {"c": {"d": {"e": 1}}}}}
    df = spark.createDataFrame([(json.dumps(nested),), (json.dumps([nested["user"], 3]),), ("7",)], "j string")
    got = [r["c"] for r in df.select(json_docs.clean_json("j", flatten=True).alias("c")).collect()]
    assert json.loads(got[0]) == {
        "user_personal_name": "x", "user_personal_age": 3, "user_contact_email": "e", "settings_theme": "d", "a_b_c_d": {"e": 1}}
    assert json.loads(got[1]) == [{"personal_name": "x", "personal_age": 3, "contact_email": "e"}] and got[2] is None


def test_json_cleaning_of_what_is_no_json_and_of_long_documents(spark):
    bad = ['{"a":1} x', '{"a":1,,}', "{'a':1}", '{"a" 1}', "", "nul", '{"a":nullable}', "[1 2]", '{"a":1', None]
    rows = spark.createDataFrame([(b,) for b in bad], "j string").select(json_docs.clean_json("j").alias("c")).collect()
    assert [r["c"] for r in rows] == [None] * len(bad)
    long = {"A": ['\\"' * 200_000, *range(50_000), None], "B c": {str(i): i for i in range(2_000)}}
    got = spark.createDataFrame([(json.dumps(long, indent=2),)], "j string").select(json_docs.clean_json("j").alias("c")).first()["c"]
    assert json.loads(got) == with_snake_keys(without_empty(long))


NAMES = hs.sampled_from(["A b", "a_b", "x", "\u00dcn\u00ef", 'q"t', "back\\s", "k:1,{", "[z]", "none"])
TEXTS = hs.sampled_from(["", "null", "a,null,b", '"k":null,', "{}", "[]", "x:", "tab\t", "\\", "line\nb", 'q"'])
ANY_JSON = hs.recursive(
    hs.none() | hs.booleans() | hs.integers(-9, 10**12) | hs.sampled_from([0.5, -1.25]) | TEXTS,
    lambda inner: hs.dictionaries(NAMES, inner, max_size=4) | hs.lists(inner, max_size=4), max_leaves=25)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(ANY_JSON, min_size=40, max_size=80), hs.sampled_from([None, 1]), hs.booleans())
def test_json_cleaning_equals_recursion(spark, documents, indent, ascii_only):
    df = spark.createDataFrame([(i, json.dumps(d, indent=indent, ensure_ascii=ascii_only)) for i, d in enumerate(documents)], "i int, j string")
    clean = json_docs.clean_json
    for r in df.select("i", clean("j").alias("a"), clean("j", True, False).alias("b"), clean("j", False).alias("c"), clean("j", flatten=True).alias("d")).collect():
        d = documents[r["i"]]
        assert [json.loads(r[c]) for c in "abc"] == [with_snake_keys(without_empty(d)), without_empty(d), with_snake_keys(d)]
        whole = with_snake_keys(without_empty(d))
        if isinstance(whole, dict) and len(joined(whole)) == sum(1 for _ in paths(whole)):
            assert json.loads(r["d"]) == joined(whole)


def python_leaves(value, path=""):
    for k, v in value.items():
        at = f"{path}.{k}" if path else k
        if isinstance(v, dict):
            yield from python_leaves(v, at)
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            for i, item in enumerate(v):
                yield from python_leaves(item, f"{at}[{i}]")
        else:
            yield at


JSON = hs.recursive(
    hs.none() | hs.booleans() | hs.integers(-5, 5) | hs.text("ab", max_size=3),
    lambda inner: hs.dictionaries(hs.text("kxy", min_size=1, max_size=2), inner, max_size=3) | hs.lists(hs.integers(0, 3), max_size=2),
    max_leaves=10)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.dictionaries(hs.text("kxy", min_size=1, max_size=2), JSON, min_size=1, max_size=3), min_size=1, max_size=5))
def test_leaves_equal_recursion(spark, documents):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "id int, j string")
    got = sorted((r["id"], r["path"]) for r in json_docs.json_leaves(df, "id", "j").collect())
    assert got == sorted((i, p) for i, d in enumerate(documents) for p in python_leaves(d))


def test_too_deep_documents_raise(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":1}}}')], "id int, j string")
    with pytest.raises(Exception, match="nested deeper"):
        json_docs.json_leaves(df, "id", "j", max_depth=1).collect()


# ---- activity, versions, files ----

def test_rate_limit_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    base, rows, at = dt.datetime(2024, 1, 1), [], {}
    for i in range(1500):
        k = "hot" if rng.random() < 0.7 else "cold"
        at[k] = at.get(k, 0.0) + float(rng.choice([0.5, 2, 9, 70], p=[0.6, 0.2, 0.15, 0.05]))
        rows.append((k, base + dt.timedelta(seconds=at[k]), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, event_id long")
    got = {r["event_id"]: r["allowed"] for r in activity.rate_limit(df, ["k"], "streaming", parts=6).collect()}
    for k in ("hot", "cold"):
        mine = sorted((ts, i) for kk, ts, i in rows if kk == k)
        recent = []
        for ts, i in mine:
            recent = [t for t in recent if (ts - t).total_seconds() < 60]
            assert got[i] == (len(recent) < 5)
            if got[i]:
                recent.append(ts)


def test_visible_text():
    html = "<!DOCTYPE html><p>A &amp; B</p><script>var x='<p>';</script><!-- no --><style>p{}</style><b>c</b>"
    assert files.visible_text(html) == "A & Bc"


def test_version_of_file(spark):
    df = spark.createDataFrame([("/a/b/v12_data.csv",), ("/a/b/data.csv",)], "p string")
    assert [r[0] for r in df.select(versions.version_of_file(F.col("p"))).collect()] == [12, None]


def test_limits_list():
    assert activity.limit_decisions([0, 1, 2, 61, 62], 2, 60) == [True, True, False, True, True]


def test_every_correlated_pair_reaches_the_report(spark):
    import numpy as np

    from tabularium.operators import statistics as st

    rng = np.random.default_rng(1)
    base = rng.normal(size=200)
    columns = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(float(b * (i + 1)) for i in range(6)) for b in base], ", ".join(f"{c} double" for c in columns))
    related = st.correlations(df, columns)
    assert related.count() == 15 and related.where("level = 'strong'").count() == 15
    assert st.correlations(df, columns, limit=10).count() == 10
    few = st.correlations(df.limit(5), columns)
    assert few.where("status = 'too_few_rows' AND r IS NULL").count() == 15


def test_short_series_have_a_status(spark):
    import datetime as dt

    from tabularium.operators import statistics as st

    day = dt.datetime(2024, 1, 1)
    rows = [("long", day + dt.timedelta(days=i), float(i)) for i in range(30)] + [("short", day, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    trends = {r["k"]: (r["status"], r["trend"]) for r in st.linear_trend(df, ["k"], "ts", "v").collect()}
    assert trends == {"long": ("ok", "increasing"), "short": ("too_few_rows", None)}
    forecast = st.linear_forecast(df, ["k"], "ts", "v", 3).groupBy("k", "status").count().collect()
    assert sorted(tuple(r) for r in forecast) == [("long", "ok", 3), ("short", "too_few_rows", 1)]
    assert {r["k"]: len(r["left_out"]) for r in st.short_series(df, ["k"], "v").collect()} == {"long": 1, "short": 4}


def test_resources_are_joined_along_their_keys(spark):
    from tabularium.operators import harmonise as hz

    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "visits": make([(1, 10, "v1"), (2, 20, "v2"), (3, 30, "v3")], "visit_id long, shop_id long, note string"),
        "towns": make([(7, "north"), (8, "south")], "town_id long, label string"),
        "shops": make([(10, 7), (20, 8)], "shop_id long, town_id long"),
    }
    steps = hz.join_tree(spark, hz.fields_of(tables))
    assert {r for r, _ in steps} == set(tables) and steps[0][1] == [] and all(key for _, key in steps[1:])
    assert sorted(tuple(r) for r in hz.synthesize_join(tables, ["note", "label"]).collect()) == [("v1", "north"), ("v2", "south")]
    with pytest.raises(ValueError, match="apart"):
        hz.synthesize_join(tables | {"apart": make([("x",)], "remark string")}, ["note"])


def test_composite_join_keys_stay_whole(spark):
    from tabularium.operators import harmonise as hz

    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "order_id long, line_id long, x string")
    right = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "order_id long, line_id long, y double")
    tables = {"l": left, "r": right}
    key = hz.join_key(spark, hz.fields_of(tables))
    assert {a.name for a, _, _ in key} == {"order_id", "line_id"}
    assert sorted(tuple(r) for r in hz.synthesize_join(tables, ["x", "y"]).collect()) == [("a", 10.0), ("b", 20.0)]


def test_field_type_counts_of_bad_documents(spark):
    from tabularium.operators import json_docs as jd

    rows = [
        (1, '{"a": 1, "b": [1], "c": {"d": null}}'), (2, None), (3, "no json"), (4, "[1]"), (5, '{"a":1} x'), (6, "{}"),
        (7, '{"a":[[1],{"b":2,"c":[{}]}],"d":true,"e":"7","f":{"g":{"h":-1.5,"i":[]}},"j":{}}'), (8, '{"a":1,"a":2}'),
    ]
    df = spark.createDataFrame(rows, "k int, j string")
    got = {r["k"]: (r["total"], r["numeric"], r["lists"], r["objects"]) for r in jd.field_type_counts(df, "k", "j").collect()}
    none = (None,) * 4
    assert got == {1: (4, 1, 1, 1), 2: none, 3: none, 4: none, 5: none, 6: (0, 0, 0, 0), 7: (8, 2, 2, 3), 8: none}


# ---- ranges, limiter, audit tree ----

def test_numbered_places_equal_a_sort(spark):
    rows = [("hot", 5, i) for i in range(500)] + [("hot", None, 501), (None, 1, 502), (None, None, 503), ("cold", -1, 504), ("hot", 5, 7)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = ranges.numbered(df, ["k"], ["t", "i"], "place", "n", parts=7)
    assert got.columns == ["k", "t", "i", "place", "n"]
    lag = lambda v: (v is not None, v or 0)
    for key in ("hot", None, "cold"):
        mine = sorted((r for r in got.collect() if r["k"] == key), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
        assert [(lag(r["t"]), r["i"]) for r in mine] == sorted((lag(t), i) for k, t, i in rows if k == key)
    assert ranges.numbered(df.limit(0), [], ["t"], "place").count() == 0


def looped(rows, limit, window):
    """Decisions of the limiter, one request after the other."""
    decided, recent = {}, {}
    for k, at, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        recent[k] = [t for t in recent.get(k, []) if at - t < window * 1_000_000]
        decided[i] = len(recent[k]) < limit
        if decided[i]:
            recent[k].append(at)
    return decided | {i: True for _, at, i in rows if at is None}


@pytest.mark.parametrize("spacing", ["steady", "dense", "uneven"])
def test_busy_key_is_decided_by_many_tasks(spark, spacing):
    rng = np.random.default_rng(8)
    steps = {"steady": lambda: 5_000_000, "dense": lambda: int(rng.integers(10_000, 40_000)), "uneven": lambda: int(rng.choice([1, 7, 31, 64])) * 1_000_000}
    at, rows = 0, []
    for i in range(6000):
        at += steps[spacing]()
        rows.append(("hot" if i % 10 else None, at, i))
    rows.append(("hot", None, 9999))
    df = spark.createDataFrame(rows, "k string, us long, event_id long").select("k", F.timestamp_micros("us").alias("ts"), "event_id")
    got = limiter.rate_limit(df, ["k"], 5, 60, parts=9)
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == looped(rows, 5, 60)
    tasks = got.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    if spacing == "steady":  # all states it can be in are among the assumed ones
        assert tasks.count() >= 8 and tasks.agg(F.max("count")).first()[0] < 2000
    assert limiter.rate_limit(df.limit(0), ["k"], 5, 60).count() == 0


def test_allow_equals_the_loop():
    rng = np.random.default_rng(1)
    for _ in range(200):
        times = np.cumsum(rng.integers(0, 30, rng.integers(1, 60)))
        cut = int(rng.integers(0, len(times)))
        first, state = limiter.allow(times[:cut], (), 3, 40)
        second, _ = limiter.allow(times[cut:], state, 3, 40)
        assert [*first, *second] == activity.limit_decisions(times.tolist(), 3, 40)


def test_audit_tree_tells_what_was_done(spark, tables):
    log = tables.events
    sealed = audit_tree.leaves(log, "event_id", parts=6).cache()
    clean = audit_tree.segment_report(sealed, audit_tree.leaves(log, "event_id"))
    assert clean.where("NOT intact OR total <> verified").count() == 0 and clean.agg(F.sum("total")).first()[0] == log.count()
    inside = log.withColumn("hour", F.date_trunc("hour", "ts")).groupBy("hour").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).where("b > a").first()
    cases = {
        "changed": sealed.withColumn("leaf", F.when(F.col("id") == inside["a"], F.sha2("leaf", 256)).otherwise(F.col("leaf"))),
        "removed": sealed.where(F.col("id") != inside["a"]),
        "added": sealed.unionByName(sealed.where(F.col("id") == inside["b"]).selectExpr("-1L AS id", "segment", "place + 1 AS place", "leaf")),
        "moved": audit_tree.swapped_pairs(sealed, F.col("id") == inside["a"]),
    }
    for status, current in cases.items():
        bad = audit_tree.segment_report(sealed, current).where("NOT intact").collect()
        assert len(bad) == 1 and bad[0][status] in (1, 2) and bad[0]["segment"] == inside["hour"].replace(tzinfo=None)


def test_audit_tree_of_several_levels_and_its_proofs(spark):
    ids = spark.range(70_000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id div 40)").alias("ts"))
    placed = audit_tree.leaves(ids, "event_id", unit="day", parts=5).cache()
    nodes = audit_tree.tree(placed)
    assert nodes.agg(F.max("level")).first()[0] == 3
    chain = audit_tree.chained(audit_tree.roots(nodes))
    assert chain.count() == 1 and chain.first()["link"] == hashlib.sha256(chain.first()["root"].encode()).hexdigest()
    wanted = spark.createDataFrame([(0,), (255,), (256,), (65_535,), (65_536,), (69_999,)], "id long")
    proofs = audit_tree.inclusion_proofs(placed, nodes, wanted)
    folded = proofs.select(audit_tree.folded_root(F.col("leaf"), F.col("steps")).alias("a"), audit_tree.folded_root(F.sha2("leaf", 256), F.col("steps")).alias("b")).collect()
    root = chain.first()["root"]
    assert len(folded) == 6 and all(r["a"] == root and r["b"] != root for r in folded)
    rows = sorted((r["place"], r["leaf"]) for r in placed.collect())
    level = [leaf for _, leaf in rows]
    for _ in range(3):
        level = [hashlib.sha256("".join(level[i : i + 256]).encode()).hexdigest() for i in range(0, len(level), 256)]
    assert level == [root]
    empty = audit_tree.leaves(ids.limit(0), "event_id")
    assert audit_tree.tree(empty).count() == 0


@pytest.mark.parametrize("strategy", ["sentence", "fixed", "paragraph", "semantic"])
def test_long_documents_reach_python_in_small_batches(spark, strategy):
    df = spark.createDataFrame([(1, "One. Two. " * 20)], "id long, t string")
    plan = chunking.chunk_documents(df, "id", "t", strategy)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_pages_reach_python_in_small_batches(spark):
    df = spark.createDataFrame([(1, "<p>a &amp; b<script>x</script></p>"), (2, None)], "id long, h string").select("id", files.html_text("h").alias("t"))
    assert {r["id"]: r["t"] for r in df.collect()} == {1: "a & b", 2: None}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_brackets_in_strings_do_not_nest(spark):
    docs = ['{"a":[{"b":"]}[{"}],"c":"\\\\\\""}', '{"x":{"y":{"z":{}}}}', '{"a":[{"b":"[[[["}],"c":""}', "no json", None]
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    assert json_docs.deepest_nesting(df, "j") == 4
    assert json_docs.deepest_nesting(df.where("j LIKE '%b%'"), "j") == 3


def test_shape_of_documents_needs_no_join(spark):
    rows = [(1, '{"a":{"b":[1,{"c":2}]},"d":"x"}'), (1, '{"a":{"b":[1,{"c":2}]},"d":"x"}'), (2, '{"a":{}}'), (3, "no json")]
    shape = json_docs.document_shape(spark.createDataFrame(rows, "k int, j string"), "k", "j")
    assert "Join" not in shape._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["k"], r["max_depth"], r["fields"], r["complexity"], tuple(r["kinds"])) for r in shape.collect())
    every = ("arrays", "categorical", "nested_objects", "numerical")
    assert got == [(1, 4, 3, "medium", every)] * 2 + [(2, 1, 1, "low", ("nested_objects",))]


def test_profile_of_values_in_several_types(spark):
    rows = [(1, '{"a":1,"b":"1","c":null,"d":true,"e":2.5}'), (2, '{"a":"1","b":"x","c":null,"d":false,"e":3}'), (3, '{"a":null,"b":"x","e":[]}')]
    leaves = json_docs.json_leaves(spark.createDataFrame(rows, "k int, j string"), "k", "j")
    profile = json_docs.leaf_profile(leaves)
    assert "Expand" not in profile._jdf.queryExecution().optimizedPlan().toString() and profile._jdf.queryExecution().optimizedPlan().toString().count("distinct") == 0
    got = {r["path"]: tuple(r)[1:] for r in profile.collect()}
    assert got == {
        "a": ("mixed", True, 3, 1, ["1"]), "b": ("string", False, 3, 2, ["1", "x"]), "c": ("null", True, 2, 0, []),
        "d": ("boolean", False, 2, 2, ["false", "true"]), "e": ("mixed", False, 3, 3, ["2.5", "3", "[]"])}


def test_flattening_parses_a_clean_text_once(spark):
    df = spark.createDataFrame([('{"a": {"B c" : 1, "b c":[ ]}, "d":"x  y"}',), ('{"A": 1, "a": {"b": 2}}',), ('{"a" 1}',)], "j string")
    flat = df.select(json_docs.clean_json("j", flatten=True).alias("c"))
    assert [json.loads(r["c"]) if r["c"] else None for r in flat.collect()] == [{"a_b_c": 1, "d": "x  y"}, {"a_b": 2}, None]
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json(") <= 2  # the second for texts that name a field twice


def test_field_types_take_two_passes_over_the_text(spark):
    plan = json_docs.field_type_counts(spark.createDataFrame([(1, "{}")], "k int, j string"), "k", "j")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2


def test_profile_counts_each_column_by_itself(spark):
    long = "x" * 70
    rows = [(0.0, 1, "7", long + "1"), (-0.0, 1, "7", long + "1"), (float("nan"), 2, "b@c.de", long + "2"), (float("nan"), None, "", "y" * 64), (None, 3, None, None)]
    df = spark.createDataFrame(rows, "d double, k int, s string, t string")
    profile = profiling.field_profile(df, "odd")
    assert "Generate" not in profile._jdf.queryExecution().optimizedPlan().toString()
    got = {r["field"]: (r["total"], r["filled"], r["unique_values"], r["consistency"], r["patterns"]) for r in profile.collect()}
    assert got == {
        "d": (5, 4, 2, 1.0, []), "k": (5, 4, 3, 1.0, []), "s": (5, 4, 3, 0.5, ["email_format"]), "t": (5, 4, 3, 1.0, []),
    }
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "d double")
    assert profiling.field_profile(zeros, "zeros").first()["patterns"] == []
    assert profiling.distinct_counts(zeros).first()["unique_values"] == 1
    minus = profiling.field_profile(zeros.where("CAST(d AS STRING) = '-0.0'"), "minus").first()
    assert (minus["unique_values"], minus["patterns"]) == (1, ["fixed_length_4"])


def test_quality_reads_the_tables_as_they_lie(spark, tables):
    seen = []

    class Spy:
        def __getattr__(self, name):
            return getattr(tables, name)

        def spread(self, name):
            seen.append(name)
            return tables.spread(name)

    REGISTRY["quality_dimensions"].build(Spy())
    assert not seen  # each column is read by itself, so a spread would be paid once a column
