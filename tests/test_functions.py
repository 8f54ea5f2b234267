import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabularium.functions import names, ordered, quantiles, skew
from tabularium.functions.text import quote


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; ties in the order column; gaps between slices."""
    rng = random.Random(3)
    rows = [(("hot" if i % 3 else f"k{i % 7}"), float(rng.choice([1, 2, 2, 50, 51, 400]) * rng.randint(1, 9)), i, rng.random())
            for i in range(900)]
    return spark.createDataFrame(rows, "k string, at double, id long, v double"), pd.DataFrame(rows, columns=["k", "at", "id", "v"])


@pytest.mark.parametrize("width", [0.5, 7, 100, 1e6])
def test_previous_equals_window_for_any_slice_width(skewed, width):
    df, local = skewed
    got = ordered.with_previous(df, ["k"], "at", {"p": "v"}, width, ["id"]).toPandas().set_index("id")["p"]
    want = local.sort_values(["at", "id"]).assign(p=lambda d: d.groupby("k")["v"].shift()).set_index("id")["p"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_running_max_and_position(skewed):
    df, local = skewed
    run = ordered.with_running_max(df, ["k"], "at", "v", "m", 13, ["id"]).toPandas().set_index("id")["m"]
    want = local.sort_values(["at", "id"]).assign(m=lambda d: d.groupby("k")["v"].cummax()).set_index("id")["m"]
    pd.testing.assert_series_equal(run.sort_index(), want.sort_index(), check_names=False)
    place = ordered.with_position(df, "at", ["id"], "n", 0.25).toPandas().sort_values(["at", "id"])["n"]
    assert list(place) == list(range(1, 901))


def test_previous_without_key(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") * 10).alias("at"))
    got = {r["id"]: r["p"] for r in ordered.with_previous(df, [], "at", {"p": "id"}, 30).collect()}
    assert got == {i: (i - 1 if i else None) for i in range(50)}


@pytest.mark.parametrize("fetch", [20, 100_000])
def test_exact_quantiles(spark, fetch):
    rng = np.random.default_rng(5)
    local = pd.DataFrame({
        "a": rng.normal(size=5000), "b": rng.integers(0, 4, 5000).astype(float),
        "c": np.where(rng.random(5000) < 0.4, 7.0, rng.exponential(size=5000)), "d": np.full(5000, 2.5)})
    local.loc[::9, "a"] = np.nan
    df = spark.createDataFrame(local.astype(object).where(local.notna(), None), "a double, b double, c double, d double")
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, list("abcd"), probabilities, fetch_rows=fetch)
    for c in "abcd":
        for p in probabilities:
            assert got[c, p] == pytest.approx(local[c].quantile(p), abs=1e-12)


def test_salted_join_equals_join(skewed):
    df, _ = skewed
    small = df.groupBy("k").agg(F.max("v").alias("top"))
    plain = df.join(small, "k").select("id", "top").collect()
    for joined in (skew.salted_join(df, small, ["k"]), skew.join_checked(df, small, ["k"]),
                   skew.join_checked(df, small, ["k"], max_rows=2)):
        assert sorted(joined.select("id", "top").collect()) == sorted(plain)


def test_names():
    assert names.unique_snake_case(["  Name  ", "Age-Value", "Empty Column", "Score", "", "name", "NAME!"]) == [
        "name", "age_value", "empty_column", "score", "column_4", "name_1", "name_2"]
    assert names.semantic_type_of_name("product_name_id") == "name"
    assert names.semantic_type_of_name("zzz") is None


def test_sql_literals(spark):
    for text in (r"\bDROP\b", "it's", 'a"b', r"\\ '\''", "é\n"):
        assert spark.sql(f"SELECT {quote(text)} AS t").first()["t"] == text


def test_ordered_helpers_keep_null_keys_and_null_order_values(spark):
    rows = [(None, 1.0, 1, 10.0), (None, 40.0, 2, 20.0), ("a", None, 3, 30.0), ("a", 5.0, 4, 40.0), ("a", 90.0, 5, None), (None, 80.0, 6, 5.0)]
    df = spark.createDataFrame(rows, "k string, at double, id int, v double")
    previous = {r["id"]: r["p"] for r in ordered.with_previous(df, ["k"], "at", {"p": "id"}, 30, ["id"]).collect()}
    assert previous == {1: None, 2: 1, 6: 2, 3: None, 4: 3, 5: 4}
    highest = {r["id"]: r["m"] for r in ordered.with_running_max(df, ["k"], "at", "v", "m", 30, ["id"]).collect()}
    assert highest == {1: 10.0, 2: 20.0, 6: 20.0, 3: 30.0, 4: 40.0, 5: 40.0}
    place = {r["id"]: r["n"] for r in ordered.with_position(df, "at", ["id"], "n", 30).collect()}
    assert place == {3: 1, 1: 2, 4: 3, 2: 4, 6: 5, 5: 6}


def test_trailing_count_is_a_running_sum(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", None]), rng.choice([None, *range(-70, 400)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, s long, id long").select("k", F.timestamp_seconds("s").alias("at"), "id")
    counted = ordered.with_trailing_count(df, ["k"], "at", 60, "n")
    got = {r["id"]: r["n"] for r in counted.collect()}
    near = lambda s, o: o is None if s is None else o is not None and s - 60 < o <= s
    assert got == {i: sum(k == k2 and near(s, s2) for k2, s2, _ in rows) for k, s, i in rows}
    # a frame that moves at both ends is counted anew for every row
    assert "RangeFrame, unboundedpreceding" in counted._jdf.queryExecution().optimizedPlan().toString()
