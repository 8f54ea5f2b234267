"""Queries over trends, correlations, anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.operators import profiling, statistics as st
from tabularium.plans.registry import query


def _regression_sql(table: str, key: str, ts: str, value: str, min_rows: int) -> str:
    return f"""(SELECT {key}, count(*) AS n, regr_slope({value}, day) AS slope, regr_intercept({value}, day) AS intercept,
  regr_r2({value}, day) AS r_squared, regr_sxx({value}, day) AS sxx, regr_sxy({value}, day) AS sxy,
  regr_syy({value}, day) AS syy, any_value(first_ts) AS first_ts, any_value(last_ts) AS last_ts FROM (
  SELECT {key}, {value}, first_ts, last_ts, floor((epoch_us({ts}) - epoch_us(first_ts)) / 86400000000)::BIGINT AS day
  FROM {table} JOIN (SELECT {key}, min({ts}) AS first_ts, max({ts}) AS last_ts FROM {table} GROUP BY {key})
  USING ({key})) GROUP BY {key} HAVING count(*) >= {min_rows})"""


TREND_LABEL = "CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END"


def _trend_sql(table, key, ts, value):
    return f"""SELECT {key}, n, 'ok' AS status, round(slope, 6) AS slope, round(r_squared, 6) AS r_squared, {TREND_LABEL} AS trend
FROM {_regression_sql(table, key, ts, value, 10)}"""


@query("trend_per_event_type", "T1", _trend_sql("events", "event_type", "ts", "value"))
def _(t):
    trends = st.linear_trend(t.events, ["event_type"], "ts", "value").drop("confidence")
    return trends.withColumns({c: F.round(c, 6) for c in ("slope", "r_squared")})


@query("trend_per_priority", "T1", _trend_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice"))
def _(t):
    trends = st.linear_trend(t.orders, ["o_orderpriority"], "o_orderdate", "o_totalprice").drop("confidence")
    return trends.withColumns({c: F.round(c, 6) for c in ("slope", "r_squared")})


@query("seasonality", "T2")
def _(t):
    return st.seasonality(st.daily_series(t.events, ["event_type"], "ts", "value"), "event_type")


LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
REPORT_NUMBERS = [*LINE_NUMBERS, "l_suppkey"]  # fifteen pairs


def _correlation_sql(table, columns):
    parts = [
        f"SELECT '{a}' AS variable1, '{b}' AS variable2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS pairs, "
        f"corr({a}, {b}) AS r FROM {table}" for i, a in enumerate(columns) for b in columns[i + 1:]
    ]
    return f"""(SELECT *, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3
  THEN 'weak' ELSE 'none' END AS level, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({' UNION ALL '.join(parts)}) WHERE pairs >= 10)"""


@query("correlations", "T3", f"""
SELECT variable1, variable2, pairs, round(r, 6) AS r, level, direction FROM {_correlation_sql("lineitem", LINE_NUMBERS)}
ORDER BY abs(r) DESC LIMIT 10""")
def _(t):
    return st.correlations(t.lineitem, LINE_NUMBERS, limit=10).drop("p_value", "status").withColumn("r", F.round("r", 6))


@query("correlation_p_values", "T3")
def _(t):
    return st.correlations(t.lineitem, LINE_NUMBERS)


@query("short_series", "T1, T6, T7, T8", """
SELECT o_custkey, n, list_filter([CASE WHEN n < 10 THEN 'trend' END, CASE WHEN n < 20 THEN 'sudden_changes' END,
  CASE WHEN n < 20 THEN 'linear_forecast' END, CASE WHEN n < 50 THEN 'autoregressive_forecast' END], lambda x: x IS NOT NULL) AS left_out
FROM (SELECT o_custkey, count(o_totalprice) AS n FROM orders GROUP BY 1) WHERE n < 50""")
def _(t):
    return st.short_series(t.orders, ["o_custkey"], "o_totalprice")


@query("trends_of_short_series", "T1", """
SELECT o_custkey, n, CASE WHEN n >= 10 THEN 'ok' ELSE 'too_few_rows' END AS status,
  CASE WHEN n >= 10 THEN round(slope, 4) END AS slope FROM (
  SELECT o_custkey, count(*) AS n, regr_slope(o_totalprice, date_diff('day', first_ts, o_orderdate)) AS slope FROM (
    SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_ts FROM orders) GROUP BY o_custkey)""")
def _(t):
    trends = st.linear_trend(t.orders, ["o_custkey"], "o_orderdate", "o_totalprice")
    return trends.select("o_custkey", "n", "status", F.round("slope", 4).alias("slope"))


OUTLIERS = """(SELECT 'outlier' AS kind, variable, key, value, mean AS expected, abs(value - mean) / std AS deviation,
  least(abs(value - mean) / std / 3, 1.0) AS confidence FROM (
  SELECT 'value' AS variable, event_id::VARCHAR AS key, value, avg(value) OVER () AS mean,
    stddev_pop(value) OVER () AS std FROM events) WHERE abs(value - mean) / std > 3)"""


@query("z_score_outliers", "T4", f"""
SELECT variable, key, value, round(expected, 6) AS expected, round(deviation, 6) AS deviation FROM {OUTLIERS}""")
def _(t):
    found = st.z_score_outliers(t.events, ["event_id"], ["value"])
    return found.select("variable", "key", "value", F.round("expected", 6).alias("expected"),
                        F.round("deviation", 6).alias("deviation"))


@query("largest_outliers", "T4, W3", """
WITH z AS (SELECT 'o_totalprice' AS variable, o_orderkey AS key, o_totalprice AS value,
  abs(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS d FROM orders
 UNION ALL SELECT 'skewed', o_orderkey, pow(o_totalprice / 100000, 4),
  abs(pow(o_totalprice / 100000, 4) - avg(pow(o_totalprice / 100000, 4)) OVER ())
   / stddev_pop(pow(o_totalprice / 100000, 4)) OVER () FROM orders)
SELECT variable, key::VARCHAR AS key, round(d, 6) AS deviation FROM z WHERE d > 3
QUALIFY row_number() OVER (PARTITION BY variable ORDER BY d DESC, key::VARCHAR) <= 5""")
def _(t):
    orders = t.orders.withColumn("skewed", F.expr("power(o_totalprice / 100000, 4)"))
    found = st.z_score_outliers(orders, ["o_orderkey"], ["o_totalprice", "skewed"], per_column=5)
    return found.select("variable", "key", F.round("deviation", 6).alias("deviation"))


@query("isolation_outliers", "T5")
def _(t):
    return st.isolation_outliers(t.events, "event_id", "value")


CHANGES = """(SELECT CASE WHEN step > mean + 3 * std THEN 'spike' ELSE 'drop' END AS kind, event_type AS variable,
  event_id::VARCHAR AS key, ts, value, expected, abs(step) / std AS deviation, least(abs(step) / std / 3, 1.0) AS confidence
FROM (SELECT *, avg(step) OVER (PARTITION BY event_type) AS mean, stddev_pop(step) OVER (PARTITION BY event_type) AS std,
    count(*) OVER (PARTITION BY event_type) AS n FROM (
  SELECT *, value - lag(value) OVER w AS step, lag(value) OVER w AS expected FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)))
WHERE n >= 20 AND (step > mean + 3 * std OR step < mean - 3 * std))"""


@query("spikes_and_drops", "T6, W1", f"""
SELECT kind, variable, key, value, expected, round(deviation, 6) AS deviation, round(confidence, 6) AS confidence
FROM {CHANGES}""")
def _(t):
    found = st.sudden_changes(t.events, "event_type", "ts", "value", "event_id", 3600)
    return found.drop("ts").withColumns({c: F.round(c, 6) for c in ("deviation", "confidence")})


@query("first_spikes_and_drops", "T6", f"""
SELECT kind, variable, key, value FROM {CHANGES}
QUALIFY row_number() OVER (PARTITION BY variable, kind ORDER BY ts, key) <= 3""")
def _(t):
    found = st.sudden_changes(t.events, "event_type", "ts", "value", "event_id", 3600, per_kind=3)
    return found.select("kind", "variable", "key", "value")


DAILY_REVENUE = """(SELECT 'revenue' AS series, o_orderdate, sum(o_totalprice) AS revenue FROM orders GROUP BY o_orderdate)"""


def daily_revenue(t):
    return t.orders.groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("revenue")).withColumn("series", F.lit("revenue"))


FORECAST = f"""(SELECT series, i AS period, predicted, predicted - width AS lower, predicted + width AS upper, r_squared, rmse,
  strftime(last_ts::DATE + i::INT, '%Y-%m-%d') AS day FROM (SELECT *, intercept + slope * (last_day + i) AS predicted,
    1.96 * rmse * (1 + (i - 1) * 0.1) AS width FROM (
  SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / n) AS rmse, date_diff('day', first_ts, last_ts) AS last_day
  FROM {_regression_sql(DAILY_REVENUE, "series", "o_orderdate", "revenue", 20)}), range(1, 8) r(i)))"""


@query("linear_forecast", "T7", f"""
SELECT series, period, day, round(predicted, 2) AS predicted, round(lower, 2) AS lower, round(upper, 2) AS upper,
  round(r_squared, 8) AS accuracy, round(rmse, 2) AS rmse FROM {FORECAST}""")
def _(t):
    points = st.linear_forecast(daily_revenue(t), ["series"], "o_orderdate", "revenue", 7).drop("status")
    return points.withColumns({c: F.round(c, 2) for c in ("predicted", "lower", "upper", "rmse")}
                              | {"accuracy": F.round("accuracy", 8)})


@query("autoregressive_forecast", "T8")
def _(t):
    daily = st.daily_series(t.orders, ["o_orderpriority"], "o_orderdate", "o_totalprice")
    return st.autoregressive_forecast(daily, "o_orderpriority", 7)


@query("merged_anomalies", "T9", f"""
SELECT kind, variable, key, round(deviation, 6) AS deviation, round(confidence, 6) AS confidence FROM (
  SELECT kind, variable, key, deviation, confidence FROM {OUTLIERS}
  UNION ALL SELECT kind, variable, key, deviation, confidence FROM {CHANGES})
ORDER BY confidence DESC, deviation DESC, kind, variable, key LIMIT 20""")
def _(t):
    merged = st.merge_anomalies(
        st.z_score_outliers(t.events, ["event_id"], ["value"]),
        st.sudden_changes(t.events, "event_type", "ts", "value", "event_id", 3600))
    return merged.select("kind", "variable", "key", F.round("deviation", 6).alias("deviation"),
                         F.round("confidence", 6).alias("confidence"))


def _report_parts(t):
    return (
        profiling.numeric_summary(t.events.select("event_id", "user_id", "value")),
        st.linear_trend(t.events, ["event_type"], "ts", "value"),
        st.correlations(t.lineitem, REPORT_NUMBERS),
        st.z_score_outliers(t.events, ["event_id"], ["value"]),
        st.linear_forecast(daily_revenue(t), ["series"], "o_orderdate", "revenue", 7),
    )


@query("report_summary", "T10", f"""
WITH s AS (SELECT avg(c) AS mean, stddev_samp(c) AS std FROM (SELECT event_id AS c FROM events)
  UNION ALL SELECT avg(user_id), stddev_samp(user_id) FROM events
  UNION ALL SELECT avg(value), stddev_samp(value) FROM events),
t AS (SELECT {TREND_LABEL} AS trend, r_squared FROM {_regression_sql("events", "event_type", "ts", "value", 10)}),
c AS (SELECT * FROM {_correlation_sql("lineitem", REPORT_NUMBERS)}), a AS (SELECT * FROM {OUTLIERS}),
f AS (SELECT * FROM {FORECAST})
SELECT 'variables' AS item, count(*) AS n FROM s
UNION ALL SELECT 'high_variability', count(*) FILTER (std / abs(mean) > 0.5) FROM s
UNION ALL SELECT 'increasing_trends', count(*) FILTER (trend = 'increasing') FROM t
UNION ALL SELECT 'decreasing_trends', count(*) FILTER (trend = 'decreasing') FROM t
UNION ALL SELECT 'stable_trends', count(*) FILTER (trend = 'stable') FROM t
UNION ALL SELECT 'sure_increasing', count(*) FILTER (trend = 'increasing' AND r_squared > 0.7) FROM t
UNION ALL SELECT 'sure_decreasing', count(*) FILTER (trend = 'decreasing' AND r_squared > 0.7) FROM t
UNION ALL SELECT 'strong_correlations', count(*) FILTER (level = 'strong') FROM c
UNION ALL SELECT 'anomalies', count(*) FROM a
UNION ALL SELECT 'critical_anomalies', count(*) FILTER (confidence > 0.8) FROM a
UNION ALL SELECT 'forecasts', count(*) FILTER (period = 1) FROM f""")
def _(t):
    return st.report_summary(*_report_parts(t))


@query("overall_confidence", "T11", f"""
SELECT round(coalesce(avg(score), 0.5), 6) AS confidence FROM (
  SELECT r_squared AS score FROM {_regression_sql("events", "event_type", "ts", "value", 10)}
  UNION ALL SELECT CASE level WHEN 'strong' THEN 0.9 WHEN 'moderate' THEN 0.7 WHEN 'weak' THEN 0.5 END
    FROM {_correlation_sql("lineitem", REPORT_NUMBERS)}
  UNION ALL SELECT CASE WHEN coalesce(r_squared, 0) <> 0 THEN r_squared ELSE 0.6 END FROM {FORECAST} WHERE period = 1)""")
def _(t):
    _, trends, related, _, forecasts = _report_parts(t)
    return st.overall_confidence(trends, related, forecasts).withColumn("confidence", F.round("confidence", 6))


@query("insight_confidence", "T12", """
SELECT user_id, round(sum(c * w) / sum(w), 6) AS confidence,
  round(least((sum(c * w) / sum(w) + 0.5 + least(count(*) FILTER (event_type <> 'error') * 0.1, 0.3)) / 3, 1.0), 6) AS combined
FROM (SELECT *, least(value / 500, 1.0) AS c, CASE WHEN event_type = 'view' THEN 2.0 ELSE 1.0 END AS w FROM events)
GROUP BY user_id""")
def _(t):
    insights = t.events.select(
        "user_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.when(F.col("event_type") == "view", "summary").otherwise("detail").alias("insight_type"), "event_type")
    own = st.insight_confidence(insights, ["user_id"])
    successes = insights.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("successes"))
    combined = st.combined_confidence(F.col("confidence"), F.lit(0.5), F.col("successes"))
    return own.join(successes, "user_id").select(
        "user_id", F.round("confidence", 6).alias("confidence"), F.round(combined, 6).alias("combined"))


