"""Trends, seasonality, correlations, anomalies and forecasts over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabularium.functions.ordered import with_previous
from tabularium.functions.skew import join_checked
from tabularium.functions.time import day_key, whole_days_between

# Thresholds that must equal the reference's.
TREND_MIN_ROWS, FLAT_SLOPE = 10, 0.001
SEASON_MIN_ROWS, SEASON_PEAK_SHARE, SEASON_MIN_PERIOD = 24, 0.3, 2
CORRELATION_MIN_PAIRS = 10
STRONG, MODERATE, WEAK = 0.7, 0.5, 0.3
OUTLIER_MIN_ROWS, Z_LIMIT = 10, 3.0
FOREST_MIN_ROWS, FOREST_TREES, FOREST_SAMPLE, CONTAMINATION, FOREST_SEED = 50, 100, 256, 0.1, 42
JUMP_MIN_ROWS = 20
FORECAST_MIN_ROWS, Z_95, WIDENING = 20, 1.96, 0.1
AR_MIN_DAYS = 50
VARIABLE_CV, HIGH_CONFIDENCE, CRITICAL_CONFIDENCE = 0.5, 0.7, 0.8
LEVEL_SCORES = {"strong": 0.9, "moderate": 0.7, "weak": 0.5}
DEFAULT_FORECAST_SCORE, DEFAULT_CONFIDENCE = 0.6, 0.5
TOO_FEW = "too_few_rows"


def _regression(df: DataFrame, keys: Sequence[str], ts: str, value: str, min_rows: int) -> DataFrame:
    """Least squares of value on whole days since the first row, one row per series, with a status for short ones."""
    known = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*keys, ts, value)
    starts = known.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    days = join_checked(known, starts, list(keys)).withColumn("day", whole_days_between("first_ts", ts))
    return days.groupBy(*keys, "first_ts", "last_ts").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(value, "day").alias("slope"),
        F.regr_intercept(value, "day").alias("intercept"), F.regr_r2(value, "day").alias("r_squared"),
        F.regr_sxx(value, "day").alias("sxx"), F.regr_sxy(value, "day").alias("sxy"),
        F.regr_syy(value, "day").alias("syy"),
    ).withColumn("status", F.when(F.col("n") >= min_rows, "ok").otherwise(TOO_FEW))


def linear_trend(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Slope, fit and direction per series; the fit is the confidence. A short series has its status and no trend."""
    direction = (
        F.when(F.abs("slope") < FLAT_SLOPE, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    )
    fitted = _regression(df, keys, ts, value, TREND_MIN_ROWS)
    ok = F.col("status") == "ok"
    fitted = fitted.withColumns({"slope": F.when(ok, F.col("slope")), "r_squared": F.when(ok, F.col("r_squared"))})
    return fitted.select(
        *keys, "n", "status", "slope", "r_squared", F.when(ok, direction).alias("trend"), F.col("r_squared").alias("confidence"))


def short_series(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Series that an analysis leaves out for want of rows, and which ones: (keys, n, left_out)."""
    bounds = {
        "trend": TREND_MIN_ROWS, "sudden_changes": JUMP_MIN_ROWS, "linear_forecast": FORECAST_MIN_ROWS, "autoregressive_forecast": AR_MIN_DAYS,
    }
    counted = df.groupBy(*keys).agg(F.count(value).alias("n"))
    out = F.array_compact(F.array(*[F.when(F.col("n") < least, F.lit(name)) for name, least in bounds.items()]))
    return counted.withColumn("left_out", out).where(F.size("left_out") > 0)


def daily_series(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """One mean value per series and day."""
    return df.groupBy(*keys, day_key(ts).alias("day")).agg(F.avg(value).alias("value"))


def first_peak(values: np.ndarray, height: float) -> int | None:
    """Index of the first local maximum (middle of a plateau) of at least ``height``."""
    i, last = 1, len(values) - 1
    while i < last:
        if values[i - 1] < values[i]:
            end = i
            while end < last and values[end + 1] == values[i]:
                end += 1
            if end < last and values[end + 1] < values[i] and values[i] >= height:
                return (i + end) // 2
            i = end
        i += 1
    return None


def seasonality(daily: DataFrame, key: str) -> DataFrame:
    """Seasonal period per series from the first autocorrelation peak.

    The input holds one row per day, so a group is bounded by the number of days.
    """
    kind = daily.schema[key].dataType.simpleString()

    def detect(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("day")["value"].to_numpy(dtype=float)
        period = None
        if len(values) > SEASON_MIN_ROWS:
            auto = np.correlate(values, values, mode="full")[len(values) - 1:]
            peak = first_peak(auto[1:], SEASON_PEAK_SHARE * auto.max())
            period = None if peak is None else peak + 1
        return pd.DataFrame({
            key: [group[key].iloc[0]], "days": [len(values)], "period": pd.array([period], dtype="Int64"),
            "seasonal": [bool(period and period > SEASON_MIN_PERIOD)],
        })

    return daily.groupBy(key).applyInPandas(detect, f"{key} {kind}, days long, period long, seasonal boolean")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    total = d
    for m in range(1, 300):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation from the t distribution with n - 2 degrees of freedom."""
    from math import exp, lgamma, log

    if n <= 2 or r is None or np.isnan(r):
        return float("nan")
    a, b, x = (n - 2) / 2.0, 0.5, max(0.0, 1.0 - r * r)
    if x in (0.0, 1.0):
        return x
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_level(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= STRONG, "strong").when(size >= MODERATE, "moderate").when(size >= WEAK, "weak").otherwise("none")


def correlations(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Pearson correlation of every column pair from one aggregate; ``limit`` keeps the strongest for a display.

    Pairs with too few values come back with the status ``too_few_rows`` and no correlation.
    """
    pairs = list(combinations(columns, 2))
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggregates += [F.count_if(both).alias(f"n{i}"), F.corr(a, b).alias(f"r{i}")]
    cells = F.array(*[
        F.struct(F.lit(a).alias("variable1"), F.lit(b).alias("variable2"), F.col(f"n{i}").alias("pairs"),
                 F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ])
    rows = df.agg(*aggregates).select(F.explode(cells).alias("x")).select("x.*")
    enough = F.col("pairs") >= CORRELATION_MIN_PAIRS
    rows = rows.withColumns({"r": F.when(enough, F.col("r")), "status": F.when(enough, "ok").otherwise(TOO_FEW)})

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else pearson_p(x, int(k)) for x, k in zip(r, n)], dtype=float)

    known = F.col("r").isNotNull()
    levelled = rows.withColumns({
        "level": F.when(known, correlation_level(F.col("r"))),
        "direction": F.when(F.col("r") > 0, "positive").when(known, "negative"),
    })
    if limit is not None:
        levelled = levelled.orderBy(F.abs("r").desc_nulls_last(), "variable1", "variable2").limit(limit)
    return levelled.withColumn("p_value", p_value("r", "pairs"))


def z_score_outliers(df: DataFrame, keys: Sequence[str], columns: Sequence[str], per_column: int | None = None) -> DataFrame:
    """Values beyond three population deviations; ``per_column`` keeps only the largest few.

    Column statistics are one subquery row, so the table is scanned twice and never joined.
    """
    stats = df.agg(F.struct(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns
    ]).alias("s")).scalar()
    key = F.concat_ws("-", *keys).alias("key")
    with_stats = df.select(key, *columns, stats.alias("__s"))
    cells = []
    for c in columns:
        s = F.col(f"__s.{c}")
        z = F.abs((F.col(c) - s["mean"]) / F.nullif(s["std"], F.lit(0.0)))
        cells.append(F.when((s["n"] >= OUTLIER_MIN_ROWS) & (z > Z_LIMIT), F.struct(
            F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"), s["mean"].alias("expected"),
            z.alias("deviation"), F.least(z / Z_LIMIT, F.lit(1.0)).alias("confidence"))))
    found = with_stats.select("key", F.explode(F.array_compact(F.array(*cells))).alias("x")).select(
        F.lit("outlier").alias("kind"), "x.variable", "key", "x.value", "x.expected", "x.deviation", "x.confidence")
    if per_column is None:
        return found
    largest = W.partitionBy("variable").orderBy(F.desc("deviation"), "key")
    return found.withColumn("__r", F.row_number().over(largest)).where(F.col("__r") <= per_column).drop("__r")


def sudden_changes(
    df: DataFrame, series: str, ts: str, value: str, key: str, slice_seconds: float, per_kind: int | None = None
) -> DataFrame:
    """Spikes and drops: steps beyond mean plus or minus three deviations of all steps of the series."""
    known = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(series, ts, value, key)
    steps = (
        with_previous(known, [series], ts, {"expected": value}, slice_seconds, [key])
        .withColumn("step", F.col(value) - F.col("expected"))
    )
    spread = steps.groupBy(series).agg(
        F.count(F.lit(1)).alias("__n"), F.avg("step").alias("__mean"), F.stddev_pop("step").alias("__std"))
    kind = (
        F.when(F.col("step") > F.col("__mean") + 3 * F.col("__std"), "spike")
        .when(F.col("step") < F.col("__mean") - 3 * F.col("__std"), "drop")
    )
    deviation = F.abs("step") / F.col("__std")
    found = (
        join_checked(steps, spread.where(F.col("__n") >= JUMP_MIN_ROWS), [series])
        .withColumn("kind", kind).where(F.col("kind").isNotNull())
        .select("kind", F.col(series).cast("string").alias("variable"), F.col(key).cast("string").alias("key"), ts,
                F.col(value).cast("double").alias("value"), "expected", deviation.alias("deviation"),
                F.least(deviation / 3, F.lit(1.0)).alias("confidence"))
    )
    if per_kind is None:
        return found
    first = W.partitionBy("variable", "kind").orderBy(ts, "key")
    return found.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= per_kind).drop("__r")


def merge_anomalies(*found: DataFrame, limit: int = 20) -> DataFrame:
    """Most confident anomalies of all methods (ties: larger deviation, then key)."""
    columns = ["kind", "variable", "key", "value", "expected", "deviation", "confidence"]
    merged = found[0].select(*columns)
    for more in found[1:]:
        merged = merged.unionByName(more.select(*columns))
    return merged.orderBy(F.desc("confidence"), F.desc("deviation"), "kind", "variable", "key").limit(limit)


def _average_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_forest(sample: np.ndarray, trees: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Isolation forest on one variable as a step function: interval edges and mean path length.

    On one variable every tree splits the line into intervals, so the forest is a sum of step functions.
    """
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(size, 2))))
    steps = []
    for _ in range(trees):
        points = rng.choice(sample, size=min(size, len(sample)), replace=False)
        stack, leaves = [(-np.inf, np.inf, points, 0)], []
        while stack:
            low, high, inside, depth = stack.pop()
            if depth >= limit or len(inside) <= 1 or inside.min() == inside.max():
                leaves.append((low, depth + _average_depth(len(inside))))
                continue
            split = rng.uniform(inside.min(), inside.max())
            stack.append((low, split, inside[inside < split], depth + 1))
            stack.append((split, high, inside[inside >= split], depth + 1))
        steps.append(sorted(leaves))
    edges = np.unique(np.concatenate([[low for low, _ in leaves] for leaves in steps]))
    depth = np.zeros(len(edges))
    for leaves in steps:
        lows, lengths = np.array([x for x, _ in leaves]), np.array([y for _, y in leaves])
        depth += lengths[np.searchsorted(lows, edges, side="right") - 1]
    return edges, depth / trees


def isolation_outliers(df: DataFrame, key: str, value: str) -> DataFrame:
    """The tenth of all values that an isolation forest separates fastest.

    The forest is grown from a bounded seeded sample (that is its definition); every row is scored. Too few values give
    one row with the status ``too_few_rows`` and nulls.
    """
    known = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("value"))
    drawn = known.orderBy(F.xxhash64(F.col(key), F.lit(FOREST_SEED)), key).limit(FOREST_TREES * FOREST_SAMPLE)
    sample = np.array([r["value"] for r in drawn.select("value").collect()])
    if len(sample) <= FOREST_MIN_ROWS:
        nothing = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in (key, "value")]
        empty = [F.lit(None).cast("double").alias(c) for c in ("score", "confidence")]
        return df.sparkSession.range(1).select(*nothing, *empty, F.lit(TOO_FEW).alias("status"))
    size = min(FOREST_SAMPLE, len(sample))
    edges, depth = grow_forest(sample, FOREST_TREES, size, FOREST_SEED)
    scores = 2.0 ** (-depth / _average_depth(size))

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(scores[np.searchsorted(edges, values.to_numpy(), side="right") - 1])

    scored = known.withColumn("score", score("value"))
    cut = scored.agg(F.percentile_approx("score", 1 - CONTAMINATION, 10_000)).scalar()
    # Scores are steps, so the rows on the cut value itself belong to the larger group and stay out.
    flagged = scored.withColumn("__cut", cut).where(F.col("score") > F.col("__cut"))
    return flagged.select(key, "value", "score", F.least(F.col("score") - F.col("__cut"), F.lit(1.0)).alias("confidence"), F.lit("ok").alias("status"))


def linear_forecast(df: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int) -> DataFrame:
    """Linear continuation for ``horizon`` days with widening 95 % bounds; a short series gives one row with its status."""
    fitted = _regression(df, keys, ts, value, FORECAST_MIN_ROWS)
    fitted = fitted.withColumns({
        "rmse": F.sqrt(F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / F.col("n")),
        "last_day": whole_days_between("first_ts", "last_ts"),
    })
    ok = F.col("status") == "ok"
    points = fitted.withColumn("period", F.explode(F.when(ok, F.sequence(F.lit(1), F.lit(horizon))).otherwise(F.array(F.lit(None).cast("int")))))
    predicted = F.col("intercept") + F.col("slope") * (F.col("last_day") + F.col("period"))
    width = Z_95 * F.col("rmse") * (1 + (F.col("period") - 1) * WIDENING)
    return points.withColumn("predicted", predicted).select(
        *keys, "period", F.date_add(F.col("last_ts").cast("date"), F.col("period")).cast("string").alias("day"),
        "predicted", (F.col("predicted") - width).alias("lower"), (F.col("predicted") + width).alias("upper"),
        F.when(ok, F.col("r_squared")).alias("accuracy"), F.when(ok, F.col("rmse")).alias("rmse"), "status")


def fit_autoregression(values: np.ndarray) -> tuple[float, int, int, np.ndarray, float]:
    """(AIC, lags, differences, coefficients, residual variance) of the best AR(p) with p < 3, d < 2."""
    best = None
    for d in range(2):
        series = np.diff(values, n=d)
        for p in range(3):
            rows = len(series) - 2
            if rows <= p + 2:
                continue
            target = series[2:]
            design = np.column_stack([np.ones(rows)] + [series[2 - k: len(series) - k] for k in range(1, p + 1)])
            coefficients, *_ = np.linalg.lstsq(design, target, rcond=None)
            variance = float(np.mean((target - design @ coefficients) ** 2))
            aic = rows * np.log(max(variance, 1e-12)) + 2 * (p + 2)
            if best is None or aic < best[0]:
                best = (float(aic), p, d, coefficients, variance)
    return best


def autoregressive_forecast(daily: DataFrame, key: str, horizon: int, min_days: int = AR_MIN_DAYS) -> DataFrame:
    """AR model with differencing per daily series, order by AIC, forecast with 95 % bounds; a short one has its status."""
    kind = daily.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, period int, day string, predicted double, lower double, upper double, aic double, lags int, differences int, status string"

    def forecast(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        values = group["value"].to_numpy(dtype=float)
        empty = pd.DataFrame([{c.split()[0]: None for c in schema.split(", ")} | {key: group[key].iloc[0], "status": TOO_FEW}])
        best = fit_autoregression(values) if len(values) >= min_days else None
        if best is None:
            return empty
        aic, p, d, coefficients, variance = best
        path, series = [], list(np.diff(values, n=d))
        weights, shocks = [], [1.0]
        for h in range(horizon):
            nxt = coefficients[0] + sum(coefficients[k] * series[-k] for k in range(1, p + 1))
            series.append(nxt)
            path.append(nxt)
            if h:
                shocks.append(sum(coefficients[k] * shocks[h - k] for k in range(1, p + 1) if h - k >= 0))
            weights.append(sum(shocks) if d else shocks[h])
        predicted = np.array(path) if d == 0 else values[-1] + np.cumsum(path)
        spread = Z_95 * np.sqrt(variance * np.cumsum(np.square(weights)))
        days = pd.date_range(pd.Timestamp(group["day"].iloc[-1]) + pd.Timedelta(days=1), periods=horizon)
        return pd.DataFrame({
            key: group[key].iloc[0], "period": np.arange(1, horizon + 1), "day": days.strftime("%Y-%m-%d"),
            "predicted": predicted, "lower": predicted - spread, "upper": predicted + spread, "aic": aic,
            "lags": p, "differences": d, "status": "ok",
        })

    return daily.groupBy(key).applyInPandas(forecast, schema)


def report_summary(summary: DataFrame, trends: DataFrame, related: DataFrame, anomalies: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Counts and rule flags of an analysis report as rows (item, n)."""
    def counted(df: DataFrame, **tests: Column) -> DataFrame:
        """All items of one input from one aggregate."""
        rows = F.array(*[F.struct(F.lit(item).alias("item"), F.col(item).alias("n")) for item in tests])
        return df.agg(*[F.count_if(test).alias(item) for item, test in tests.items()]).select(F.explode(rows).alias("x")).select("x.*")

    spread = (F.col("mean") != 0) & (F.col("std_dev") != 0) & (F.col("std_dev") / F.abs("mean") > VARIABLE_CV)
    sure = F.col("confidence") > HIGH_CONFIDENCE
    rising, falling = F.col("trend") == "increasing", F.col("trend") == "decreasing"
    return reduce(DataFrame.unionByName, [
        counted(summary, variables=F.lit(True), high_variability=spread),
        counted(
            trends, increasing_trends=rising, decreasing_trends=falling, stable_trends=F.col("trend") == "stable",
            sure_increasing=rising & sure, sure_decreasing=falling & sure,
        ),
        counted(related, strong_correlations=F.col("level") == "strong"),
        counted(anomalies, anomalies=F.lit(True), critical_anomalies=F.col("confidence") > CRITICAL_CONFIDENCE),
        counted(forecasts, forecasts=F.col("period") == 1),
    ])


def overall_confidence(trends: DataFrame, related: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Mean of trend fits, correlation level scores and forecast fits; 0.5 without any."""
    levels = F.create_map(*[F.lit(x) for item in LEVEL_SCORES.items() for x in item])
    fit = F.when(F.coalesce("accuracy", F.lit(0.0)) != 0, F.col("accuracy")).otherwise(DEFAULT_FORECAST_SCORE)
    scores = (
        trends.select(F.col("confidence").alias("score"))
        .unionByName(related.select(levels[F.col("level")].alias("score")))
        .unionByName(forecasts.where("period = 1").select(fit.alias("score")))
    )
    return scores.agg(F.coalesce(F.avg("score"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))


def insight_confidence(insights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean confidence of insights (insight_type, confidence); summaries weigh two."""
    weight = F.when(F.col("insight_type") == "summary", 2.0).otherwise(1.0)
    return insights.groupBy(*keys).agg((F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"))


def combined_confidence(primary: Column, routing: Column, successes: Column) -> Column:
    """Mean of primary and routing confidence and, with supporting results, their capped boost."""
    boost = F.least(successes * 0.1, F.lit(0.3))
    mean = F.when(successes.isNull(), (primary + routing) / 2).otherwise((primary + routing + boost) / 3)
    return F.least(mean, F.lit(1.0))
