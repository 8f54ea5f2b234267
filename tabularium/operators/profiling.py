"""Profiles, data quality scores and schema discovery over whole columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.functions.names import semantic_type_of_name
from tabularium.functions.quantiles import exact_quantiles
from tabularium.functions.text import quote
from tabularium.functions.time import day_key
from tabularium.operators.cleaning import NUMBER, quoted

# Value patterns, thresholds and weights that must equal the reference's.
PHONE_START = list("0123456789-()+ \t\n\r\f\v")
PHONE_MIN_LENGTH = 8
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
NULL_LIMIT, UNIQUE_LIMIT, CONSISTENCY_LIMIT = 0.5, 0.1, 0.9
SKEW_LIMIT, NORMAL_P, NORMAL_MIN_ROWS = 1.0, 0.05, 8

NUMBER_START = list("0123456789+-. \t\n\r\f\v")
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
BOOLEAN_TEXT = ["true", "false", "yes", "no"]


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string" if isinstance(kind, T.StringType) else "array" if isinstance(kind, T.ArrayType) else "mixed"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column: table, ordinal, column, type, nullable."""
    rows = [
        (name, i, f.name, type_name(f.dataType), f.nullable)
        for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "`table` string, ordinal int, `column` string, type string, nullable boolean")


def _melt(row: DataFrame, per_column: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per profiled column."""
    structs = [F.struct(*[value.alias(name) for name, value in entry.items()]) for entry in per_column]
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def numeric_summary(df: DataFrame) -> DataFrame:
    """Count, mean, median, sample deviation, range, quartiles and shape of every numeric column.

    All moments come from one aggregate row; the quartiles are exact (see ``exact_quantiles``).
    Normality is a Jarque-Bera test on distributed skewness and kurtosis, so no row is sampled.
    """
    names = numeric_columns(df)
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    aggregates = []
    for i, c in enumerate(names):
        v = quoted(c).cast("double")
        aggregates += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.skewness(v).alias(f"skew{i}"),
            F.kurtosis(v).alias(f"kurt{i}"),
        ]
    entries = []
    for i, c in enumerate(names):
        n, g1, g2 = F.col(f"n{i}"), F.col(f"skew{i}"), F.col(f"kurt{i}")
        enough = n > NORMAL_MIN_ROWS
        jarque_bera = n / 6 * (g1 * g1 + g2 * g2 / 4)
        p_value = F.exp(-jarque_bera / 2)
        skew = g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
        label = (
            F.when(p_value > NORMAL_P, "normal").when(skew > SKEW_LIMIT, "right_skewed")
            .when(skew < -SKEW_LIMIT, "left_skewed").otherwise("unknown")
        )
        entries.append({
            "variable": F.lit(c), "count": n, "mean": F.col(f"mean{i}"),
            "median": F.lit(quartiles.get((c, 0.5))), "std_dev": F.col(f"std{i}"),
            "min_value": F.col(f"min{i}"), "max_value": F.col(f"max{i}"),
            "q1": F.lit(quartiles.get((c, 0.25))), "q3": F.lit(quartiles.get((c, 0.75))),
            "skewness": F.when(enough, skew), "p_value": F.when(enough, p_value),
            "is_normal": F.when(enough, p_value > NORMAL_P), "distribution": F.when(enough, label),
        })
    return _melt(df.agg(*aggregates), entries).where("`count` >= 2")


LONG_VALUE = 64


def _cells(df: DataFrame) -> DataFrame:
    """(i, text): every value as text beside its column index, one row per cell."""
    names = [quoted_name(f.name) for f in df.schema.fields]
    cells = ", ".join(f"named_struct('i', {i}, 'text', CAST({n} AS STRING))" for i, n in enumerate(names))
    return df.selectExpr(f"explode(array({cells})) AS x").selectExpr("x.i", "x.text")


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# Types whose values are counted as they are: equal texts come from equal values, and reading a value as text costs more.
PLAIN_TYPES = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
# Distinct values of rows from ``_value_frequencies``: 0.0 and -0.0 are two texts of one number.
DISTINCT = "(count_if(key IS NOT NULL) - greatest(count_if(zero) - 1, 0))"


def _column_frequencies(df: DataFrame, i: int, flags: dict[str, str]) -> DataFrame:
    field = df.schema.fields[i]
    value = quoted_name(field.name)
    if isinstance(field.dataType, PLAIN_TYPES):
        fractional = isinstance(field.dataType, (T.FloatType, T.DoubleType))
        minus = "value = 0 AND CAST(value AS STRING) = '-0.0'" if fractional else "false"
        counted = df.selectExpr(f"{value} AS value").selectExpr("value", f"{minus} AS minus").groupBy("value", "minus")
        text = "IF(minus, '-0.0', CAST(value AS STRING)) AS text"
        rows = counted.agg(F.count(F.lit(1)).alias("n")).selectExpr(
            f"{i} AS i", text, f"{'coalesce(value = 0, false)' if fractional else 'false'} AS zero", "n")
        return rows.selectExpr("i", "text AS key", "zero", *[f"{test} AS `{name}`" for name, test in flags.items()], "n")
    tests = ", ".join(f"{quote(name)}, {test}" for name, test in flags.items())
    early = f"IF(length(text) > {LONG_VALUE}, named_struct('long', true{', ' if flags else ''}{tests}), NULL) AS early"
    key = f"IF(length(text) > {LONG_VALUE}, sha2(text, 256), text) AS key"
    counted = df.selectExpr(f"{i} AS i", f"CAST({value} AS STRING) AS text").selectExpr(key, early).groupBy("key", "early")
    rows = counted.agg(F.count(F.lit(1)).alias("n")).selectExpr(f"{i} AS i", "key AS text", "early", "n")
    late = [f"IF(early IS NULL, {test}, early.`{name}`) AS `{name}`" for name, test in flags.items()]
    return rows.selectExpr("i", "text AS key", "false AS zero", *late, "n")


def _value_frequencies(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(column index, value key, zero, flags, n): how often each value occurs in each column.

    Each column is read and counted by itself, map-side first, so a frequent value costs one row per
    task. ``flags`` are SQL expressions over ``i`` and ``text``, taken once per distinct value. Long texts
    travel as their SHA-256 with the flags taken before the shuffle.
    """
    columns = [_column_frequencies(df, i, flags) for i in range(len(df.columns))]
    return reduce(DataFrame.unionByName, columns)


def _by_column(values: Sequence) -> str:
    """SQL literal looked up by column index."""
    def literal(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else quote(v)

    return f"get(array({', '.join(literal(v) for v in values)}), i)"


def field_profile(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """One row per column with null share, uniqueness, type consistency, value patterns, semantic type.

    ``exact=False`` replaces the distinct counts by HyperLogLog sketches, which saves the only
    shuffle that grows with the data.
    """
    names = [f.name for f in df.schema.fields]
    kinds = [type_name(f.dataType) for f in df.schema.fields]
    scalar = _by_column([k not in ("array", "mixed") for k in kinds])
    is_text = _by_column([k == "string" for k in kinds])

    def starts(characters: Sequence[str]) -> str:
        return f"substring(text, 1, 1) IN ({', '.join(quote(c) for c in characters)})"

    # Cheap character tests come first; the regular expressions only see values that pass them.
    form = f"""CASE WHEN text IS NULL THEN NULL WHEN {starts(NUMBER_START)} AND text RLIKE {quote(NUMBER)} THEN 0
        WHEN substring(text, 5, 1) = '-' AND text RLIKE {quote(DATE_TEXT)} THEN 1
        WHEN length(text) <= {max(map(len, BOOLEAN_TEXT))} AND lower(text) IN ({', '.join(quote(w) for w in BOOLEAN_TEXT)}) THEN 2 ELSE 3 END"""
    flags = {
        "length": "length(text)",
        "form": f"IF({is_text}, {form}, NULL)",
        "email": f"{scalar} AND contains(text, '@') AND contains(text, '.')",
        "phone": f"{scalar} AND {starts(PHONE_START)} AND length(text) >= {PHONE_MIN_LENGTH}",
        "date": f"{scalar} AND substring(text, 5, 1) = '-' AND text RLIKE {quote(ISO_DATE)}",
        "uuid": f"{scalar} AND substring(text, 9, 1) = '-' AND text RLIKE {quote(UUID)}",
        "url": f"{scalar} AND (startswith(text, 'http://') OR startswith(text, 'https://'))",
    }
    if exact:
        counted, distinct = _value_frequencies(df, flags), DISTINCT
    else:
        counted = _cells(df).selectExpr("i", "text AS key", "1 AS n", *[f"{v} AS `{k}`" for k, v in flags.items()])
        distinct = "approx_count_distinct(key)"
    row = counted.groupBy("i").agg(*[F.expr(e) for e in (
        "sum(n) AS total", "coalesce(sum(n) FILTER (WHERE key IS NOT NULL), 0) AS filled", f"{distinct} AS unique_values",
        "min(length) AS shortest", "max(length) AS longest",
        *[f"coalesce(bool_or({flag}), false) AS {flag}" for flag in ("email", "phone", "date", "uuid", "url")],
        *[f"sum(IF(form = {k}, n, 0)) AS form{k}" for k in range(4)],
    )])
    return row.selectExpr(
        f"{quote(table)} AS table", f"{_by_column(names)} AS field", f"{_by_column(kinds)} AS type", "total", "filled",
        "unique_values", "(total - filled) / total AS null_rate", "unique_values / total AS uniqueness",
        f"IF({is_text} AND filled > 0, greatest(form0, form1, form2, form3) / filled, 1.0D) AS consistency",
        """array_compact(array(IF(email, 'email_format', NULL), IF(phone, 'phone_format', NULL), IF(date, 'iso_date', NULL),
            IF(uuid, 'uuid_format', NULL), IF(shortest = longest AND longest > 1, concat('fixed_length_', longest), NULL)))
            AS patterns""",
        f"""coalesce({_by_column([semantic_type_of_name(n) for n in names])}, CASE WHEN {is_text} AND email THEN 'email'
            WHEN {is_text} AND url THEN 'url' WHEN {is_text} AND phone THEN 'phone' ELSE 'general' END) AS semantic_type""",
    )


def with_quality(profile: DataFrame) -> DataFrame:
    """Add ``anomalies`` and ``quality_score`` per field."""
    anomalies = F.array_compact(F.array(
        F.when(F.col("null_rate") > NULL_LIMIT, "high_null_rate"),
        F.when((F.col("uniqueness") < UNIQUE_LIMIT) & ~F.col("type").isin("category", "boolean"), "low_uniqueness"),
        F.when(F.col("consistency") < CONSISTENCY_LIMIT, "inconsistent_types"),
    ))
    good_spread = F.when(F.col("uniqueness").between(0.1, 0.9), 0.1).otherwise(0.0)
    score = 1.0 - F.col("null_rate") * 0.3 - (1.0 - F.col("consistency")) * 0.4 + good_spread
    return profile.withColumns({
        "anomalies": anomalies, "quality_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)),
    })


def quality_issues(fields: DataFrame) -> DataFrame:
    """One row per anomaly with its issue type and severity."""
    issue_types = F.create_map(*[F.lit(x) for x in (
        "high_null_rate", "completeness", "inconsistent_types", "consistency", "low_uniqueness", "uniqueness")])
    severities = F.create_map(*[F.lit(x) for x in (
        "high_null_rate", "medium", "inconsistent_types", "high", "low_uniqueness", "low")])
    return fields.select("table", "field", F.explode("anomalies").alias("anomaly")).withColumns({
        "issue_type": issue_types[F.col("anomaly")], "severity": severities[F.col("anomaly")],
    })


def quality_dimensions(fields: DataFrame) -> DataFrame:
    """Five dimension scores and the weighted overall score per table."""

    def share(flag: Column, bad: float, good: float) -> Column:
        return F.avg(F.when(flag, bad).otherwise(good))

    scores = fields.groupBy("table").agg(
        share(F.array_contains("anomalies", "high_null_rate"), 0.3, 0.9).alias("completeness"),
        share(F.array_contains("anomalies", "inconsistent_types"), 0.4, 0.9).alias("consistency"),
        F.lit(0.8).alias("accuracy"),
        share(F.array_contains("anomalies", "low_uniqueness"), 0.3, 0.8).alias("uniqueness"),
        share(F.size("patterns") > 0, 0.9, 0.7).alias("validity"),
        F.avg("quality_score").alias("schema_score"),
    )
    overall = (
        F.col("completeness") * 0.25 + F.col("consistency") * 0.25 + F.col("accuracy") * 0.20
        + F.col("uniqueness") * 0.15 + F.col("validity") * 0.15
    )
    return scores.withColumn("overall", overall)


def quality_of_tables(tables: dict[str, DataFrame], exact: bool = True) -> DataFrame:
    fields = reduce(DataFrame.unionByName, [field_profile(df, name, exact) for name, df in tables.items()])
    return with_quality(fields)


def catalog_overview(dimensions: DataFrame, relationships: int) -> DataFrame:
    """How many tables score high, medium and low, and which recommendations follow."""
    overall, completeness = F.round("overall", 2), F.round("completeness", 2)
    counted = dimensions.agg(
        F.count(F.lit(1)).alias("tables"), F.count_if(overall >= 0.8).alias("high_quality"),
        F.count_if((overall >= 0.6) & (overall < 0.8)).alias("medium_quality"),
        F.count_if(overall < 0.6).alias("low_quality"), F.count_if(completeness < 0.7).alias("incomplete"),
    ).withColumn("relationships", F.lit(relationships).cast("long"))
    advice = F.array_compact(F.array(
        F.when(F.col("low_quality") > 0, "improve_quality"), F.when(F.col("relationships") > 0, "join_related"),
        F.when(F.col("tables") > 1, "standardize_names"), F.when(F.col("incomplete") > 0, "fill_missing"),
    ))
    return counted.withColumn(
        "recommendations", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("well_organized"))))


def column_roles(df: DataFrame) -> DataFrame:
    """Numeric (> 70 % of values), categorical (< 50 % distinct, not numeric) and date-named columns."""
    numeric_type = _by_column([isinstance(f.dataType, T.NumericType) for f in df.schema.fields])
    text_type = _by_column([isinstance(f.dataType, T.StringType) for f in df.schema.fields])
    digits = f"{text_type} AND regexp_replace(text, '[.-]', '') RLIKE {quote(r'^\d+$')}"
    counted = _value_frequencies(df, {"numeric": f"{numeric_type} OR ({digits})"})
    shares = counted.where("key IS NOT NULL").groupBy("i").agg(
        F.expr("sum(IF(numeric, n, 0)) / sum(n) > 0.7 AS is_numeric"), F.expr(f"{DISTINCT} / sum(n) < 0.5 AS repeats"))
    dated = [any(w in c.lower() for w in ("date", "time", "created", "updated")) for c in df.columns]
    return shares.selectExpr(f"{_by_column(df.columns)} AS field", "is_numeric", "NOT is_numeric AND repeats AS is_categorical",
                             f"{_by_column(dated)} AS is_date")


def category_counts(df: DataFrame, category: str) -> DataFrame:
    """Data behind a bar chart of a categorical column."""
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("count"))


def trend_line(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Data behind a line chart: one point per day."""
    return df.groupBy(day_key(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.sum(value).alias("total"))


def scatter_pairs(df: DataFrame, x: str, y: str, key: str, points: int | None = None) -> DataFrame:
    """Point pairs for a scatter plot: all, or on request a seeded sample that is the same on every run."""
    pairs = df.select(key, x, y)
    return pairs if points is None else pairs.orderBy(F.xxhash64(F.col(key)), key).limit(points)


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """Number of distinct non-null values per column."""
    if exact:
        rows = _value_frequencies(df, {}).groupBy("i").agg(F.expr(f"{DISTINCT} AS unique_values"))
        return rows.selectExpr(f"{_by_column(df.columns)} AS field", "unique_values")
    row = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"u{i}") for i, c in enumerate(df.columns)])
    return _melt(row, [{"field": F.lit(c), "unique_values": F.col(f"u{i}")} for i, c in enumerate(df.columns)])
