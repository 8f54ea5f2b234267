"""Cleaning of tabular resources: names, blanks, missing values and column types.

Operators whose output columns depend on the data read the table once with a single aggregate row
and turn that row into a plan; applying the plan is a projection, so a stream can reuse it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.functions.names import unique_snake_case
from tabularium.functions.text import strip

# Date formats (with the shape a text must have) and boolean words; must equal the reference's.
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy-M-d H:m:s"]
DATE_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
}
GENERAL_SHAPE = r"^\s*\d{4,}-\d{1,2}"
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def strip_whitespace(df: DataFrame) -> DataFrame:
    """Trim headers and string values; the text ``nan`` becomes null, null stays null."""
    texts = set(string_columns(df))
    projected = []
    for name in df.columns:
        value = quoted(name)
        if name in texts:
            value = F.nullif(strip(value), F.lit("nan"))
        projected.append(value.alias(name))
    return df.select(*projected).toDF(*[c.strip() for c in df.columns])


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_snake_case(df.columns))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count(quoted(c)).alias(c) for c in df.columns]).first()
    return df.select(*[quoted(c) for c in df.columns if counts[c] > 0])


def _modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value per column (smallest of ties), as text, one row per column to the driver."""
    melted = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), quoted(c).cast("string").alias("v")) for i, c in enumerate(columns)
    ])).alias("x")).select("x.i", "x.v").where("v IS NOT NULL")
    counted = melted.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    # Numbers tie-break by value, text by text order.
    numeric = F.array(*[F.lit(isinstance(df.schema[c].dataType, T.NumericType)) for c in columns])
    size = F.when(F.get(numeric, F.col("i")), F.expr("try_cast(v AS DOUBLE)"))
    best = counted.groupBy("i").agg(F.min_by("v", F.struct(-F.col("n"), size, "v")).alias("v"))
    found = {row["i"]: row["v"] for row in best.collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}


def handle_missing(df: DataFrame, strategy: str = "null", threshold: float = 0.5) -> DataFrame:
    """Keep, drop or fill missing values.

    ``zero`` fills numeric columns and ``empty`` fills text columns, so types are kept.
    """
    if strategy == "null":
        return df
    if strategy == "drop_rows":
        return df.na.drop(thresh=int(len(df.columns) * (1 - threshold)))
    if strategy == "drop_cols":
        row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(quoted(c)).alias(c) for c in df.columns]).first()
        needed = int(row["__n"] * (1 - threshold))
        return df.select(*[quoted(c) for c in df.columns if row[c] >= needed])
    if strategy == "fill_mean":
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        means = df.agg(*[F.avg(quoted(c)).alias(c) for c in numeric])
        # The one-row aggregate stays a subquery of the same job.
        return df.withColumns({c: F.coalesce(quoted(c).cast("double"), means.select(c).scalar()) for c in numeric})
    if strategy == "fill_mode":
        modes = _modes(df, df.columns)
        return df.withColumns({
            c: F.coalesce(quoted(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in modes.items() if v is not None
        })
    if strategy == "fill_zero":
        return df.na.fill(0)
    if strategy == "fill_empty":
        return df.na.fill("")
    raise ValueError(f"unknown strategy {strategy}")


def as_number(value: Column) -> Column:
    return F.when(value.rlike(NUMBER), F.trim(value).try_cast("double"))


def as_time(value: Column, date_format: str | None) -> Column:
    """Parsed time or null; only texts of the right shape reach the parser, whose failures are costly."""
    parsed = F.try_to_timestamp(value, F.lit(date_format)) if date_format else value.try_cast("timestamp")
    shape = DATE_SHAPES[date_format] if date_format else GENERAL_SHAPE
    return F.when(value.rlike(shape), parsed.cast("timestamp_ntz"))


def as_boolean(value: Column) -> Column:
    word = F.lower(value)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


@dataclass
class TypePlan:
    """Chosen conversion per column, with how many values it would lose."""

    kinds: dict[str, str] = field(default_factory=dict)
    formats: dict[str, str | None] = field(default_factory=dict)
    lost: dict[str, int] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        converted = {}
        for name, kind in self.kinds.items():
            value = quoted(name)
            if kind == "integer":
                converted[name] = as_number(value).try_cast("bigint")
            elif kind == "double":
                converted[name] = as_number(value)
            elif kind == "timestamp":
                converted[name] = as_time(value, self.formats[name])
            elif kind == "boolean":
                converted[name] = as_boolean(value)
        return df.withColumns(converted) if converted else df


def _type_counts(df: DataFrame) -> list[Column]:
    counts = []
    for i, name in enumerate(string_columns(df)):
        value = quoted(name)
        number = as_number(value)
        counts += [
            F.count(value).alias(f"n{i}"),
            F.count(number).alias(f"num{i}"),
            F.count_if(number == F.floor(number)).alias(f"int{i}"),
            F.count(as_boolean(value)).alias(f"bool{i}"),
            F.count(as_time(value, None)).alias(f"general{i}"),
        ]
        counts += [F.count(as_time(value, f)).alias(f"fmt{i}_{k}") for k, f in enumerate(DATE_FORMATS)]
    return counts


def _plan_from(row, names: list[str], min_share: float) -> TypePlan:
    """A kind is taken if any value converts, or at least ``min_share`` of the non-null values."""
    plan = TypePlan()
    for i, name in enumerate(names):
        total = row[f"n{i}"]

        def enough(n: int) -> bool:
            return n > 0 and n >= min_share * total

        options = [(row[f"num{i}"], "integer" if row[f"int{i}"] == row[f"num{i}"] else "double", None)]
        options += [(row[f"fmt{i}_{k}"], "timestamp", f) for k, f in enumerate(DATE_FORMATS)]
        options += [(row[f"general{i}"], "timestamp", None)]
        options += [(row[f"bool{i}"] if row[f"bool{i}"] == total else 0, "boolean", None)]
        for hits, kind, date_format in options:
            if enough(hits):
                plan.kinds[name], plan.formats[name], plan.lost[name] = kind, date_format, total - hits
                break
    return plan


def detect_types(df: DataFrame, min_share: float = 0.0) -> TypePlan:
    """One aggregate over all text columns; every rule is tested on the original text."""
    names = string_columns(df)
    return _plan_from(df.agg(*_type_counts(df)).first(), names, min_share) if names else TypePlan()


def convert_types(df: DataFrame, min_share: float = 0.0) -> DataFrame:
    return detect_types(df, min_share).apply(df)


def convert_whole_columns(df: DataFrame) -> DataFrame:
    """Convert a text column only if every value converts: numbers first, then date-named columns."""
    names = string_columns(df)
    dated = [c for c in names if any(w in c.lower() for w in ("date", "time", "created", "updated"))]
    row = df.agg(
        *[F.count(quoted(c)).alias(f"n_{c}") for c in names],
        *[F.count(as_number(quoted(c))).alias(f"num_{c}") for c in names],
        *[F.count_if(as_number(quoted(c)) == F.floor(as_number(quoted(c)))).alias(f"int_{c}") for c in names],
        *[F.count(as_time(quoted(c), None)).alias(f"time_{c}") for c in dated],
    ).first()
    plan = TypePlan()
    for c in names:
        total = row[f"n_{c}"]
        if total and row[f"num_{c}"] == total:
            plan.kinds[c] = "integer" if row[f"int_{c}"] == total else "double"
        elif total and c in dated and row[f"time_{c}"] == total:
            plan.kinds[c], plan.formats[c] = "timestamp", None
    return plan.apply(df)


@dataclass
class CleaningResult:
    table: DataFrame
    stats: DataFrame
    types: TypePlan


def clean_table(
    df: DataFrame, missing: str = "null", threshold: float = 0.5, min_share: float = 0.0
) -> CleaningResult:
    """Strip, rename, drop empty rows and columns, handle missing values, convert types.

    With the default strategy one aggregate row decides both the empty columns and the types.
    """
    named = normalize_names(strip_whitespace(df))
    rows = drop_empty_rows(named)
    if missing == "null":
        texts = string_columns(rows)
        filled = [F.count(quoted(c)).alias(f"filled_{i}") for i, c in enumerate(rows.columns)]
        row = rows.agg(*filled, *_type_counts(rows)).first()
        types = _plan_from(row, texts, min_share)
        kept = rows.select(*[quoted(c) for i, c in enumerate(rows.columns) if row[f"filled_{i}"] > 0])
        types.kinds = {c: k for c, k in types.kinds.items() if c in kept.columns}
    else:
        kept = handle_missing(drop_empty_columns(rows), missing, threshold)
        types = detect_types(kept, min_share)
    table = types.apply(kept)
    done = ["strip_whitespace", "normalize_column_names"]
    done += [] if missing == "null" else [f"handle_missing_values ({missing})"]
    done += ["detect_and_convert_types"] if types.kinds else []
    before = df.agg(F.count(F.lit(1))).scalar()
    after = kept.agg(F.count(F.lit(1))).scalar()
    stats = df.sparkSession.range(1).select(
        before.alias("original_rows"), F.lit(len(df.columns)).cast("long").alias("original_columns"),
        after.alias("final_rows"), F.lit(len(table.columns)).cast("long").alias("final_columns"),
        (before - after).alias("rows_removed"),
        F.lit(len(df.columns) - len(table.columns)).cast("long").alias("columns_removed"),
        F.lit(", ".join(done)).alias("operations"),
    )
    return CleaningResult(table, stats, types)
