"""Ready-made aggregates chosen from column names, and the question -> template choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column-name keywords and question words that must equal the reference's.
GROUP_WORDS = ["department", "category", "type", "status", "region"]
MEASURE_WORDS = ["salary", "amount", "price", "cost", "budget", "spent"]
SCORED_MEASURE_WORDS = ["salary", "amount", "price", "cost", "budget", "spent", "score"]
LABEL_WORDS = ["name", "title", "product", "employee"]
KEY_WORDS = ["id", "name", "title", "department", "status"]
KEY_WORDS_WITH_TYPE = ["id", "name", "title", "department", "status", "type"]
DATE_WORDS = ["date", "created", "updated", "time"]
AVERAGE_QUESTION = ["average", "avg", "mean"]
COUNT_QUESTION = ["count", "how many", "number of"]
TOP_QUESTION = ["top", "highest", "maximum", "best"]
SUM_QUESTION = ["total", "sum"]
RECENT_CUTOFF = "2023-01-01"


def names_with(columns: Sequence[str], words: Sequence[str]) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in words)]


def default_aggregate(df: DataFrame) -> DataFrame:
    """Count, average and total of the first measure per first group column, ten largest groups."""
    groups = names_with(df.columns, GROUP_WORDS)
    measures = [c for c in names_with(df.columns, MEASURE_WORDS) if c not in groups]
    if not groups:
        return key_columns(df, df.columns[0], limit=50, words=KEY_WORDS)
    aggs = [F.count(F.lit(1)).alias("count")]
    if measures:
        aggs += [F.avg(measures[0]).alias(f"avg_{measures[0]}"), F.sum(measures[0]).alias(f"total_{measures[0]}")]
    return df.groupBy(groups[0]).agg(*aggs).orderBy(F.desc("count"), groups[0]).limit(10)


def average_per_group(df: DataFrame) -> DataFrame:
    groups, measures = names_with(df.columns, GROUP_WORDS), names_with(df.columns, SCORED_MEASURE_WORDS)
    if measures and groups:
        name = f"avg_{measures[0]}"
        return df.groupBy(groups[0]).agg(F.avg(measures[0]).alias(name)).orderBy(F.desc(name), groups[0])
    if measures:
        return df.agg(F.avg(measures[0]).alias("average"))
    return df.agg(F.count(F.lit(1)).alias("count"))


def count_per_group(df: DataFrame) -> DataFrame:
    groups = names_with(df.columns, GROUP_WORDS)
    if groups:
        return df.groupBy(groups[0]).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), groups[0])
    return df.agg(F.count(F.lit(1)).alias("total_count"))


def sum_per_group(df: DataFrame) -> DataFrame:
    groups, measures = names_with(df.columns, GROUP_WORDS), names_with(df.columns, MEASURE_WORDS)
    if measures and groups:
        name = f"total_{measures[0]}"
        return df.groupBy(groups[0]).agg(F.sum(measures[0]).alias(name)).orderBy(F.desc(name), groups[0])
    if measures:
        return df.agg(F.sum(measures[0]).alias("total"))
    return df.agg(F.count(F.lit(1)).alias("count"))


def top_rows(df: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Label and measure columns of the rows with the largest first measure (ties by key)."""
    measures, labels = names_with(df.columns, SCORED_MEASURE_WORDS), names_with(df.columns, LABEL_WORDS)
    if not measures:
        return df.orderBy(key).limit(limit)
    shown = labels[:2] + measures[:2] if labels else measures[:3]
    return df.orderBy(F.col(measures[0]).desc(), key).limit(limit).select(*dict.fromkeys(shown))


def key_columns(df: DataFrame, key: str, limit: int = 20, words: Sequence[str] = KEY_WORDS_WITH_TYPE) -> DataFrame:
    """Up to five identifying columns of the first rows in key order."""
    shown = names_with(df.columns, words)[:5]
    return df.orderBy(key).limit(limit).select(*(shown or df.columns))


def recent_rows(df: DataFrame, cutoff: str = RECENT_CUTOFF, limit: int = 100) -> DataFrame:
    """Rows on or after the cut-off of the first date-like column, ordered by the first column."""
    dates = names_with(df.columns, DATE_WORDS)
    if dates:
        df = df.where(F.col(dates[0]) >= F.lit(cutoff).cast(df.schema[dates[0]].dataType))
    return df.orderBy(df.columns[0]).limit(limit)


def template_for(question: str) -> str:
    """Which ready-made aggregate a question asks for."""
    asked = question.lower()
    for template, words in (
        ("average", AVERAGE_QUESTION), ("count", COUNT_QUESTION), ("top", TOP_QUESTION), ("sum", SUM_QUESTION)
    ):
        if any(w in asked for w in words):
            return template
    return "general"


def table_score(question: str, table: str, columns: Sequence[str]) -> int:
    """Two points per question word in the table name, one per (column, word) overlap."""
    words = question.lower().split()
    lowered = [c.lower() for c in columns]
    return 2 * sum(w in table.lower() for w in words) + sum(w in c or c in w for c in lowered for w in words)


def answer(question: str, tables: dict[str, DataFrame], key: dict[str, str]) -> DataFrame:
    """Pick the best matching table by name and columns, then run the asked template on all its rows."""
    best = max(tables, key=lambda name: table_score(question, name, tables[name].columns))
    df = tables[best]
    template = template_for(question)
    if template == "average":
        return average_per_group(df)
    if template == "count":
        return count_per_group(df)
    if template == "top":
        return top_rows(df, key[best])
    if template == "sum":
        return sum_per_group(df)
    return key_columns(df, key[best])
