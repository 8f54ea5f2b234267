"""The resource catalog: building it, reading it, and ranking resources for a question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabularium.functions.text import quote, strings_sql
from tabularium.functions.time import epoch_seconds

# Question words of the type hint; must equal the reference's.
QUANTITY_WORDS = ["count", "sum", "average", "total", "statistics"]
CONTENT_WORDS = ["content", "text", "document", "information"]

CATALOG_COLUMNS = [
    "resource_id", "client_id", "user_id", "resource_type", "data_type", "original_filename", "file_size_bytes",
    "created_at", "version", "is_deleted", "row_count", "column_count", "chunk_count", "file_hash",
]


def resource_uuid(key: Column) -> Column:
    """Stable UUID v4 text from a key."""
    h = F.md5(key.cast("string"))
    part = lambda start, size: F.substring(h, start, size)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)),
                       F.concat(F.lit("a"), part(18, 3)), part(21, 12))


def catalog_of_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One resource per document; small documents count as JSON, medium ones as tables, long ones as text."""
    kind = F.when(F.col("n_chars") < 400, "json").when(F.col("n_chars") < 1500, "structured").otherwise("unstructured")
    suffix = F.when(kind == "json", "json").when(kind == "structured", "csv").otherwise("txt")
    flags = labels.select("doc_id", (F.col("toxic") == 1).alias("is_deleted"))
    return documents.join(flags, "doc_id", "left").select(
        resource_uuid(F.col("doc_id")).alias("resource_id"), F.concat(F.lit("client-"), "lang").alias("client_id"),
        F.col("source").alias("user_id"), kind.alias("resource_type"), suffix.alias("data_type"),
        F.concat(F.col("source"), F.lit(" report_"), "doc_id", F.lit("."), suffix).alias("original_filename"),
        F.col("n_chars").alias("file_size_bytes"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 600)").alias("created_at"),
        F.lit(1).alias("version"), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"),
        F.when(kind == "structured", F.col("n_chars")).alias("row_count"),
        F.when(kind == "structured", F.length("source")).alias("column_count"),
        F.when(kind == "unstructured", F.floor(F.col("n_chars") / 500)).alias("chunk_count"),
        F.sha2("text", 256).alias("file_hash"),
    )


def list_resources(
    catalog: DataFrame, client_id: str, user_id: str | None = None, include_deleted: bool = False
) -> DataFrame:
    """Resources of a client (and user), newest first."""
    found = catalog.where(F.col("client_id") == client_id)
    if user_id is not None:
        found = found.where(F.col("user_id") == user_id)
    if not include_deleted:
        found = found.where(~F.col("is_deleted"))
    return found.orderBy(F.desc("created_at"), "resource_id")


def resource_rows(catalog: DataFrame, data: DataFrame, resource_id: str) -> DataFrame:
    """Data rows of one live resource; ``data`` carries ``resource_id``."""
    live = catalog.where((F.col("resource_id") == resource_id) & ~F.col("is_deleted")).select("resource_id")
    return data.where(F.col("resource_id") == resource_id).join(live, "resource_id", "left_semi")


def catalog_statistics(catalog: DataFrame) -> DataFrame:
    """Long statistics (dimension, key, resources, bytes, rows, chunks, deleted) from one shuffle."""
    dimensions = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("key")),
        *[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("key")) for c in ("resource_type", "data_type")],
    )
    cells = catalog.select("file_size_bytes", "row_count", "chunk_count", "is_deleted", F.explode(dimensions).alias("d"))
    return cells.groupBy("d.dimension", "d.key").agg(
        F.count(F.lit(1)).alias("resources"), F.sum("file_size_bytes").alias("total_bytes"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"),
        F.count_if(F.col("is_deleted")).alias("deleted"),
    )


def storage_statistics(catalog: DataFrame, as_of: Column) -> DataFrame:
    """Live resources, bytes and uploads of the last seven days per client."""
    recent = (epoch_seconds(as_of) - epoch_seconds("created_at")) < 7 * 86_400
    return catalog.where(~F.col("is_deleted")).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("total_resources"),
        *[F.count_if(F.col("resource_type") == k).alias(k) for k in ("structured", "json", "unstructured")],
        F.sum("file_size_bytes").alias("total_bytes"), F.count_if(recent).alias("recent_uploads"),
    )


def summary_synthesis(catalog: DataFrame) -> DataFrame:
    """Breakdown by type, rows, megabytes and creation span of the chosen resources."""
    return catalog.agg(
        F.count(F.lit(1)).alias("total_resources"),
        *[F.count_if(F.col("resource_type") == k).alias(k) for k in ("structured", "unstructured", "json")],
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.round(F.sum("file_size_bytes") / (1024 * 1024), 2).alias("total_mb"),
        F.min("created_at").cast("string").alias("earliest"), F.max("created_at").cast("string").alias("latest"),
    )


def _words(text: str) -> list[str]:
    import re
    return re.findall(r"\w+", text.lower())


def relevance(question: str, scorer: str, as_of: Column, desired_fields: Sequence[str] = ()) -> Column:
    """Relevance of a catalog row to one question under one of the four catalog scorers."""
    days = F.floor((epoch_seconds(as_of) - epoch_seconds("created_at")) / 86_400)
    name = "lower(original_filename)"
    name_words = f"regexp_extract_all({name}, '(?U)(\\\\w+)', 1)"
    asked = strings_sql(sorted(set(_words(question)))) if _words(question) else "array()"
    overlap = F.expr(f"size(array_intersect(array_distinct({name_words}), {asked}))")
    many_rows = F.coalesce(F.col("row_count") > 100, F.lit(False))
    large = many_rows | F.coalesce(F.col("chunk_count") > 10, F.lit(False))
    lowered = question.lower()
    if scorer == "analysis":
        contained = " OR ".join(f"contains({name}, {quote(w)})" for w in lowered.split()) or "false"
        rows, columns = F.coalesce("row_count", F.lit(0)), F.coalesce("column_count", F.lit(0))
        score = (
            F.when(F.expr(contained), 0.3).otherwise(0.0)
            + F.when(rows > 1000, 0.3).when(rows > 100, 0.2).when(rows > 10, 0.1).otherwise(0.0)
            + F.when(columns > 10, 0.2).when(columns > 5, 0.1).otherwise(0.0)
            + F.when(days < 7, 0.2).when(days < 30, 0.1).otherwise(0.0)
        )
    elif scorer == "analyst":
        quantity = any(w in lowered for w in QUANTITY_WORDS)
        content = any(w in lowered for w in CONTENT_WORDS)
        hint = F.when((F.col("resource_type") == "structured") & F.lit(quantity), 0.3).when(
            (F.col("resource_type") == "unstructured") & F.lit(content), 0.3).otherwise(0.0)
        score = (
            overlap / F.greatest(F.expr(f"size({name_words})"), F.lit(1)) * 0.4 + hint
            + F.when(days < 30, 0.1).otherwise(0.0) + F.when(large, 0.1).otherwise(0.0)
        )
    elif scorer == "planning":
        filled = F.coalesce(F.col("row_count") > 0, F.lit(False)) | F.coalesce(F.col("chunk_count") > 0, F.lit(False))
        score = (
            overlap / F.greatest(F.expr(f"size(array_distinct({name_words}))"), F.lit(1)) * 0.3
            + F.when(days < 7, 0.1).when(days < 30, 0.05).otherwise(0.0) + F.when(filled, 0.1).otherwise(0.0)
        )
        if desired_fields:
            shared = F.size(F.array_intersect("columns", F.array(*[F.lit(f) for f in desired_fields])))
            score = score + F.when(F.col("resource_type") == "structured", shared / len(desired_fields) * 0.5).otherwise(0.0)
    elif scorer == "context":
        score = F.greatest(
            overlap / F.greatest(F.expr(f"size(array_distinct({name_words}))"), F.lit(1)) * 0.5
            + F.when(days < 7, 0.2).when(days < 30, 0.1).otherwise(0.0) + F.when(large, 0.1).otherwise(0.0), F.lit(0.1))
    else:
        raise ValueError(f"unknown scorer {scorer}")
    return F.least(score, F.lit(1.0))


# (lowest score, whether the bound itself counts, rows kept) per scorer.
SELECTION = {"analysis": (0.1, False, 5), "analyst": (0.1, True, 10), "planning": (0.1, False, 10), "context": (0.0, True, None)}


def rank_resources(catalog: DataFrame, questions: Sequence[str], scorer: str, as_of: Column) -> DataFrame:
    """Most relevant resources per question.

    Questions are literals, so the catalog is read once and never multiplied by a join.
    """
    if scorer == "analysis":
        catalog = catalog.where("resource_type = 'structured'")
    bound, inclusive, keep = SELECTION[scorer]
    cells = F.array(*[
        F.struct(F.lit(i).alias("question"), F.round(relevance(q, scorer, as_of), 6).alias("score"))
        for i, q in enumerate(questions)
    ])
    scored = catalog.select("resource_id", F.explode(cells).alias("x")).select("x.question", "resource_id", "x.score")
    scored = scored.where(F.col("score") >= bound if inclusive else F.col("score") > bound)
    if keep is None:
        return scored
    best = W.partitionBy("question").orderBy(F.desc("score"), "resource_id")
    return scored.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= keep).drop("__r")
