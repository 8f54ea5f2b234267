"""Versions, lineage and duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabularium.functions.skew import join_checked
from tabularium.functions.time import epoch_seconds
from tabularium.operators.relational import sort_column, top_per_group


def create_versions(versions: DataFrame, incoming: DataFrame, key: str, user: Column, as_of: Column) -> DataFrame:
    """Next version number of every incoming resource, as audit rows."""
    current = versions.groupBy(key).agg(F.max("version").alias("version_before"))
    joined = incoming.join(current, key, "left")
    return joined.select(
        key, F.when(F.col("version_before").isNull(), "create").otherwise("update").alias("operation"),
        "version_before", (F.coalesce("version_before", F.lit(0)) + 1).alias("version_after"),
        user.alias("user_id"), as_of.alias("ts"))


def version_history(versions: DataFrame, key: str, value) -> DataFrame:
    return versions.where(F.col(key) == value).orderBy(F.desc("version"))


def version_of_file(path: Column) -> Column:
    """Version number from a file name of the form ``v<n>_<name>``."""
    return F.regexp_extract(path, r"/v(\d+)_[^/]*$", 1).try_cast("int")


def read_as_of(versions: DataFrame, key: str, version) -> DataFrame:
    """Rows of the newest version not beyond ``version``, per resource."""
    known = versions.where(F.col("version") <= version)
    rest = [c for c in versions.columns if c not in (key, "version")]
    newest = known.groupBy(key).agg(F.max_by(F.struct("version", *rest), "version").alias("s"))
    return newest.select(key, "s.*")


def roll_back(versions: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """Copy the target version of each resource as its newest version; targets(key, target)."""
    newest = versions.join(targets, key, "left_semi").groupBy(key).agg(F.max("version").alias("__newest"))
    chosen = versions.join(targets, (versions[key] == targets[key]) & (versions["version"] == targets["target"]), "left_semi")
    return chosen.join(newest, key).withColumn("version", F.col("__newest") + 1).select(*versions.columns)


def deletion_state(flags: DataFrame, key: str) -> DataFrame:
    """Latest delete/restore flag per resource; flags(key, ts, event_id, is_deleted)."""
    return flags.groupBy(key).agg(F.max_by("is_deleted", F.struct("ts", "event_id")).alias("is_deleted"))


def hard_delete(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """All rows but those of removed resources."""
    return rows.join(removed, key, "left_anti")


def prune_versions(versions: DataFrame, key: str, keep: int) -> DataFrame:
    """Versions older than the newest ``keep`` of their resource.

    The cut-off comes from a per-key top-k that is pruned inside map tasks, never from a full sort.
    """
    newest = top_per_group(versions.select(key, "version"), [key], ["version desc"], keep)
    cutoff = newest.groupBy(key).agg(F.min("version").alias("__cut"), F.count(F.lit(1)).alias("__n")).where(
        F.col("__n") == keep).select(key, "__cut")
    return join_checked(versions, cutoff, [key]).where(F.col("version") < F.col("__cut")).drop("__cut")


def older_than(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(epoch_seconds(ts) < epoch_seconds(as_of) - days * 86_400)


def audit_trail(log: DataFrame, keys: Sequence[str], limit: int = 100) -> DataFrame:
    """Newest audit rows per resource."""
    newest = W.partitionBy(*keys).orderBy(*[sort_column(c) for c in ("ts desc", "event_id desc")])
    return log.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def content_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every row whose content occurs more than once, with the kept (smallest) key and the copy count.

    A group of copies stays spread over tasks: only (hash, first key, count) is joined back.
    """
    hashed = df.select(key, F.sha2(text, 256).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.min(key).alias("kept"), F.count(F.lit(1)).alias("copies"))
    return join_checked(hashed, groups.where("copies > 1"), ["content_hash"])


def integrity_check(manifest: DataFrame, data: DataFrame, key: str, text: str) -> DataFrame:
    """Compare stored with recomputed hashes: ok, changed, missing data, unknown (not in the manifest)."""
    actual = data.select(key, F.sha2(text, 256).alias("actual_hash"))
    joined = manifest.join(actual, key, "outer")
    status = (
        F.when(F.col("stored_hash").isNull(), "unknown").when(F.col("actual_hash").isNull(), "missing")
        .when(F.col("stored_hash") == F.col("actual_hash"), "ok").otherwise("changed")
    )
    return joined.select(key, status.alias("status"))


def field_lineage(mappings: DataFrame, catalog: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """mappings(unified_field, resource_id, source_field) -> lineage rows ``unified <- file.field`` with what the source holds.

    ``known`` counts the rows that have a value and ``distinct_values`` the values. A table is unpivoted once and its values
    are counted map-side, so a value of any share of the rows is one row a task.
    """
    wanted = {(r["resource_id"], r["source_field"]) for r in mappings.select("resource_id", "source_field").collect()}
    parts = []
    for resource, df in tables.items():
        mine = [c for c in df.columns if (resource, c) in wanted]
        if mine:
            cells = F.array(*[F.struct(F.lit(c).alias("source_field"), F.col(f"`{c}`").cast("string").alias("value")) for c in mine])
            values = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("source_field", "value").agg(F.count(F.lit(1)).alias("n"))
            held = values.groupBy("source_field").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("known"), F.count("value").alias("distinct_values"))
            parts.append(held.withColumn("resource_id", F.lit(resource)))
    named = mappings.join(catalog.select("resource_id", "original_filename"), "resource_id", "left")
    origin = F.concat_ws(".", F.coalesce("original_filename", "resource_id"), "source_field")
    if not parts:
        return named.select("unified_field", origin.alias("origin"), F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("distinct_values"))
    counted = named.join(reduce(DataFrame.unionByName, parts), ["resource_id", "source_field"], "left")
    return counted.select("unified_field", origin.alias("origin"), "known", "distinct_values")
