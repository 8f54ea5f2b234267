"""Statistics over audit, upload, request and conversation activity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.ordered import with_previous, with_running_max
from tabularium.functions.time import day_key, epoch_seconds
from tabularium.operators import limiter

# Request limits per endpoint (requests, seconds), rating penalties; must equal the reference's.
RATE_LIMITS = {"analysis": (10, 60), "streaming": (5, 60), "websocket": (20, 60), "health": (60, 60), "default": (30, 60)}
RELIABLE, PENALTIES, FEW_ROWS = 0.8, {"incomplete": 0.2, "timeout": 0.1, "error": 0.3}, 10


def audit_scan(
    log: DataFrame, start: str | None = None, end: str | None = None, limit: int = 1000, **equal
) -> DataFrame:
    """Audit rows in a time span that match all given columns, newest first.

    ``log`` is partitioned by ``day``; the day predicate prunes folders before any row is read.
    """
    if start is not None:
        log = log.where((F.col("day") >= start[:10]) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        log = log.where((F.col("day") <= end[:10]) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
    for column, value in equal.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def audit_statistics(log: DataFrame, as_of: Column, days: int, dimensions: dict[str, Column]) -> DataFrame:
    """Counts of the last ``days`` days per dimension (type, severity, user, client, day) in one shuffle."""
    first_day = F.date_sub(as_of.cast("date"), days - 1)
    recent = log.where((F.col("ts").cast("date") >= first_day) & (F.col("ts") <= as_of))
    cells = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("key")) for n, c in dimensions.items()])
    return (
        recent.select(F.explode(cells).alias("d")).where("d.key IS NOT NULL")
        .groupBy("d.dimension", "d.key").agg(F.count(F.lit(1)).alias("events"))
    )


def audit_summary(log: DataFrame, resource: str, operation: str, operations: Sequence[str], version: str) -> DataFrame:
    """Per resource: operations in total and by type, first and last time, number of versions."""
    versions = log.select(resource, version).distinct().groupBy(resource).agg(F.count(version).alias("total_versions"))
    summary = log.groupBy(resource).agg(
        F.count(F.lit(1)).alias("total_operations"), F.min("ts").alias("first_operation"),
        F.max("ts").alias("last_operation"),
        *[F.count_if(F.col(operation) == o).alias(f"n_{o}") for o in operations],
    )
    return summary.join(versions, resource)


def operations_by_user(log: DataFrame, resource: str, user: str) -> DataFrame:
    return log.groupBy(resource, user).agg(F.count(F.lit(1)).alias("operations"))


def user_statistics(users: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """users(client_id, access_level, is_active, last_login) -> totals and active users per level."""
    recent = F.coalesce((epoch_seconds(as_of) - epoch_seconds("last_login")) < days * 86_400, F.lit(False))
    per_level = users.where("is_active").groupBy("access_level").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("level_"), "access_level").alias("item"), "n")
    totals = users.agg(
        F.count(F.lit(1)).alias("total_users"), F.count_if("is_active").alias("active_users"),
        F.count_if(~F.col("is_active")).alias("inactive_users"), F.count_if(recent).alias("recent_logins"),
    )
    melted = totals.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in totals.columns])).alias("x")).select("x.*")
    return melted.unionByName(per_level)


def latest_state(progress: DataFrame, key: str) -> DataFrame:
    """Newest row per key by (ts, event_id); combined map-side, so a busy key costs one row per task."""
    rest = [c for c in progress.columns if c != key]
    newest = progress.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("s"))
    return newest.select(key, "s.*")


def upload_statistics(progress: DataFrame, key: str) -> DataFrame:
    """progress(key, ts, event_id, status, total_bytes, uploaded_bytes) -> one row over the latest states."""
    done = F.col("status").isin("completed", "failed")
    return latest_state(progress, key).agg(
        F.count(F.lit(1)).alias("total_uploads"), F.count_if(~done).alias("active_uploads"),
        F.count_if(F.col("status") == "completed").alias("completed_uploads"),
        F.count_if(F.col("status") == "failed").alias("failed_uploads"),
        F.sum("total_bytes").alias("total_bytes"), F.sum("uploaded_bytes").alias("uploaded_bytes"),
        F.when(F.sum("total_bytes") > 0, F.sum("uploaded_bytes") / F.sum("total_bytes") * 100).otherwise(0.0)
        .alias("overall_percent"),
    )


def agent_performance(activity: DataFrame, as_of: Column, hours: int, keys: Sequence[str]) -> DataFrame:
    """activity(ts, activity_type, execution_ms, tokens) of the last ``hours``: counts, success rate, mean time."""
    recent = activity.where((epoch_seconds("ts") >= epoch_seconds(as_of) - hours * 3600) & (F.col("ts") <= as_of))
    response, error = F.col("activity_type") == "response", F.col("activity_type") == "error"
    answered = F.count_if(response) + F.count_if(error)
    return recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("activities"), F.count_if(F.col("activity_type") == "query").alias("queries"),
        F.count_if(response).alias("responses"), F.count_if(error).alias("errors"),
        F.when(answered > 0, F.count_if(response) / answered).otherwise(1.0).alias("success_rate"),
        F.coalesce(F.avg(F.when(response, F.col("execution_ms"))), F.lit(0.0)).alias("mean_ms"),
        F.coalesce(F.sum(F.when(response, F.col("tokens"))), F.lit(0)).alias("tokens"),
    )


def recent_activity(activity: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return activity.where((epoch_seconds("ts") >= epoch_seconds(as_of) - hours * 3600) & (F.col("ts") <= as_of))


def conversation_metrics(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, agent, tokens, ms): totals, the agents that took part, first and last turn."""
    agents = turns.select("conv_id", "agent").distinct().groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_agents"), F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("agents"))
    totals = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("total_queries"), F.sum("tokens").alias("total_tokens"), F.sum("ms").alias("total_ms"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return totals.join(agents, "conv_id")


def interface_statistics(requests: DataFrame, as_of: Column) -> DataFrame:
    """requests(conversation, ts, intent, resource, ms) -> rows (item, value): totals, intents, ages, references."""
    per_conversation = requests.groupBy("conversation").agg(F.min("ts").alias("created"))
    hours = (epoch_seconds(as_of) - epoch_seconds("created")) / 3600
    age = (
        F.when(hours < 1, "age < 1 hour").when(hours < 6, "age 1-6 hours")
        .when(hours < 24, "age 6-24 hours").otherwise("age > 24 hours")
    )
    ages = per_conversation.groupBy(age.alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    intents = requests.groupBy(F.concat(F.lit("intent "), "intent").alias("item")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    resources = requests.select("resource").distinct().agg(F.count("resource").cast("double").alias("value")).select(
        F.lit("unique resources").alias("item"), "value")
    conversations = per_conversation.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("conversations").alias("item"), "value")
    totals = requests.agg(
        F.count(F.lit(1)).cast("double").alias("queries"), F.count("resource").cast("double").alias("references"),
        F.avg("ms").alias("mean ms"))
    melted = totals.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in totals.columns])).alias("x")).select("x.*")
    return melted.unionByName(ages).unionByName(intents).unionByName(resources).unionByName(conversations)


def conversation_analytics(queries: DataFrame, intents: Sequence[str]) -> DataFrame:
    """queries(conv_id, turn, intent, confidence): queries, mean confidence, length and intent counts."""
    return queries.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("total_queries"), F.round(F.avg("confidence"), 3).alias("average_confidence"),
        (F.max("turn") - F.min("turn")).alias("duration"),
        *[F.count_if(F.col("intent") == i).alias(i) for i in intents],
    )


def message_flow(turns: DataFrame, slice_turns: int = 1024) -> DataFrame:
    """Messages by role and by ``from->to`` pair of successive turns, and the number of conversations."""
    flow = with_previous(turns.select("conv_id", "turn", "role"), ["conv_id"], "turn", {"sender": "role"}, slice_turns)
    pair = F.when(F.col("sender").isNotNull(), F.concat_ws("->", "sender", "role"))
    cells = F.array(
        F.struct(F.lit("type").alias("dimension"), F.col("role").alias("key")), F.struct(F.lit("pair").alias("dimension"), pair.alias("key")))
    counted = flow.select(F.explode(cells).alias("d")).where("d.key IS NOT NULL").groupBy("d.dimension", "d.key").agg(
        F.count(F.lit(1)).alias("messages"))
    talks = turns.select("conv_id").distinct().agg(F.count(F.lit(1)).alias("messages")).select(
        F.lit("correlations").alias("dimension"), F.lit("all").alias("key"), "messages")
    return counted.unionByName(talks)


def completeness(actual: Column, expected: Column) -> Column:
    """Share of expected rows in percent, at most 100."""
    return F.when(actual == 0, 0.0).otherwise(F.least(F.lit(100.0), actual / F.greatest(expected, F.lit(1)) * 100))


def reliability(rows: Column, limitations: Column) -> Column:
    """Rating of a partial result from its row count and limitation texts."""
    def penalty(text: Column) -> Column:
        chain = None
        for word, cost in PENALTIES.items():
            found = F.contains(F.lower(text), F.lit(word))
            chain = F.when(found, cost) if chain is None else chain.when(found, cost)
        return chain.otherwise(0.0)

    costs = F.aggregate(limitations, F.lit(0.0), lambda total, text: total + penalty(text))
    base = F.when(rows == 0, 0.1).otherwise(RELIABLE - costs - F.when(rows < FEW_ROWS, 0.1).otherwise(0.0))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), base))


def partial_results(parts: DataFrame) -> DataFrame:
    """parts(part, actual, expected, limitations) with completeness and reliability."""
    return parts.withColumns({
        "completeness": completeness(F.col("actual"), F.col("expected")),
        "reliability": reliability(F.col("actual"), F.col("limitations")),
    })


def sessions(events: DataFrame, key: str, gap_seconds: int, slice_seconds: int) -> DataFrame:
    """Activity sessions per key: a new one starts after more than ``gap_seconds`` without a row."""
    marked = session_starts(events, [key], gap_seconds, slice_seconds)
    return marked.groupBy(key, "session_start").agg(
        F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("events"))


def session_starts(events: DataFrame, keys: Sequence[str], gap_seconds: int, slice_seconds: int) -> DataFrame:
    """Add ``session_start`` to every row; works on slices, so a busy key is spread over tasks."""
    seen = with_previous(events, keys, "ts", {"__before": "ts"}, slice_seconds, ["event_id"])
    opens = F.col("__before").isNull() | (epoch_seconds("ts") - epoch_seconds("__before") >= gap_seconds)
    opened = seen.withColumn("__open", F.when(opens, F.col("ts"))).drop("__before")
    return with_running_max(opened, keys, "ts", "__open", "session_start", slice_seconds, ["event_id"]).drop("__open")


def limit_decisions(times: Sequence[float], limit: int, window: float) -> list[bool]:
    """Allow a request while fewer than ``limit`` allowed ones lie in the last ``window`` seconds."""
    recent: list[float] = []
    decided = []
    for now in times:
        recent = [t for t in recent if now - t < window]
        decided.append(len(recent) < limit)
        if decided[-1]:
            recent.append(now)
    return decided


def rate_limit(events: DataFrame, keys: Sequence[str], endpoint: str = "default", parts: int | None = None) -> DataFrame:
    """Allow or deny each request of a key by the limit of the endpoint."""
    limit, window = RATE_LIMITS.get(endpoint, RATE_LIMITS["default"])
    return limiter.rate_limit(events, keys, limit, window, parts=parts)


def daily_completeness(events: DataFrame, expected_share: float = 1.0) -> DataFrame:
    """Actual rows per day against the mean day, as parts of a partial result."""
    per_day = events.groupBy(day_key("ts").alias("part")).agg(F.count(F.lit(1)).alias("actual"))
    mean = per_day.agg(F.avg("actual") * expected_share).scalar()
    return per_day.withColumn("expected", mean)

