"""Queries over the catalog, activity logs, versions, duplicates and the audit chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions.lineage import settled
from tabularium.functions.text import words
from tabularium.functions.time import day_key, ntz
from tabularium.operators import access, activity, audit_tree, labels, relational as rel, versions
from tabularium.operators.profiling import type_name
from tabularium.functions.ordered import with_previous
from tabularium.plans.documents import INTENTS, WS
from tabularium.plans.registry import query
from tabularium.sources import catalog as cat

HASH = "md5(doc_id::VARCHAR)"
UUID_SQL = (f"{HASH}[1:8] || '-' || {HASH}[9:12] || '-4' || {HASH}[14:16] || '-a' || {HASH}[18:20] || '-' || {HASH}[21:32]")
CATALOG = f"""(SELECT doc_id, {UUID_SQL} AS resource_id, 'client-' || lang AS client_id, source AS user_id, resource_type,
  data_type, source || ' report_' || doc_id || '.' || data_type AS original_filename, n_chars AS file_size_bytes,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id * 10) AS created_at, 1 AS version, coalesce(toxic = 1, false) AS is_deleted,
  CASE WHEN resource_type = 'structured' THEN n_chars END AS row_count,
  CASE WHEN resource_type = 'structured' THEN length(source) END AS column_count,
  CASE WHEN resource_type = 'unstructured' THEN n_chars // 500 END AS chunk_count, sha256(text) AS file_hash
FROM (SELECT *, CASE WHEN n_chars < 400 THEN 'json' WHEN n_chars < 1500 THEN 'structured' ELSE 'unstructured' END AS resource_type,
  CASE WHEN n_chars < 400 THEN 'json' WHEN n_chars < 1500 THEN 'csv' ELSE 'txt' END AS data_type FROM documents)
LEFT JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id))"""


def catalog(t):
    return cat.catalog_of_documents(t.documents, t.labels)


@query("list_resources", "S11", f"""
SELECT resource_id, original_filename, file_size_bytes, created_at::VARCHAR AS created_at FROM {CATALOG}
WHERE client_id = 'client-en' AND user_id = 'src1' AND NOT is_deleted""")
def _(t):
    found = cat.list_resources(catalog(t), "client-en", "src1")
    return found.select("resource_id", "original_filename", "file_size_bytes", F.col("created_at").cast("string"))


@query("resource_rows", "S12", f"""
SELECT {UUID_SQL} AS resource_id, source, text FROM documents WHERE doc_id = 7""")
def _(t):
    data = t.documents.select(cat.resource_uuid(F.col("doc_id")).alias("resource_id"), "source", "text")
    return cat.resource_rows(catalog(t).drop("text"), data, "8f14e45f-ceea-467a-aa36-dedd4bea2543")


@query("accessible_resources", "P4", f"""
SELECT resource_id FROM {CATALOG} WHERE client_id = 'client-fr'""")
def _(t):
    return access.accessible_resources(catalog(t), "src1", "client-fr", "manager").select("resource_id")


@query("invalid_records", "P14", f"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN bad_id THEN 'resource_id' END, CASE WHEN bad_user THEN 'user_id' END,
  CASE WHEN bad_version THEN 'version' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT doc_id, doc_id < 40 AS bad_id, lang = 'de' AS bad_user, n_chars < 100 AS bad_version FROM documents)
WHERE bad_id OR bad_user OR bad_version""")
def _(t):
    records = t.documents.select(
        "doc_id", F.when(F.col("doc_id") < 40, "not-a-uuid").otherwise(cat.resource_uuid(F.col("doc_id"))).alias("resource_id"),
        F.lit("acme").alias("client_id"), F.when(F.col("lang") == "de", "bad user!").otherwise(F.col("source")).alias("user_id"),
        F.col("n_chars").alias("file_size_bytes"), F.when(F.col("n_chars") < 100, 0).otherwise(1).alias("version"))
    checked = access.reject_reasons(records).where(F.size("reasons") > 0)
    return checked.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("catalog_statistics", "A10", f"""
SELECT dimension, key, count(*) AS resources, sum(file_size_bytes)::BIGINT AS total_bytes,
  coalesce(sum(row_count), 0)::BIGINT AS total_rows, coalesce(sum(chunk_count), 0)::BIGINT AS total_chunks,
  count(*) FILTER (is_deleted) AS deleted
FROM (SELECT 'total' AS dimension, 'all' AS key, * FROM {CATALOG} UNION ALL SELECT 'resource_type', resource_type, * FROM {CATALOG}
  UNION ALL SELECT 'data_type', data_type, * FROM {CATALOG}) GROUP BY dimension, key""")
def _(t):
    return cat.catalog_statistics(catalog(t))


AS_OF = "2024-01-06 12:00:00"


@query("storage_statistics", "A11", f"""
SELECT client_id, count(*) AS total_resources, count(*) FILTER (resource_type = 'structured') AS structured,
  count(*) FILTER (resource_type = 'json') AS json, count(*) FILTER (resource_type = 'unstructured') AS unstructured,
  sum(file_size_bytes)::BIGINT AS total_bytes,
  count(*) FILTER (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at) < 7 * 86400000000) AS recent_uploads
FROM {CATALOG} WHERE NOT is_deleted GROUP BY client_id""")
def _(t):
    return cat.storage_statistics(catalog(t), ntz(AS_OF))


@query("summary_synthesis", "A22", f"""
SELECT count(*) AS total_resources, count(*) FILTER (resource_type = 'structured') AS structured,
  count(*) FILTER (resource_type = 'unstructured') AS unstructured, count(*) FILTER (resource_type = 'json') AS json,
  coalesce(sum(row_count), 0)::BIGINT AS total_rows, round(sum(file_size_bytes) / 1048576, 2) AS total_mb,
  min(created_at)::VARCHAR AS earliest, max(created_at)::VARCHAR AS latest FROM {CATALOG}""")
def _(t):
    return cat.summary_synthesis(catalog(t))


QUESTIONS = ["total statistics of src1 report_12 data", "document text content of src7"]


def _rank_sql(scorer: str) -> str:
    name_words = r"regexp_extract_all(lower(original_filename), '([\p{L}\p{N}_]+)', 1)"
    parts = []
    for i, q in enumerate(QUESTIONS):
        asked = "[" + ", ".join(f"'{w}'" for w in sorted(set(q.lower().split()))) + "]"
        overlap = f"len(list_intersect(list_distinct({name_words}), {asked}))"
        days = f"floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400000000)"
        large = "(coalesce(row_count > 100, false) OR coalesce(chunk_count > 10, false))"
        if scorer == "analysis":
            score = (f"CASE WHEN {' OR '.join(f'''contains(lower(original_filename), '{w}')''' for w in q.lower().split())} "
                     "THEN 0.3 ELSE 0 END + CASE WHEN row_count > 1000 THEN 0.3 WHEN row_count > 100 THEN 0.2 "
                     "WHEN row_count > 10 THEN 0.1 ELSE 0 END + CASE WHEN column_count > 10 THEN 0.2 WHEN column_count > 5 "
                     f"THEN 0.1 ELSE 0 END + CASE WHEN {days} < 7 THEN 0.2 WHEN {days} < 30 THEN 0.1 ELSE 0 END")
            keep, where = 5, "resource_type = 'structured'"
        elif scorer == "analyst":
            kind = "structured" if i == 0 else "unstructured"
            score = (f"{overlap} / greatest(len({name_words}), 1) * 0.4 + CASE WHEN resource_type = '{kind}' THEN 0.3 ELSE 0 END "
                     f"+ CASE WHEN {days} < 30 THEN 0.1 ELSE 0 END + CASE WHEN {large} THEN 0.1 ELSE 0 END")
            keep, where = 10, "true"
        elif scorer == "planning":
            score = (f"{overlap} / greatest(len(list_distinct({name_words})), 1) * 0.3 + CASE WHEN {days} < 7 THEN 0.1 "
                     f"WHEN {days} < 30 THEN 0.05 ELSE 0 END + CASE WHEN coalesce(row_count > 0, false) "
                     "OR coalesce(chunk_count > 0, false) THEN 0.1 ELSE 0 END")
            keep, where = 10, "true"
        else:
            score = (f"greatest({overlap} / greatest(len(list_distinct({name_words})), 1) * 0.5 + CASE WHEN {days} < 7 THEN 0.2 "
                     f"WHEN {days} < 30 THEN 0.1 ELSE 0 END + CASE WHEN {large} THEN 0.1 ELSE 0 END, 0.1)")
            keep, where = 1_000_000_000, "true"
        bound = ">= 0.1" if scorer == "analyst" else "> 0.1" if scorer != "context" else ">= 0"
        parts.append(f"""SELECT {i} AS question, resource_id, score FROM (SELECT resource_id,
  round(least({score}, 1.0), 6)::DOUBLE AS score FROM {CATALOG} WHERE {where}) WHERE score {bound}
  QUALIFY row_number() OVER (ORDER BY score DESC, resource_id) <= {keep}""")
    return " UNION ALL ".join(f"({p})" for p in parts)


def _rank(scorer):
    return lambda t: cat.rank_resources(catalog(t), QUESTIONS, scorer, ntz(AS_OF))


for _scorer in ("analysis", "analyst", "planning", "context"):
    query(f"resource_ranking_{_scorer}", "H13", _rank_sql(_scorer))(_rank(_scorer))


# ---- activity ----------------------------------------------------------------------------------

SEVERITY = "CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END"
EVENTS_END = "2024-01-30 12:00:00"


def audit_log(t):
    return t.events.select(
        "event_id", "ts", F.col("user_id").cast("string").alias("user_id"), "event_type",
        F.expr(SEVERITY).alias("severity"), F.concat(F.lit("client-"), F.col("user_id") % 3).alias("client_id"))


@query("audit_statistics", "A13", f"""
WITH e AS (SELECT *, {SEVERITY} AS severity, 'client-' || (user_id % 3) AS client FROM events
  WHERE ts::DATE >= DATE '2024-01-24' AND ts <= TIMESTAMP '{EVENTS_END}')
SELECT 'type' AS dimension, event_type AS key, count(*) AS events FROM e GROUP BY ALL
UNION ALL SELECT 'severity', severity, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'user', client || ':' || user_id, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'client', client, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM e GROUP BY ALL""")
def _(t):
    dimensions = {"type": F.col("event_type"), "severity": F.col("severity"),
                  "user": F.concat_ws(":", "client_id", "user_id"), "client": F.col("client_id"), "day": day_key("ts")}
    return activity.audit_statistics(audit_log(t), ntz(EVENTS_END), 7, dimensions)


@query("audit_summary", "A14", """
SELECT user_id, count(*) AS total_operations, min(ts)::VARCHAR AS first_operation, max(ts)::VARCHAR AS last_operation,
  count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error,
  count(*) FILTER (event_type = 'purchase') AS n_purchase, count(DISTINCT floor(value)::BIGINT) AS total_versions
FROM events GROUP BY user_id""")
def _(t):
    log = t.events.withColumn("version_after", F.floor("value"))
    summary = activity.audit_summary(log, "user_id", "event_type", ["click", "error", "purchase"], "version_after")
    return summary.withColumns({c: F.col(c).cast("string") for c in ("first_operation", "last_operation")})


@query("operations_by_user", "A14", """
SELECT event_type, user_id, count(*) AS operations FROM events GROUP BY ALL""")
def _(t):
    return activity.operations_by_user(t.events, "event_type", "user_id")


@query("user_statistics", "A15", """
WITH u AS (SELECT c_custkey, c_mktsegment AS level, c_acctbal >= 0 AS active, max(o_orderdate) AS last_login
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT 'total_users' AS item, count(*) AS n FROM u UNION ALL SELECT 'active_users', count(*) FILTER (active) FROM u
UNION ALL SELECT 'inactive_users', count(*) FILTER (NOT active) FROM u
UNION ALL SELECT 'recent_logins', count(*) FILTER (last_login > TIMESTAMP '2001-06-01' - INTERVAL 30 DAY) FROM u
UNION ALL SELECT 'level_' || level, count(*) FROM u WHERE active GROUP BY level""")
def _(t):
    logins = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_login"))
    users = t.customer.join(logins, F.expr("c_custkey = o_custkey"), "left").select(
        F.col("c_mktsegment").alias("access_level"), (F.col("c_acctbal") >= 0).alias("is_active"), "last_login")
    return activity.user_statistics(users, ntz("2001-06-01 00:00:00"))


STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'uploading' END"


def progress_events(t):
    return t.events.select(
        "user_id", "ts", "event_id", F.expr(STATUS).alias("status"), F.lit(500.0).alias("total_bytes"),
        F.when(F.col("event_type") == "purchase", 500.0).otherwise(F.least("value", F.lit(500.0))).alias("uploaded_bytes"))


LATEST = f"""(SELECT user_id, {STATUS} AS status, 500.0 AS total_bytes,
  CASE WHEN event_type = 'purchase' THEN 500.0 ELSE least(value, 500.0) END AS uploaded_bytes FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


@query("upload_statistics", "A16, W2", f"""
SELECT count(*) AS total_uploads, count(*) FILTER (status = 'uploading') AS active_uploads,
  count(*) FILTER (status = 'completed') AS completed_uploads, count(*) FILTER (status = 'failed') AS failed_uploads,
  round(sum(total_bytes), 4)::DOUBLE AS total_bytes, round(sum(uploaded_bytes), 4) AS uploaded_bytes,
  round(sum(uploaded_bytes) / sum(total_bytes) * 100, 6) AS overall_percent FROM {LATEST}""")
def _(t):
    stats = activity.upload_statistics(progress_events(t), "user_id")
    return stats.withColumns({"uploaded_bytes": F.round("uploaded_bytes", 4), "overall_percent": F.round("overall_percent", 6)})


KIND = "CASE event_type WHEN 'click' THEN 'query' WHEN 'purchase' THEN 'response' ELSE event_type END"


@query("agent_performance", "A17", f"""
SELECT user_id, count(*) AS activities, count(*) FILTER (k = 'query') AS queries, count(*) FILTER (k = 'response') AS responses,
  count(*) FILTER (k = 'error') AS errors, round(CASE WHEN count(*) FILTER (k IN ('response', 'error')) > 0
    THEN count(*) FILTER (k = 'response') / count(*) FILTER (k IN ('response', 'error')) ELSE 1 END, 6) AS success_rate,
  round(coalesce(avg(value) FILTER (k = 'response'), 0), 6) AS mean_ms,
  coalesce(sum(length(props)) FILTER (k = 'response'), 0)::BIGINT AS tokens
FROM (SELECT *, {KIND} AS k FROM events WHERE ts >= TIMESTAMP '{EVENTS_END}' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '{EVENTS_END}')
GROUP BY user_id""")
def _(t):
    acts = t.events.select("user_id", "ts", F.expr(KIND).alias("activity_type"), F.col("value").alias("execution_ms"),
                           F.length("props").alias("tokens"))
    measured = activity.agent_performance(acts, ntz(EVENTS_END), 48, ["user_id"])
    return measured.withColumns({c: F.round(c, 6) for c in ("success_rate", "mean_ms")})


@query("conversation_metrics", "A18", """
SELECT conv_id, count(*) AS total_queries, sum(length(text) // 4)::BIGINT AS total_tokens, sum(length(text))::BIGINT AS total_ms,
  min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT role) AS n_agents,
  array_to_string(list_sort(list(DISTINCT role)), ',') AS agents FROM conversations GROUP BY conv_id""")
def _(t):
    turns = t.conversations.select("conv_id", "turn", F.col("role").alias("agent"),
                                   F.floor(F.length("text") / 4).alias("tokens"), F.length("text").alias("ms"))
    return activity.conversation_metrics(turns)


@query("interface_statistics", "A19", f"""
WITH r AS (SELECT user_id, ts, event_type, value FROM events),
c AS (SELECT user_id, (epoch_us(TIMESTAMP '{EVENTS_END}') - epoch_us(min(ts))) / 3600000000 AS hours FROM r GROUP BY user_id)
SELECT 'queries' AS item, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'references', count(event_type) FROM r
UNION ALL SELECT 'mean ms', round(avg(value), 6) FROM r UNION ALL SELECT 'conversations', count(*) FROM c
UNION ALL SELECT 'unique resources', count(DISTINCT event_type) FROM r
UNION ALL SELECT 'intent ' || event_type, count(*) FROM r GROUP BY event_type
UNION ALL SELECT CASE WHEN hours < 1 THEN 'age < 1 hour' WHEN hours < 6 THEN 'age 1-6 hours' WHEN hours < 24
  THEN 'age 6-24 hours' ELSE 'age > 24 hours' END, count(*) FROM c GROUP BY 1""")
def _(t):
    requests = t.events.select(
        F.col("user_id").alias("conversation"), "ts", F.col("event_type").alias("intent"),
        F.col("event_type").alias("resource"), F.col("value").alias("ms"))
    return activity.interface_statistics(requests, ntz(EVENTS_END)).withColumn("value", F.round("value", 6))


@query("conversation_analytics", "A20", f"""
SELECT conv_id, count(*) AS total_queries, round(avg(confidence), 3) AS average_confidence, max(turn) - min(turn) AS duration,
  {", ".join(f"count(*) FILTER (intent = '{i}') AS {i}" for i in labels.INTENT_PATTERNS)} FROM {INTENTS} GROUP BY conv_id""")
def _(t):
    labelled = labels.with_intent(labels.user_queries(t.conversations), "text", F.col("has_history"))
    return activity.conversation_analytics(labelled, list(labels.INTENT_PATTERNS))


@query("message_flow", "A21", """
WITH f AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS sender FROM conversations)
SELECT 'type' AS dimension, role AS key, count(*) AS messages FROM f GROUP BY role
UNION ALL SELECT 'pair', sender || '->' || role, count(*) FROM f WHERE sender IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'correlations', 'all', count(DISTINCT conv_id) FROM f""")
def _(t):
    return activity.message_flow(t.conversations)


@query("partial_results", "A24", """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS part, count(*) AS actual, count(*) FILTER (event_type = 'error') AS errors
  FROM events GROUP BY 1), m AS (SELECT *, avg(actual) OVER () AS expected FROM d)
SELECT part, actual, round(least(100.0, actual / greatest(expected, 1) * 100), 6) AS completeness,
  round(greatest(0.1, least(1.0, 0.8 - CASE WHEN actual < expected THEN 0.2 ELSE 0 END
    - CASE WHEN errors > 16 THEN 0.3 ELSE 0 END - CASE WHEN actual < 10 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS reliability FROM m""")
def _(t):
    days = activity.daily_completeness(t.events)
    errors = t.events.groupBy(day_key("ts").alias("part")).agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    limits = F.array_compact(F.array(F.when(F.col("actual") < F.col("expected"), "Incomplete day"),
                                     F.when(F.col("errors") > 16, "error rows")))
    rated = activity.partial_results(days.join(errors, "part").withColumn("limitations", limits))
    return rated.select("part", "actual", F.round("completeness", 6).alias("completeness"),
                        F.round("reliability", 6).alias("reliability"))


@query("compare_with_previous_result", "W6", rf"""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '{WS}+'), lambda x: x <> '')) AS s,
  confidence FROM {INTENTS}),
l AS (SELECT *, lag(s) OVER p AS ps, lag(confidence) OVER p AS pc FROM w WINDOW p AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, len(s) AS current_count, len(ps) AS previous_count, round(confidence - pc, 6) AS improvement,
  len(list_intersect(s, ps)) AS common_sources, len(s) - len(list_intersect(s, ps)) AS new_sources FROM l WHERE ps IS NOT NULL""")
def _(t):
    results = labels.with_intent(labels.user_queries(t.conversations), "text", F.col("has_history")).select(
        "conv_id", "turn", "confidence", F.array_distinct(words(F.lower("text"))).alias("sources"))
    paired = with_previous(results, ["conv_id"], "turn", {"before": "sources", "sure": "confidence"}, 1024)
    return paired.where("before IS NOT NULL").select(
        "conv_id", "turn", F.size("sources").alias("current_count"), F.size("before").alias("previous_count"),
        F.round(F.col("confidence") - F.col("sure"), 6).alias("improvement"),
        F.size(F.array_intersect("sources", "before")).alias("common_sources"),
        F.size(F.array_except("sources", "before")).alias("new_sources"))


@query("idle_sessions", "ST5", """
SELECT user_id, min(ts)::VARCHAR AS session_start, max(ts)::VARCHAR AS session_end, count(*) AS events FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000
      THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, s""")
def _(t):
    found = activity.sessions(t.events.select("user_id", "ts", "event_id"), "user_id", 3600, 86_400)
    return found.withColumns({c: F.col(c).cast("string") for c in ("session_start", "session_end")})


RATE_LIMIT_SQL = """
WITH RECURSIVE e AS (SELECT event_type, event_id, epoch(ts) AS secs, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_type, event_id, n, true AS allowed, [secs] AS recent FROM e WHERE n = 1
  UNION ALL SELECT event_type, event_id, n, len(kept) < 5, CASE WHEN len(kept) < 5 THEN list_append(kept, secs) ELSE kept END FROM (
    SELECT e.event_type, e.event_id, e.n, e.secs, list_filter(r.recent, lambda x: e.secs - x < 60) AS kept
    FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1))
SELECT event_type, event_id, allowed FROM r"""


@query("rate_limit_decisions", "ST4", RATE_LIMIT_SQL)
def _(t):
    calls = t.events.select("event_type", "ts", "event_id")
    return activity.rate_limit(calls, ["event_type"], "streaming")


# ---- versions ----------------------------------------------------------------------------------

def order_versions(t):
    return t.orders.select(F.col("o_custkey").alias("resource"), F.col("o_orderkey").alias("version"), "o_totalprice")


@query("create_versions", "V1", """
SELECT c_custkey AS resource, CASE WHEN max(o_orderkey) IS NULL THEN 'create' ELSE 'update' END AS operation,
  max(o_orderkey) AS version_before, coalesce(max(o_orderkey), 0) + 1 AS version_after, c_name AS user_id
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY c_custkey, c_name""")
def _(t):
    incoming = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("resource"), "c_name")
    created = versions.create_versions(order_versions(t), incoming, "resource", F.col("c_name"), ntz(AS_OF))
    return created.drop("ts")


@query("version_history", "V2", """
SELECT o_orderkey AS version, o_totalprice FROM orders WHERE o_custkey = 42 ORDER BY version DESC""")
def _(t):
    return versions.version_history(order_versions(t), "resource", 42).drop("resource")


@query("read_as_of_version", "V2", """
SELECT o_custkey AS resource, o_orderkey AS version, o_totalprice FROM orders WHERE o_orderkey <= 700
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def _(t):
    return versions.read_as_of(order_versions(t), "resource", 700)


@query("roll_back_version", "V3", """
SELECT o.o_custkey AS resource, m.newest + 1 AS version, o.o_totalprice FROM orders o JOIN (
  SELECT o_custkey, min(o_orderkey) AS target, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey) m
ON o.o_custkey = m.o_custkey AND o.o_orderkey = m.target""")
def _(t):
    targets = order_versions(t).groupBy("resource").agg(F.min("version").alias("target"))
    return versions.roll_back(order_versions(t), "resource", targets)


@query("deletion_state", "V4", """
SELECT user_id, arg_max(event_type = 'error', {'ts': ts, 'id': event_id}) AS is_deleted FROM events
WHERE event_type IN ('error', 'signup') GROUP BY user_id""")
def _(t):
    flags = t.events.where("event_type IN ('error', 'signup')").select(
        "user_id", "ts", "event_id", (F.col("event_type") == "error").alias("is_deleted"))
    return versions.deletion_state(flags, "user_id")


@query("hard_delete", "V5", """
SELECT o_custkey AS resource, o_orderkey AS version, o_totalprice FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(t):
    removed = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("resource"))
    return versions.hard_delete(order_versions(t), removed, "resource")


@query("versions_to_prune", "W4, V6", """
SELECT o_custkey AS resource, o_orderkey AS version FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 3""")
def _(t):
    return versions.prune_versions(order_versions(t), "resource", 3).select("resource", "version")


@query("expired_audit_rows", "V6", f"""
SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '{EVENTS_END}' - INTERVAL 20 DAY""")
def _(t):
    return versions.older_than(t.events, "ts", ntz(EVENTS_END), 20).select("event_id", "user_id")


@query("expired_soft_deletes", "V6", f"""
SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type = 'error', {{'ts': ts, 'id': event_id}})
  AND max(ts) < TIMESTAMP '{EVENTS_END}' - INTERVAL 6 HOUR""")
def _(t):
    state = activity.latest_state(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id")
    return versions.older_than(state.where("event_type = 'error'"), "ts", ntz("2024-01-30 06:00:00"), 0).select("user_id")


@query("audit_trail", "V7, L4", """
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""")
def _(t):
    return versions.audit_trail(t.events, ["user_id"], 10).select("user_id", "event_id", "event_type")


@query("content_duplicates", "V8", """
SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER p AS kept, count(*) OVER p AS copies FROM documents
WINDOW p AS (PARTITION BY sha256(text)) QUALIFY count(*) OVER p > 1""")
def _(t):
    return versions.content_duplicates(t.documents, "doc_id", "text")


@query("integrity_check", "V9", """
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'changed' ELSE 'ok' END AS status
FROM documents LEFT JOIN labels l USING (doc_id)""")
def _(t):
    stored = F.when(F.col("toxic") == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    manifest = t.documents.join(t.labels, "doc_id").select("doc_id", stored.alias("stored_hash"))
    return versions.integrity_check(manifest, t.documents, "doc_id", "text")


@query("audit_chain", "V10", """
WITH p AS (SELECT event_id, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) - 1 AS place FROM events),
s AS (SELECT *, max((event_id % 103 = 9)::INT) OVER w * (count(*) OVER w - 1) = 1 AS swapped FROM p WINDOW w AS (PARTITION BY h, place // 2)),
c AS (SELECT *, CASE WHEN event_id % 101 = 7 THEN 'removed' WHEN event_id % 97 = 5 THEN 'changed' WHEN swapped THEN 'moved' ELSE 'verified' END AS status FROM s),
hours AS (SELECT h, count(*) FILTER (status <> 'verified') = 0 AS intact FROM c GROUP BY h)
SELECT strftime(c.h, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'changed') AS changed,
  count(*) FILTER (status = 'moved') AS moved, count(*) FILTER (status = 'removed') AS removed, 0 AS added,
  count(DISTINCT c.h) FILTER (intact) AS intact_hours, count(DISTINCT c.h) AS hours
FROM c JOIN hours USING (h) GROUP BY 1""")
def _(t):
    # the log as sealed, and as found: values changed, rows removed, neighbours exchanged
    sealed = settled(audit_tree.leaves(t.events, "event_id"))
    found = t.events.withColumn("value", F.when(F.col("event_id") % 97 == 5, F.col("value") + 1).otherwise(F.col("value")))
    hashes = found.select(F.col("event_id").alias("id"), F.sha2(audit_tree.canonical_json(found.columns), 256).alias("leaf"))
    current = audit_tree.swapped_pairs(sealed.drop("leaf"), F.col("id") % 103 == 9).join(hashes, "id").where("id % 101 <> 7")
    hours = audit_tree.segment_report(sealed, settled(current))
    counts = [F.sum(c).alias(c) for c in ("total", "verified", "changed", "moved", "removed", "added")]
    return hours.groupBy(F.date_format("segment", "yyyy-MM-dd").alias("day")).agg(
        *counts, F.count_if("intact").alias("intact_hours"), F.count(F.lit(1)).alias("hours"))


@query("audit_proofs", "V10", """
SELECT event_id AS id, true AS included, date_trunc('hour', ts)::VARCHAR AS segment FROM events WHERE event_type = 'error' AND event_id % 50 = 3""")
def _(t):
    placed = settled(audit_tree.leaves(t.events, "event_id"))
    nodes = audit_tree.tree(placed)
    wanted = t.events.where("event_type = 'error' AND event_id % 50 = 3").select(F.col("event_id").alias("id"))
    proofs = audit_tree.inclusion_proofs(placed, nodes, wanted)
    sealed = audit_tree.chained(audit_tree.roots(nodes)).select(F.col("segment").alias("__segment"), "root")
    checked = proofs.join(sealed, F.col("segment").eqNullSafe(F.col("__segment")))
    return checked.select("id", (audit_tree.folded_root(F.col("leaf"), F.col("steps")) == F.col("root")).alias("included"), F.col("segment").cast("string").alias("segment"))


LINEAGE_TABLES = {"customer": "c_", "orders": "o_", "supplier": "s_"}
SHARED_FIELDS = {"custkey": ["customer", "orders"], "nationkey": ["customer", "supplier"], "name": ["customer", "supplier"], "acctbal": ["customer", "supplier"]}


@query("field_lineage", "V11", " UNION ALL ".join(
    f"SELECT '{field}' AS unified_field, '{table}.parquet.{LINEAGE_TABLES[table]}{field}' AS origin, count({LINEAGE_TABLES[table]}{field}) AS known, "
    f"count(DISTINCT {LINEAGE_TABLES[table]}{field}) AS distinct_values FROM {table}" for field, tables in SHARED_FIELDS.items() for table in tables))
def _(t):
    tables = {name: getattr(t, name) for name in LINEAGE_TABLES}
    rows = [(f.name.split("_", 1)[1], name, f.name, type_name(f.dataType)) for name, df in tables.items() for f in df.schema.fields]
    fields = t.spark.createDataFrame(rows, "unified_field string, resource_id string, source_field string, type string")
    files = t.spark.createDataFrame([(n, f"{n}.parquet") for n in tables], "resource_id string, original_filename string")
    shared = fields.groupBy("unified_field").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unified_field")
    mapped = rel.keep_matching(fields.alias("f"), shared.alias("s"), "f.unified_field = s.unified_field")
    return versions.field_lineage(mapped, files, tables)
