"""Queries over file sources, sinks, stores and streams; files are written to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.functions.time import ntz
from tabularium.operators import access, activity, chunking, cleaning
from tabularium.plans.governance import EVENTS_END, KIND, SEVERITY, STATUS, audit_log, progress_events
from tabularium.plans.governance import RATE_LIMIT_SQL
from tabularium.plans.registry import query
from tabularium.plans.tabular import messy_customers
from tabularium.session import new_scratch
from tabularium.sources import files, stores
from tabularium.streaming import streams


def exported(t, df, kind, label):
    path = new_scratch(t.spark, label)
    files.export_table(df, path, kind)
    return path


@query("csv_round_trip", "S1, S15", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def _(t):
    path = exported(t, t.customer, "csv", "csv")
    return files.read_table(t.spark, path, "csv", view="customer_csv")


@query("tsv_scan", "S2", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    path = new_scratch(t.spark, "tsv")
    t.supplier.write.csv(path, header=True, sep="\t")
    return files.read_table(t.spark, path, "tsv", t.supplier.schema)


@query("parquet_scan", "S3, S15", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(t):
    path = exported(t, t.part, "parquet", "parquet")
    return files.read_table(t.spark, path, "parquet").select("p_partkey", "p_name", "p_retailprice")


@query("json_document_scan", "S4", """
SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events""")
def _(t):
    # Every file holds one JSON array of at most 500 documents, as an upload would.
    path = new_scratch(t.spark, "json")
    records = t.events.select(
        F.floor(F.col("event_id") / 500).alias("batch"), F.to_json(F.struct("event_id", "event_type", "props")).alias("r"))
    arrays = records.groupBy("batch").agg(
        F.concat(F.lit("["), F.listagg("r", F.lit(",\n")), F.lit("]")).alias("value"))
    arrays.write.partitionBy("batch").text(path)
    schema = T.StructType().add("event_id", "long").add("event_type", "string").add("props", "string")
    read = files.read_table(t.spark, path, "json", schema)
    return read.select("event_id", "event_type", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query("jsonl_scan", "S5, S15", "SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    path = exported(t, t.events.drop("ts"), "json", "jsonl")
    return files.read_table(t.spark, path, "jsonl").select("event_id", "user_id", "event_type", "value")


@query("text_documents", "S6, C17", """
SELECT doc_id // 50 AS batch, count(*) * 0 + 1 AS files, sum(length(text) + 1)::BIGINT AS characters FROM documents GROUP BY 1""")
def _(t):
    # One text file per 50 documents; each file is read back whole.
    path = new_scratch(t.spark, "text")
    lines = t.documents.select(F.floor(F.col("doc_id") / 50).alias("batch"), F.col("text").alias("value"))
    lines.repartition("batch").write.partitionBy("batch").text(path)
    read = files.read_documents(t.spark, f"{path}/*")
    batch = F.regexp_extract("path", r"batch=(\d+)/", 1).cast("long")
    return read.groupBy(batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("characters"))


@query("html_text", "S7")
def _(t):
    return t.spread("pages").select("page_id", "url", files.html_text("html").alias("text"))


@query("bulk_ingest", "S9", """
SELECT o_orderstatus, count(*) AS good_rows, count(*) FILTER (o_orderkey % 1000 = 0) AS rejected FROM orders GROUP BY 1""")
def _(t):
    path = new_scratch(t.spark, "bulk")
    lines = t.orders.select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice")
    broken = lines.where("o_orderkey % 1000 = 0").select(
        "o_orderstatus", F.lit("not a number").alias("o_orderkey"), F.col("o_custkey").cast("string"), F.lit("?").alias("o_totalprice"))
    lines.select(*[F.col(c).cast("string") for c in lines.columns]).unionByName(broken).write.partitionBy(
        "o_orderstatus").csv(path, header=True)
    schema = T.StructType().add("o_orderkey", "long").add("o_custkey", "long").add("o_totalprice", "double")
    folders = [f"{path}/o_orderstatus={s}" for s in ("F", "O", "P")]
    good, bad = files.read_many(t.spark, folders, schema, file_pattern=r"o_orderstatus=([^/]+)/")
    rows = good.groupBy(F.col("source_file").alias("o_orderstatus")).agg(F.count(F.lit(1)).alias("good_rows"))
    rejects = bad.groupBy(F.col("source_file").alias("o_orderstatus")).agg(F.count(F.lit(1)).alias("rejected"))
    return rows.join(rejects, "o_orderstatus", "left").na.fill(0, ["rejected"])


@query("file_manifest", "S10")
def _(t):
    manifest = files.file_manifest(t.spark, t.folder)
    return manifest.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size_bytes", "data_type", "resource_type", "status")


@query("storage_by_area", "A12")
def _(t):
    return files.storage_by_area(t.spark, t.folder)


@query("document_upsert", "S13", f"""
SELECT user_id, version, value FROM (
  SELECT user_id, 1 AS version, 0.0 AS value, 0 AS new, 0 AS event_id FROM events GROUP BY user_id
  UNION ALL SELECT user_id, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END, value, 1, event_id FROM events
  WHERE event_type IN ('purchase', 'signup'))
QUALIFY row_number() OVER (PARTITION BY user_id, version ORDER BY new DESC, event_id DESC) = 1""")
def _(t):
    current = t.events.groupBy("user_id").agg(F.lit(0.0).alias("value")).select("user_id", F.lit(1).alias("version"), "value")
    incoming = t.events.where("event_type IN ('purchase', 'signup')").select(
        "user_id", F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("version"), "value", "event_id")
    merged = stores.upsert_documents(current, incoming, ["user_id", "version"], F.col("event_id"))
    path = new_scratch(t.spark, "documents")
    stores.write_document_store(merged, path, "version")
    return t.spark.read.parquet(path)


@query("chunk_store_append", "S14, R6")
def _(t):
    path = new_scratch(t.spark, "chunks")
    chunks = chunking.chunk_documents(t.spread("documents"), "doc_id", "text", "sentence").join(
        t.documents.select("doc_id", F.col("source").alias("resource_id")), "doc_id")
    stores.append_chunks(chunks, path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy("resource_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))


@query("embedding_store", "S14", """
SELECT label AS resource_id, count(*) AS vectors, sum(len(embedding))::BIGINT AS numbers FROM embeddings GROUP BY label""")
def _(t):
    path = new_scratch(t.spark, "vectors")
    stores.append_chunks(t.embeddings.select(F.col("label").alias("resource_id"), "vec_id", "embedding"), path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy("resource_id").agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.size("embedding")).alias("numbers"))


def _export_query(kind):
    def build(t):
        orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
        path = exported(t, orders, kind, f"export-{kind}")
        return files.read_table(t.spark, path, {"json": "jsonl"}.get(kind, kind), orders.schema)
    return build


for _kind in ("csv", "json", "parquet"):
    query(f"export_{_kind}", "S15", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")(_export_query(_kind))


@query("records_as_json", "S16", """
SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS record FROM nation""")
def _(t):
    return files.as_records(t.nation, "json")


@query("records_as_csv", "S16", "SELECT s_suppkey || ',' || s_name || ',' || s_nationkey AS record FROM supplier")
def _(t):
    return files.as_records(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), "csv")


@query("audit_scan", "S18, L4", f"""
SELECT event_id, user_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'
  AND event_type = 'error' AND {SEVERITY} = 'high' ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def _(t):
    path, log = new_scratch(t.spark, "audit"), audit_log(t)
    stores.write_audit_days(log, path)
    days = stores.read_audit_days(t.spark, path, log.schema.add("day", "string"))
    found = activity.audit_scan(days, "2024-01-10 06:00:00", "2024-01-12 18:00:00", event_type="error", severity="high")
    return found.select("event_id", F.col("user_id").cast("long").alias("user_id"), "event_type")


@query("activity_export", "S19", f"""
SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '{EVENTS_END}' - INTERVAL 36 HOUR AND ts <= TIMESTAMP '{EVENTS_END}'""")
def _(t):
    path = new_scratch(t.spark, "activity")
    stores.export_activities(t.events, path, ntz(EVENTS_END), 36)
    return t.spark.read.schema("event_id long, event_type string").json(path)


# ---- streams -----------------------------------------------------------------------------------

ARRIVAL_FILES = 4  # of one arrival; a batch of the stream reads as many


def arrivals(t, df, steps=4):
    """The rows in time order as separate arrivals: one append of a few files, in time order too, per quarter of the time span."""
    path = new_scratch(t.spark, "arrivals")
    span = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (span["b"] - span["a"]) / steps
    cuts = [span["a"] + step * i for i in range(steps)]
    for i, cut in enumerate(cuts):
        part = df.where(F.col("ts") >= F.lit(cut).cast("timestamp_ntz"))
        if i + 1 < steps:
            part = part.where(F.col("ts") < F.lit(cuts[i + 1]).cast("timestamp_ntz"))
        part.repartitionByRange(ARRIVAL_FILES, "ts").write.mode("append").parquet(path)
    return path


def event_stream(t):
    return streams.file_stream(t.spark, arrivals(t, t.events), t.events.schema, files_per_batch=ARRIVAL_FILES)


@query("stream_ingest", "ST1, C7, S8", """
SELECT c_custkey AS cust_key, c_name AS name_full, c_acctbal AS acct_bal, c_nationkey < 12 AS is_active,
  c_mktsegment AS name_full_1, 'acme' AS client_id, 'loader' AS user_id, 'customers' AS resource_id
FROM customer WHERE c_acctbal >= 0""")
def _(t):
    messy, path = messy_customers(t), new_scratch(t.spark, "incoming")
    messy.repartition(3).write.csv(path, header=True)
    plan = cleaning.clean_table(messy).types
    stream = t.spark.readStream.schema(messy.schema).option("header", True).option("maxFilesPerTrigger", 1).csv(path)
    ingested = streams.continuous_ingest(
        stream.drop("Empty Column"), plan, lambda df: access.stamp_tenant(df, "acme", "loader", "customers"))
    return streams.run_append(ingested, "ingest")


LATEST_UPLOADS = f"""SELECT user_id, event_id, {STATUS} AS status,
  CASE WHEN event_type = 'purchase' THEN 100.0 ELSE least(100.0, least(value, 500.0) / 500 * 100) END AS percent,
  event_type IN ('purchase', 'error') AS finished FROM events"""


@query("stream_upload_progress", "ST2, A16", f"""
SELECT user_id, event_id, status, round(percent, 6) AS percent, finished FROM ({LATEST_UPLOADS.replace(
    "FROM events", ", ts FROM events")}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    progress = progress_events(t)
    stream = streams.file_stream(t.spark, arrivals(t, progress), progress.schema, files_per_batch=ARRIVAL_FILES)
    states = streams.run_updates(streams.latest_progress(stream, "user_id"), "progress-state", ["user_id"])
    return states.select("user_id", "event_id", "status", F.round("percent", 6).alias("percent"), "finished")


@query("stream_audit_counts", "ST3, A13", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, {SEVERITY} AS severity, count(*) AS events FROM events GROUP BY ALL""")
def _(t):
    stream = event_stream(t).withColumn("severity", F.expr(SEVERITY))
    counted = streams.daily_audit_counts(stream, ["event_type", "severity"])
    return streams.run_updates(counted, "audit-counts", ["day", "event_type", "severity"])


@query("stream_rate_limit", "ST4", f"SELECT *, false AS late FROM ({RATE_LIMIT_SQL})")
def _(t):
    stream = event_stream(t).select("event_type", "ts", "event_id")
    return streams.run_append(streams.rate_limiter(stream, "event_type", "streaming"), "limits")


@query("stream_sessions", "ST5", """
SELECT user_id, min(ts)::VARCHAR AS session_start, max(ts)::VARCHAR AS session_end, count(*) AS events,
  max(ts) + INTERVAL 2 HOUR > (SELECT max(ts) FROM events) AS open FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000
      THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, s""")
def _(t):
    # Sessions that could still grow when the input ends are reported as open.
    seen = streams.run_updates(streams.idle_sessions(event_stream(t), "user_id"), "sessions", ["user_id", "session_start"]).where("events > 0")
    return seen.withColumns({c: F.col(c).cast("timestamp_ntz").cast("string") for c in ("session_start", "session_end")})


@query("stream_sliding_activity", "ST6, A17", f"""
SELECT strftime(h, '%Y-%m-%d %H:%M') AS window_end, event_type, count(*) AS activities,
  count(*) FILTER (k = 'response') AS responses, count(*) FILTER (k = 'error') AS errors,
  CASE WHEN count(*) FILTER (k IN ('response', 'error')) > 0 THEN count(*) FILTER (k = 'response') / count(*) FILTER (k IN ('response', 'error'))
    ELSE 1.0 END AS success_rate
FROM (SELECT event_type, {KIND} AS k, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR,
  date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS h FROM events) GROUP BY ALL""")
def _(t):
    stream = event_stream(t).withColumn("activity_type", F.expr(KIND))
    measured = streams.sliding_activity(stream, ["event_type"], "30 days")
    latest = streams.run_updates(measured, "activity", ["window_end", "event_type"])
    return latest.withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd HH:mm"))


@query("stream_distinct_content", "ST7, V8", """
SELECT count(*) AS kept, count(DISTINCT content_hash) AS distinct_content FROM (
  SELECT sha256(text) AS content_hash FROM documents GROUP BY text)""")
def _(t):
    arrived = t.documents.select(
        "doc_id", "text", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)").alias("ts"))
    stream = streams.file_stream(t.spark, arrivals(t, arrived), arrived.schema, files_per_batch=ARRIVAL_FILES)
    kept = streams.run_append(streams.drop_repeated_content(stream, F.col("text")), "distinct")
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("content_hash").alias("distinct_content"))
