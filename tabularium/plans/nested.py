"""Queries over nested JSON documents derived from events, line items and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.operators import json_docs as jd
from tabularium.plans.registry import query


def line_documents(t):
    """One nested document per line item, as JSON text."""
    body = F.struct(
        F.struct(F.col("l_orderkey").alias("Order Id"), F.lit(None).cast("string").alias("note"),
                 F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias("state")).alias("order"),
        F.array(F.struct(F.lit("qty").alias("kind"), F.col("l_quantity").alias("score")),
                F.struct(F.lit("tax").alias("kind"), F.col("l_tax").alias("score"))).alias("measures"),
        F.array("l_linenumber", "l_suppkey").alias("codes"), (F.col("l_discount") > 0.05).alias("is_cheap"),
        F.array().cast("array<int>").alias("empty_list"), F.lit("acme").alias("client_id"),
    )
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.spread("lineitem").select(key.alias("doc"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


DOC = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("json_profile_flat", "Q4", """
SELECT 'k' AS path, 'integer' AS type, false AS nullable, count(*) AS values,
  count(DISTINCT json_extract_string(props, '$.k')) AS unique_count,
  list_sort(list(DISTINCT json_extract_string(props, '$.k')))[1:10] AS samples FROM events""")
def _(t):
    return jd.leaf_profile(jd.json_leaves(t.spread("events"), "event_id", "props"))


@query("json_profile_nested", "Q4, S4", """
SELECT 'order.Order Id' AS path, 'integer' AS type, false AS nullable, count(*) AS values,
  count(DISTINCT l_orderkey) AS unique_count FROM lineitem
UNION ALL SELECT 'order.note', 'null', true, count(*), 0 FROM lineitem
UNION ALL SELECT 'order.state.flag', 'string', false, count(*), count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'order.state.status', 'string', false, count(*), count(DISTINCT l_linestatus) FROM lineitem
UNION ALL SELECT 'measures[0].kind', 'string', false, count(*), 1 FROM lineitem
UNION ALL SELECT 'measures[1].kind', 'string', false, count(*), 1 FROM lineitem
UNION ALL SELECT 'measures[0].score', 'numeric', false, count(*), count(DISTINCT l_quantity) FROM lineitem
UNION ALL SELECT 'measures[1].score', 'numeric', false, count(*), count(DISTINCT l_tax) FROM lineitem
UNION ALL SELECT 'codes', 'mixed', false, count(*), count(DISTINCT l_linenumber || ',' || l_suppkey) FROM lineitem
UNION ALL SELECT 'is_cheap', 'boolean', false, count(*), 2 FROM lineitem
UNION ALL SELECT 'empty_list', 'mixed', false, count(*), 1 FROM lineitem""")
def _(t):
    return jd.leaf_profile(jd.json_leaves(line_documents(t), "doc", "json")).drop("samples")


@query("json_profile_items", "Q4", """
WITH n AS (SELECT o_orderkey, o_custkey, o_orderkey % 11 AS n FROM orders),
i AS (SELECT o_custkey, unnest(range(n)) AS i FROM n)
SELECT 'parts[' || i || '].buyer' AS path, 'integer' AS type, false AS nullable, count(*) AS values, count(DISTINCT o_custkey) AS unique_count,
  list_sort(list(DISTINCT o_custkey::VARCHAR))[1:10] AS samples FROM i GROUP BY i
UNION ALL SELECT 'parts', 'mixed', false, count(*), 1, ['[]'] FROM n WHERE n = 0""")
def _(t):
    parts = F.expr("slice(transform(sequence(1, 11), i -> named_struct('buyer', o_custkey)), 1, cast(o_orderkey % 11 AS int))")
    documents = t.spread("orders").select("o_orderkey", F.to_json(F.struct(parts.alias("parts"))).alias("json"))
    return jd.leaf_profile(jd.json_leaves(documents, "o_orderkey", "json"))


@query("json_field_types", "Q14", f"""
SELECT {DOC} AS doc, 11 AS total, 2 AS numeric, 3 AS lists, 2 AS objects FROM lineitem""")
def _(t):
    return jd.field_type_counts(line_documents(t), "doc", "json")


@query("json_shape", "Q15", f"""
SELECT {DOC} AS doc, 3 AS max_depth, 13 AS fields, 'medium' AS complexity,
  'arrays,categorical,nested_objects,numerical' AS kinds FROM lineitem""")
def _(t):
    shape = jd.document_shape(line_documents(t), "doc", "json")
    return shape.withColumn("kinds", F.array_join("kinds", ","))


@query("json_clean", "C8, C9", f"""
SELECT {DOC} AS doc, '{{"order":{{"order_id":' || l_orderkey || ',"state":{{"flag":"' || l_returnflag || '","status":"'
  || l_linestatus || '"}}}},"measures":[{{"kind":"qty"}},{{"kind":"tax"}}],"codes":[' || l_linenumber || ',' || l_suppkey
  || '],"is_cheap":' || (l_discount > 0.05) || ',"client_id":"acme"}}' AS json FROM lineitem""")
def _(t):
    cleaned = line_documents(t).withColumn("json", jd.clean_json("json"))
    # Scores are left out of the comparison: the two engines print doubles differently.
    return cleaned.withColumn("json", F.regexp_replace("json", r',"score":[^}]*', ""))


@query("json_flatten_text", "C10", f"""
SELECT {DOC} AS doc, l_orderkey::VARCHAR AS order_id, l_returnflag AS flag, l_linestatus AS status FROM lineitem""")
def _(t):
    flat = line_documents(t).withColumn("json", jd.clean_json("json", flatten=True))
    return flat.select(
        "doc", F.json_tuple("json", "order_order_id", "order_state_flag", "order_state_status").alias("order_id", "flag", "status"))


def line_structs(t):
    return t.lineitem.select(
        "l_orderkey",
        F.struct(F.struct(F.col("l_partkey").alias("Part Key"), F.struct(F.col("l_suppkey").alias("Key No")).alias("Supplier")
                          ).alias("Item Info"), F.col("l_quantity").alias("Qty")).alias("Line Data"))


@query("flatten_structs", "C9, C10", """
SELECT l_orderkey, l_partkey AS line_data_item_info_part_key, l_suppkey AS line_data_item_info_supplier_key_no,
  l_quantity AS line_data_qty FROM lineitem""")
def _(t):
    return jd.flatten_struct(jd.normalize_struct_keys(line_structs(t)))


@query("document_rows", "C11", """
SELECT conv_id, turn, part.i AS i, part.s AS s, NULL AS tag, NULL AS role FROM (SELECT conv_id, turn, unnest(
  [{'i': 0, 's': role}, {'i': 1, 's': upper(role)}]) AS part FROM conversations)
UNION ALL SELECT conv_id, turn, NULL, NULL, unnest([role, text]), NULL FROM conversations
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, role FROM conversations""")
def _(t):
    nested = t.conversations.select(
        "conv_id", "turn",
        F.array(F.struct(F.lit(0).alias("i"), F.col("role").alias("s")),
                F.struct(F.lit(1).alias("i"), F.upper("role").alias("s"))).alias("parts"),
        F.array("role", "text").alias("tag"), "role")
    return jd.document_rows(nested, ["conv_id", "turn"])


def customer_documents(t):
    body = F.struct(
        F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department"),
                 F.struct(F.col("c_nationkey").alias("location"), F.col("c_acctbal").cast("int").alias("score")).alias("contact")
                 ).alias("profile"),
        F.array("c_mktsegment", "c_name").alias("interests"), F.lit("2024-01-01").alias("created_at"),
        F.struct(F.col("c_custkey").alias("career_goals")).alias("plan"))
    return t.spread("customer").select("c_custkey", F.to_json(body).alias("json"))


@query("persona_fields", "N11", """
SELECT c_custkey, 'profile.name' AS path, 'demographic' AS category, 'Name: ' || c_name AS label FROM customer
UNION ALL SELECT c_custkey, 'profile.department', 'demographic', 'Department: ' || c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'profile.contact.location', 'demographic', 'Location: ' || c_nationkey FROM customer
UNION ALL SELECT c_custkey, 'profile.contact.score', 'trait', 'Academic/Performance level: Score of ' || trunc(c_acctbal)::INT FROM customer
UNION ALL SELECT c_custkey, 'interests', 'interest', 'Interests: ' || c_mktsegment || ', ' || c_name FROM customer
UNION ALL SELECT c_custkey, 'plan.career_goals', 'goal', 'Career Goals: ' || c_custkey FROM customer""")
def _(t):
    return jd.persona_fields(jd.json_leaves(customer_documents(t), "c_custkey", "json"), "c_custkey")


@query("context_fields", "N12", """
SELECT c_custkey, 'profile.department' AS path, 'professional' AS category, c_mktsegment AS value, 'Department: ' || c_mktsegment AS label FROM customer
UNION ALL SELECT c_custkey, 'profile.contact.location', 'personal', c_nationkey::VARCHAR, 'Location: ' || c_nationkey FROM customer
UNION ALL SELECT c_custkey, 'created_at', 'temporal', '2024-01-01', 'Data from: 2024-01-01' FROM customer""")
def _(t):
    return jd.context_fields(jd.json_leaves(customer_documents(t), "c_custkey", "json"), "c_custkey")


@query("persona_buckets", "N11", """
SELECT c_custkey, 'Performance' AS bucket, 'Profile Contact Score: ' || trunc(c_acctbal)::INT AS label, 1 AS rank FROM customer
UNION ALL SELECT c_custkey, 'Interests & Goals', label, row_number() OVER (PARTITION BY c_custkey ORDER BY label) FROM (
  SELECT c_custkey, unnest([c_mktsegment, c_name, c_custkey::VARCHAR]) AS label FROM customer)""")
def _(t):
    leaves = jd.json_leaves(customer_documents(t), "c_custkey", "json")
    return jd.bucketed_fields(leaves, "c_custkey", jd.PERSONA_BUCKETS)


@query("context_buckets", "N12", """
SELECT c_custkey, 'Environmental' AS bucket, 'Profile Contact Location: ' || c_nationkey AS label, 1 AS rank FROM customer
UNION ALL SELECT c_custkey, 'Academic/Professional', 'Profile Department: ' || c_mktsegment, 1 FROM customer""")
def _(t):
    leaves = jd.json_leaves(customer_documents(t), "c_custkey", "json")
    return jd.bucketed_fields(leaves, "c_custkey", jd.CONTEXT_BUCKETS)


@query("fields_for_question", "N13", """
SELECT c_custkey, 'interests' AS path, '["' || c_mktsegment || '","' || c_name || '"]' AS value FROM customer
UNION ALL SELECT c_custkey, 'created_at', '2024-01-01' FROM customer""")
def _(t):
    leaves = jd.json_leaves(customer_documents(t), "c_custkey", "json")
    return jd.fields_for_question(leaves, "c_custkey", "which interests were created last")


@query("value_for_field", "N14", """
SELECT c_custkey, 1 AS rank, 'Plan.career Goals: ' || c_custkey AS label FROM customer
UNION ALL SELECT c_custkey, 2, 'Profile.contact.score: ' || trunc(c_acctbal)::INT FROM customer""")
def _(t):
    leaves = jd.json_leaves(customer_documents(t), "c_custkey", "json")
    return jd.value_for_field(leaves, "c_custkey", "career_score")
