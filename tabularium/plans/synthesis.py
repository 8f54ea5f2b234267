"""Queries over field mapping, join-key discovery, schema conflicts and synthesis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.names import semantic_type_of_name
from tabularium.operators import harmonise as hz, profiling
from tabularium.plans.registry import query
from tabularium.plans.tabular import TABLE_FIELDS


def _tables(t, names):
    return {name: getattr(t, name) for name in names}


KEYED = ["nation", "customer", "supplier", "orders"]


# By the rule: a shared word (0.2), the same meaning (0.3) and type (0.2), for two names also a shared value pattern (0.1).
RELATED = [
    ("nation", "n_regionkey", "customer", "c_nationkey"), ("nation", "n_nationkey", "customer", "c_nationkey"),
    ("nation", "n_name", "customer", "c_name"), ("nation", "n_regionkey", "supplier", "s_nationkey"),
    ("nation", "n_nationkey", "supplier", "s_nationkey"), ("nation", "n_name", "supplier", "s_name"),
    ("customer", "c_nationkey", "supplier", "s_nationkey"), ("customer", "c_name", "supplier", "s_name"),
    ("customer", "c_nationkey", "orders", "o_custkey"), ("customer", "c_custkey", "orders", "o_custkey"),
    ("supplier", "s_nationkey", "orders", "o_custkey"), ("supplier", "s_suppkey", "orders", "o_custkey"),
]


def _rate_sql(source: str, left: str, target: str, right: str) -> str:
    score = 0.8 if (left, right) == ("c_name", "s_name") else 0.7
    kind = "correlation" if "name" in left else "foreign_key"
    return (f"SELECT '{source}' AS source, '{left}' AS source_field, '{target}' AS target, '{right}' AS target_field, "
            f"{score}::DOUBLE AS score, '{kind}' AS kind, 'left' AS join_type, "
            f"(SELECT count(DISTINCT {left}) FILTER ({left}::VARCHAR IN (SELECT {right}::VARCHAR FROM {target})) / count(DISTINCT {left}) "
            f"FROM {source}) AS match_rate")


RATES = " UNION ALL ".join(_rate_sql(*r) for r in RELATED)


@query("field_relationships", "J7", f"SELECT source, source_field, target, target_field, match_rate FROM ({RATES})")
def _(t):
    tables = _tables(t, KEYED)
    found = hz.relationships(tables, hz.profiled_fields(tables))
    return found.select("source", "source_field", "target", "target_field", "match_rate")


@query("all_field_relationships", "J7", RATES)
def _(t):
    tables = _tables(t, KEYED)
    return hz.relationships(tables, hz.profiled_fields(tables))


@query("discovered_join", "J8, J1, H10", """
SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey""")
def _(t):
    return hz.synthesize_join(_tables(t, ("customer", "orders")), ["c_name", "o_orderkey", "o_totalprice"])


@query("discovered_join_chain", "J8, H10", """
SELECT n_name, c_name, o_orderkey, l_linenumber, l_quantity FROM nation JOIN customer ON n_nationkey = c_nationkey
JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey""")
def _(t):
    tables = _tables(t, ("lineitem", "nation", "customer", "orders"))
    return hz.synthesize_join(tables, ["n_name", "c_name", "o_orderkey", "l_linenumber", "l_quantity"])


@query("join_candidates_measured", "J8", """
SELECT 'c_custkey' AS left_field, 'o_custkey' AS right_field, 0.8::DOUBLE AS score,
  (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) AS joined_rows""")
def _(t):
    tables = _tables(t, ("customer", "orders"))
    left, right, score = hz.join_key(t.spark, hz.fields_of(tables))[0]
    joined = hz.synthesize_join(tables, ["o_orderkey"])
    return joined.agg(F.count(F.lit(1)).alias("joined_rows")).select(
        F.lit(left.name).alias("left_field"), F.lit(right.name).alias("right_field"),
        F.lit(round(score, 6)).alias("score"), "joined_rows")


DESIRED = {
    "c_name": "name of the customer", "customer_name": "name of the customer", "order_date": "day of the order",
    "total_price": "price of the order", "l_quantity": "units", "nation_key": "nation", "email": "mail address",
}
MAPPED = ["customer", "orders", "lineitem"]
DESCRIBED = {
    ("customer", "c_name"): "name of the customer", ("customer", "c_acctbal"): "balance of the account", ("orders", "o_orderdate"): "day of the order",
    ("orders", "o_totalprice"): "total price of the order in units", ("lineitem", "l_quantity"): "units", ("customer", "c_nationkey"): "nation",
}


def profile(t):
    profiles = reduce(DataFrame.unionByName, [profiling.field_profile(df, n, exact=False) for n, df in ((n, t.spread(n)) for n in MAPPED)])
    told = F.create_map(*[F.lit(x) for (table, c), d in DESCRIBED.items() for x in (f"{table}.{c}", d)])
    return profiles.withColumn("field_description", told[F.concat_ws(".", "table", "field")])


def _semantic(name: str) -> str:
    return semantic_type_of_name(name) or "general"


AVAILABLE = ", ".join(
    f"('{table}', '{c}', '{kind}', '{_semantic(c)}', '{DESCRIBED.get((table, c), '')}')" for table in MAPPED for c, kind in TABLE_FIELDS[table].items())
WANTED = ", ".join(f"('{d}', '{_semantic(d)}', '{told}')" for d, told in DESIRED.items())


def _mentions(words) -> str:
    return "(" + " OR ".join(f"contains(lower(desired), '{w}')" for w in words) + ")"


def _normal(c: str) -> str:
    return (rf"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[_\-\s\.]+', '_', 'g'), '^(the_|a_|an_)', ''),"
            " '(_id|_key|_name|_value)$', '')")


TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '(\w+)', 1))"
TOLD = f"len(list_intersect({TOKENS.format('asked')}, {TOKENS.format('told')}))"
TOLD_SHARE = f"CASE WHEN told = '' THEN 0 ELSE {TOLD} / len(list_distinct(list_concat({TOKENS.format('asked')}, {TOKENS.format('told')}))) END"
TOLD_COMMON = f"CASE WHEN told = '' THEN 0 ELSE {TOLD} / greatest(len({TOKENS.format('asked')}), len({TOKENS.format('told')})) END"
SHARED = f"len(list_intersect({TOKENS.format('desired')}, {TOKENS.format('field')}))"
SCORES = f"""(SELECT *, CASE WHEN score >= 0.8 THEN 'direct' WHEN score >= 0.4 THEN 'similar' ELSE 'none' END AS kind FROM (
  SELECT desired, "table", field, type, {SHARED} / greatest(len({TOKENS.format('desired')}), len({TOKENS.format('field')})) AS common, {TOLD_COMMON} AS told_common,
  round(CASE WHEN lower(desired) = lower(field) THEN 0.95 WHEN {_normal('desired')} = {_normal('field')} THEN 0.9
    ELSE (0.7 * {SHARED} / len(list_distinct(list_concat({TOKENS.format('desired')}, {TOKENS.format('field')})))
      + 0.3 * len(list_filter(string_split(lower(desired), ''), lambda c: c <> '' AND contains(lower(field), c)))
        / greatest(length(desired), length(field))) * 0.4 + 0.3 * {TOLD_SHARE}
    + CASE WHEN wanted = semantic AND wanted <> 'general' THEN 0.2 ELSE 0 END
    + CASE WHEN CASE WHEN type IN ('integer', 'float') THEN {_mentions(hz.NUMERIC_INDICATORS)}
        WHEN type = 'string' THEN {_mentions(hz.TEXT_INDICATORS)}
        WHEN type = 'datetime' THEN {_mentions(hz.DATE_INDICATORS)} ELSE true END THEN 0.1 ELSE 0 END END, 6) AS score
  FROM (VALUES {AVAILABLE}) a("table", field, type, semantic, told), (VALUES {WANTED}) d(desired, wanted, asked)))"""
BEST = f"""(SELECT *, (kind = 'direct' AND score > 0.8) OR (kind = 'similar' AND score > 0.5) AS accepted FROM {SCORES}
  QUALIFY row_number() OVER (PARTITION BY desired ORDER BY score DESC, "table", field) = 1)"""


@query("field_mapping_scores", "H1", f"""SELECT desired, "table", field, type, score, kind FROM {SCORES}""")
def _(t):
    return hz.mapping_scores(profile(t), DESIRED)


@query("field_mappings", "H1", f"""
SELECT desired, CASE WHEN accepted THEN kind ELSE 'unmappable' END AS mapping,
  CASE WHEN accepted THEN "table" || '.' || field END AS source, score FROM {BEST}""")
def _(t):
    return hz.best_mappings(hz.mapping_scores(profile(t), DESIRED))


@query("mapping_coverage", "H1", f"""
SELECT count(*) AS desired, count(*) FILTER (accepted) AS mapped, count(*) FILTER (accepted) / count(*) AS coverage FROM {BEST}""")
def _(t):
    return hz.mapping_coverage(hz.best_mappings(hz.mapping_scores(profile(t), DESIRED)))


@query("simple_field_mappings", "H2", f"""
SELECT desired, "table", field, score, CASE WHEN score > 0.8 THEN 'direct' ELSE 'similar' END AS mapping FROM (
  SELECT desired, "table", field, round(common * 0.6 + told_common * 0.4, 6) AS score FROM {SCORES}) WHERE score > 0.3
QUALIFY row_number() OVER (PARTITION BY desired ORDER BY score DESC, "table", field) = 1""")
def _(t):
    return hz.simple_mappings(profile(t), DESIRED)


@query("synthesis_opportunities", "H12", f"""
SELECT desired, count(DISTINCT "table") AS resources, count(*) AS fields,
  CASE WHEN bool_or(contains(lower(field), 'id')) THEN 'join' WHEN count(DISTINCT lower(field)) = 1 THEN 'union'
    WHEN {_mentions(hz.AGGREGATE_WORDS)} THEN 'aggregation' ELSE 'transformation' END AS strategy,
  least(0.8, max(score)) AS estimated_quality,
  CASE WHEN count(DISTINCT "table") = 2 THEN 'medium' ELSE 'high' END AS complexity
FROM {SCORES} WHERE score > 0.3 GROUP BY desired HAVING count(DISTINCT "table") >= 2""")
def _(t):
    return hz.synthesis_opportunities(hz.mapping_scores(profile(t), DESIRED))


@query("apply_mapping", "H3", """
SELECT c_acctbal::DECIMAL(10,2) AS unit_price, c_custkey::INT AS visit_count, lower(c_name) AS email,
  regexp_replace(c_name, '[^0-9]', '', 'g') AS phone, c_mktsegment AS segment FROM customer""")
def _(t):
    texts = t.customer.select(
        F.col("c_acctbal").cast("string").alias("balance"), F.col("c_custkey").cast("string").alias("visits"),
        F.concat(F.lit(" "), "c_name").alias("contact"), F.concat("c_mktsegment", F.lit("  ")).alias("segment_text"))
    return hz.apply_mapping(texts, {"unit_price": "balance", "visit_count": "visits", "email": "contact",
                                    "phone": "contact", "segment": "segment_text"})


@query("derive_total", "H4", "SELECT round(sum(o_totalprice), 4) AS price_total FROM orders")
def _(t):
    derived = hz.derive_missing_field(t.orders.select("o_totalprice"), "price_total")
    return derived.withColumn("price_total", F.round("price_total", 4))


@query("derive_average", "H4", "SELECT round(avg(o_totalprice), 6) AS average_price FROM orders")
def _(t):
    return hz.derive_missing_field(t.orders.select("o_totalprice"), "average_price").withColumn(
        "average_price", F.round("average_price", 6))


@query("derive_count", "H4", "SELECT count(o_custkey) AS custkey_count FROM orders")
def _(t):
    return hz.derive_missing_field(t.orders.select("o_custkey"), "custkey_count")


@query("derive_first_known", "H4", """
SELECT o_orderkey, o_orderstatus, o_orderpriority, coalesce(o_orderstatus, o_orderpriority) AS priority_status FROM orders""")
def _(t):
    return hz.derive_missing_field(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "priority_status")


def customer_variants(t):
    return {
        "crm": t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"),
        "billing": t.customer.selectExpr("CAST(c_custkey AS STRING) AS c_custkey", "c_name",
                                         "CAST(c_acctbal AS BIGINT) AS c_acctbal", "c_nationkey"),
    }


@query("schema_conflicts", "H5, H6", """
SELECT 'crm' AS resource, 'c_custkey' AS field, 'data_type' AS conflict, 'cast_to_string' AS strategy, 'varchar' AS target,
  true AS precision_loss, count(c_custkey) AS values FROM customer
UNION ALL SELECT 'billing', 'c_custkey', 'data_type', 'cast_to_string', 'varchar', true, count(c_custkey) FROM customer
UNION ALL SELECT 'crm', 'c_acctbal', 'data_type', 'cast_to_numeric', 'decimal', false, count(c_acctbal) FROM customer
UNION ALL SELECT 'billing', 'c_acctbal', 'data_type', 'cast_to_numeric', 'decimal', false, count(c_acctbal) FROM customer""")
def _(t):
    return hz.conflict_report(customer_variants(t))


@query("failed_casts", "H6", """
SELECT 'crm' AS resource, 'c_custkey' AS field, 0 AS lost UNION ALL SELECT 'billing', 'c_custkey', 0
UNION ALL SELECT 'crm', 'c_acctbal', 0 UNION ALL SELECT 'billing', 'c_acctbal', 0""")
def _(t):
    return hz.failed_casts(customer_variants(t))


@query("unified_schema_rows", "H7, H8, H9, H11", """
SELECT 'c_custkey' AS field, 'integer' AS type, 0.6::DOUBLE AS similarity, 'join' AS strategy, 0.86::DOUBLE AS quality, count(c_custkey) * 2 AS values FROM customer
UNION ALL SELECT 'c_name', 'string', 0.6, 'join', 0.86, count(c_name) * 2 FROM customer
UNION ALL SELECT 'c_acctbal', 'float', 0.6, 'join', 0.86, count(c_acctbal) * 2 FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', 0.6, 'join', 0.86, count(c_mktsegment) FROM customer
UNION ALL SELECT 'c_nationkey', 'integer', 0.6, 'join', 0.86, count(c_nationkey) FROM customer""")
def _(t):
    tables = customer_variants(t)
    fields, stacked = hz.fields_of(tables), hz.synthesize_union(tables)
    schema = hz.unified_schema(fields)
    counted = stacked.agg(*[F.count(c).alias(c) for c in schema])
    rows = F.array(*[
        F.struct(F.lit(c).alias("field"), F.lit(kind).alias("type"), F.col(c).alias("values")) for c, kind in schema.items()])
    return counted.select(F.explode(rows).alias("x")).select(
        "x.*", F.lit(round(hz.schema_similarity(fields), 6)).alias("similarity"),
        F.lit(hz.synthesis_strategy(t.spark, fields)).alias("strategy"), F.lit(round(hz.synthesis_quality(t.spark, fields), 6)).alias("quality"))


@query("harmonised_union", "H6, H10, U2", """
SELECT 'crm' AS resource, c_custkey::VARCHAR AS c_custkey, c_name, c_acctbal::DECIMAL(18,6)::DOUBLE AS c_acctbal, c_mktsegment,
  NULL::INT AS c_nationkey FROM customer
UNION ALL SELECT 'billing', c_custkey::VARCHAR, c_name, trunc(c_acctbal)::DOUBLE, NULL, c_nationkey FROM customer""")
def _(t):
    return hz.synthesize_union(customer_variants(t)).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("harmonised_aggregate", "H10, A1", """
SELECT resource, count(*) AS n, round(sum(balance), 4) AS total FROM (SELECT 'crm' AS resource, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'billing', trunc(c_acctbal) FROM customer) GROUP BY resource""")
def _(t):
    return hz.synthesize_aggregate(
        customer_variants(t), ["resource"], {"n": "count(1)", "total": "round(CAST(sum(c_acctbal) AS DOUBLE), 4)"})


@query("yearly_union", "H10, U2", """
SELECT year(o_orderdate) AS resource, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def _(t):
    found = t.orders.select(F.year("o_orderdate").alias("y")).where("y IS NOT NULL").distinct().collect()  # a row per calendar year
    years = {str(y): t.orders.where(F.year("o_orderdate") == y).select("o_orderkey", "o_totalprice") for y in sorted(r["y"] for r in found)}
    counted = hz.synthesize_aggregate(years, ["resource"], {"n": "count(1)"})
    return counted.withColumn("resource", F.col("resource").cast("int"))
