"""Queries over cleaning, typing, profiling and data quality of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.operators import cleaning, harmonise as hz, profiling
from tabularium.plans.registry import query


def messy_customers(t):
    """Customers as an untidy text table: padded values and names, an empty column, empty rows."""
    known = F.col("c_acctbal") >= 0

    def shown(value):
        return F.when(known, value)

    return t.customer.select(
        shown(F.concat(F.lit("  "), F.col("c_custkey").cast("string"))).alias("  Cust Key "),
        shown(F.concat("c_name", F.lit("\t "))).alias("Name (full)"),
        shown(F.concat(F.lit(" "), F.col("c_acctbal").cast("decimal(12,2)").cast("string"))).alias("Acct-Bal"),
        shown(F.when(F.col("c_nationkey") < 12, "yes").otherwise("No ")).alias("is  active?"),
        F.lit(None).cast("string").alias("Empty Column"),
        shown(F.col("c_mktsegment")).alias("name full"),
    )


MESSY = """(SELECT '  ' || c_custkey AS a, c_name || E'\\t ' AS b, ' ' || c_acctbal::DECIMAL(12,2) AS c,
  CASE WHEN c_nationkey < 12 THEN 'yes' ELSE 'No ' END AS d, c_mktsegment AS e FROM customer WHERE c_acctbal >= 0)"""


@query("strip_whitespace", "C1", """
SELECT c_custkey::VARCHAR AS "Cust Key", c_name AS "Name (full)", (c_acctbal::DECIMAL(12,2))::VARCHAR AS "Acct-Bal",
  CASE WHEN c_nationkey < 12 THEN 'yes' ELSE 'No' END AS "is  active?", c_mktsegment AS "name full"
FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL FROM customer WHERE NOT c_acctbal >= 0""")
def _(t):
    return cleaning.strip_whitespace(messy_customers(t)).drop("Empty Column")


@query("normalize_names", "C2", """
SELECT a AS cust_key, b AS name_full, c AS acct_bal, d AS is_active, e AS name_full_1 FROM """ + MESSY)
def _(t):
    named = cleaning.normalize_names(messy_customers(t))
    return named.where("cust_key IS NOT NULL").drop("empty_column")


@query("drop_empty_rows", "C3", f"SELECT count(*) AS rows FROM {MESSY}")
def _(t):
    return cleaning.drop_empty_rows(messy_customers(t)).agg(F.count(F.lit(1)).alias("rows"))


@query("drop_empty_columns", "C4", """
SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name FROM customer)""")
def _(t):
    padded = t.customer.select("c_custkey", F.lit(None).cast("double").alias("gone"), "c_name")
    return cleaning.drop_empty_columns(padded)


def gappy_orders(t):
    return t.orders.selectExpr(
        "o_orderkey", "CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS price",
        "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status",
        "CASE WHEN o_custkey < 10 THEN o_custkey END AS rare",
    )


GAPPY = """(SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS price,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
  CASE WHEN o_custkey < 10 THEN o_custkey END AS rare FROM orders)"""

MISSING_SQL = {
    "drop_rows": f"""SELECT * FROM {GAPPY}
WHERE (price IS NOT NULL)::INT + (status IS NOT NULL)::INT + (rare IS NOT NULL)::INT + 1 >= 2""",
    "drop_cols": f"SELECT o_orderkey, price, status FROM {GAPPY}",
    "fill_mean": f"""SELECT o_orderkey::DOUBLE AS o_orderkey, round(coalesce(price, avg(price) OVER ()), 6) AS price,
  status, round(coalesce(rare, avg(rare) OVER ()), 6) AS rare FROM {GAPPY}""",
    "fill_mode": f"""WITH g AS (SELECT * FROM {GAPPY}),
  p AS (SELECT price FROM g WHERE price IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, price LIMIT 1),
  s AS (SELECT status FROM g WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1),
  r AS (SELECT rare FROM g WHERE rare IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, rare LIMIT 1)
SELECT o_orderkey, coalesce(price, (FROM p)) AS price, coalesce(status, (FROM s)) AS status,
  coalesce(rare, (FROM r)) AS rare FROM g""",
    "fill_zero": f"""SELECT o_orderkey, coalesce(price, 0) AS price, status, coalesce(rare, 0) AS rare FROM {GAPPY}""",
    "fill_empty": f"""SELECT o_orderkey, price, coalesce(status, '') AS status, rare FROM {GAPPY}""",
    "null": f"SELECT * FROM {GAPPY}",
}


def _missing(strategy):
    def build(t):
        result = cleaning.handle_missing(gappy_orders(t), strategy)
        if strategy == "fill_mean":
            result = result.withColumns({c: F.round(c, 6) for c in ("o_orderkey", "price", "rare")})
        return result
    return build


for _strategy, _sql in MISSING_SQL.items():
    query(f"missing_{_strategy}", "C5", _sql)(_missing(_strategy))


def stringified_events(t):
    return t.spread("events").select(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"),
        F.date_format("ts", "MM/dd/yyyy").alias("day"), F.col("value").cast("string").alias("value"),
        F.when(F.col("value") > 50, "yes").otherwise("no").alias("large"),
        F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("unknown").alias("partner"),
        "event_type",
    )


@query("detect_types", "C6", """
SELECT event_id AS id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS seen_at,
  strftime(ts, '%Y-%m-%d') AS day, value, value > 50 AS large,
  CASE WHEN user_id % 2 = 0 THEN user_id END AS partner, event_type FROM events""")
def _(t):
    typed = cleaning.convert_types(stringified_events(t))
    return typed.withColumns({
        "seen_at": F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss"), "day": F.date_format("day", "yyyy-MM-dd"),
    })


@query("detect_types_by_share", "C6", """
SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR ELSE 'unknown' END AS partner FROM events""")
def _(t):
    typed = cleaning.convert_types(stringified_events(t), min_share=0.9)
    return typed.select("id", "partner")


@query("convert_whole_columns", "P10", """
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
  CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE 'x' END AS mixed FROM orders""")
def _(t):
    texts = t.orders.select(
        F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
        F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("x").alias("mixed"),
    )
    typed = cleaning.convert_whole_columns(texts)
    return typed.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("clean_table", "C7", """
SELECT c_custkey AS cust_key, c_name AS name_full, c_acctbal AS acct_bal, c_nationkey < 12 AS is_active,
  c_mktsegment AS name_full_1 FROM customer WHERE c_acctbal >= 0""")
def _(t):
    return cleaning.clean_table(messy_customers(t)).table


@query("clean_table_stats", "C7", """
SELECT count(*) AS original_rows, 6 AS original_columns, count(*) FILTER (c_acctbal >= 0) AS final_rows,
  5 AS final_columns, count(*) - count(*) FILTER (c_acctbal >= 0) AS rows_removed, 1 AS columns_removed,
  'strip_whitespace, normalize_column_names, detect_and_convert_types' AS operations FROM customer""")
def _(t):
    return cleaning.clean_table(messy_customers(t)).stats


# ---- profiling ---------------------------------------------------------------------------------

def _summary_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        n, skew = f"count({c})", f"skewness({c})"
        g1 = f"({skew} * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)))"
        p = f"exp(-({n} / 6.0 * ({g1} * {g1} + kurtosis_pop({c}) ** 2 / 4)) / 2)"
        parts.append(f"""SELECT '{c}' AS variable, {n} AS count, round(avg({c}), 4) AS mean,
  round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std_dev, min({c})::DOUBLE AS min_value,
  max({c})::DOUBLE AS max_value, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3,
  round({skew}, 4) AS skewness, {p} > 0.05 AS is_normal,
  CASE WHEN {p} > 0.05 THEN 'normal' WHEN {skew} > 1 THEN 'right_skewed' WHEN {skew} < -1 THEN 'left_skewed'
  ELSE 'unknown' END AS distribution FROM {table}""")
    return "\nUNION ALL ".join(parts)


def _rounded_summary(df):
    return profiling.numeric_summary(df).drop("p_value").withColumns(
        {c: F.round(c, 6) for c in ("median", "std_dev", "q1", "q3")} | {c: F.round(c, 4) for c in ("mean", "skewness")})


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("numeric_summary", "Q1, Q2", _summary_sql("lineitem", LINE_NUMBERS))
def _(t):
    return _rounded_summary(t.lineitem.select(*LINE_NUMBERS))


@query("distribution_shape", "Q1, Q2", _summary_sql("events", ["value"]))
def _(t):
    return _rounded_summary(t.events.select("value"))


@query("distinct_counts", "A25", """
SELECT 'l_partkey' AS field, count(DISTINCT l_partkey) AS unique_values FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem""")
def _(t):
    return profiling.distinct_counts(t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"))


TABLE_FIELDS = {
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float",
                 "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "float"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string",
             "p_size": "integer", "p_retailprice": "float"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
               "o_orderdate": "datetime", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
                 "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime"},
    "pages": {"page_id": "integer", "url": "string", "html": "string"},
    "conversations": {"conv_id": "integer", "turn": "integer", "role": "string", "text": "string"},
    "documents": {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"},
}
SCHEMA_SQL = "\nUNION ALL ".join(
    f"""SELECT '{table}' AS "table", {i} AS ordinal, '{c}' AS "column", '{kind}' AS type, count(*) AS rows, count({c}) AS filled
FROM {table}""" for table, fields in TABLE_FIELDS.items() for i, (c, kind) in enumerate(fields.items()))


@query("schema_rows", "Q3", SCHEMA_SQL)
def _(t):
    tables = {name: getattr(t, name) for name in TABLE_FIELDS}
    schema = profiling.schema_rows(t.spark, tables)
    filled = None
    for name, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns])
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in df.columns])
        rows = counts.select(F.lit(name).alias("table"), "rows", F.explode(cells).alias("x")).select("table", "rows", "x.*")
        filled = rows if filled is None else filled.unionByName(rows)
    return schema.join(filled, ["table", "column"]).select("table", "ordinal", "column", "type", "rows", "filled")


SEMANTIC_SQL = {
    "c_custkey": "identifier", "c_name": "name", "c_nationkey": "identifier", "s_suppkey": "identifier",
    "s_name": "name", "s_nationkey": "identifier", "p_partkey": "identifier", "p_name": "name", "p_type": "category",
    "p_retailprice": "monetary_amount", "o_orderkey": "identifier", "o_custkey": "identifier",
    "o_orderstatus": "category", "o_totalprice": "monetary_amount", "o_orderdate": "datetime",
    "l_orderkey": "identifier", "l_partkey": "identifier", "l_suppkey": "identifier", "l_linenumber": "numeric",
    "l_quantity": "numeric", "l_extendedprice": "monetary_amount", "l_discount": "numeric",
    "l_linestatus": "category", "l_shipdate": "datetime", "page_id": "identifier", "url": "url",
    "conv_id": "identifier", "doc_id": "identifier",
}


def _profile_sql(tables: dict[str, dict[str, str]]) -> str:
    parts = []
    for table, fields in tables.items():
        for c, kind in fields.items():
            text = f"{c}::VARCHAR"
            forms = [rf"regexp_matches({text}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')",
                     rf"regexp_matches({text}, '^\d{{4}}-\d{{2}}-\d{{2}}([ T]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?)?$')",
                     f"lower({text}) IN ('true', 'false', 'yes', 'no')"]
            form = f"CASE WHEN {forms[0]} THEN 0 WHEN {forms[1]} THEN 1 WHEN {forms[2]} THEN 2 ELSE 3 END"
            consistent = "1.0" if kind != "string" else f"""greatest({', '.join(
                f'count(*) FILTER ({c} IS NOT NULL AND ({form}) = {k})' for k in range(4))})::DOUBLE / count({c})"""
            email = f"coalesce(bool_or(contains({text}, '@') AND contains({text}, '.')), false)"
            phone = rf"coalesce(bool_or(regexp_matches({text}, '^[\d\-\(\)\+\s]') AND length({text}) > 7), false)"
            url = f"coalesce(bool_or(starts_with({text}, 'http://') OR starts_with({text}, 'https://')), false)"
            if c in SEMANTIC_SQL:
                semantic = f"'{SEMANTIC_SQL[c]}'"
            elif kind == "string":
                semantic = (f"CASE WHEN {email} THEN 'email' WHEN {url} THEN 'url' WHEN {phone} THEN 'phone' "
                            "ELSE 'general' END")
            else:
                semantic = "'general'"
            uuid = rf"'^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', 'i'"
            parts.append(rf"""SELECT '{table}' AS "table", '{c}' AS field, '{kind}' AS type, count(*) AS total,
  count({c}) AS filled, count(DISTINCT {c}) AS unique_values, {consistent} AS consistency, {semantic} AS semantic_type,
  array_to_string(list_filter([CASE WHEN {email} THEN 'email_format' END, CASE WHEN {phone} THEN 'phone_format' END,
    CASE WHEN bool_or(regexp_matches({text}, '^\d{{4}}-\d{{2}}-\d{{2}}')) THEN 'iso_date' END,
    CASE WHEN bool_or(regexp_matches({text}, {uuid})) THEN 'uuid_format' END,
    CASE WHEN min(length({text})) = max(length({text})) AND max(length({text})) > 1
      THEN 'fixed_length_' || max(length({text})) END], lambda x: x IS NOT NULL), ',') AS patterns
FROM {table}""")
    return "\nUNION ALL ".join(parts)


def _quality_sql(tables: dict[str, dict[str, str]]) -> str:
    return f"""SELECT *, (total - filled) / total AS null_rate, unique_values / greatest(total, 1) AS uniqueness,
  array_to_string(list_filter([CASE WHEN (total - filled) / total > 0.5 THEN 'high_null_rate' END,
    CASE WHEN unique_values / greatest(total, 1) < 0.1 THEN 'low_uniqueness' END,
    CASE WHEN consistency < 0.9 THEN 'inconsistent_types' END], lambda x: x IS NOT NULL), ',') AS anomalies,
  least(1.0, greatest(0.0, 1.0 - (total - filled) / total * 0.3 - (1.0 - consistency) * 0.4
    + CASE WHEN unique_values / greatest(total, 1) BETWEEN 0.1 AND 0.9 THEN 0.1 ELSE 0 END)) AS quality_score
FROM ({_profile_sql(tables)})"""


def _tables(t, names):
    return {name: getattr(t, name) for name in names}


PROFILED = ["lineitem", "pages", "documents", "conversations"]


@query("field_profile", "Q5, Q6, A25", f"""
SELECT "table", field, type, total, filled, unique_values, round(consistency, 6) AS consistency, semantic_type, patterns
FROM ({_profile_sql({k: TABLE_FIELDS[k] for k in PROFILED})})""")
def _(t):
    fields = profiling.quality_of_tables(_tables(t, PROFILED))
    return fields.select(
        "table", "field", "type", "total", "filled", "unique_values", F.round("consistency", 6).alias("consistency"),
        "semantic_type", F.array_join("patterns", ",").alias("patterns"))


@query("field_quality", "Q7, Q8", f"""
SELECT "table", field, anomalies, round(quality_score, 6) AS quality_score
FROM ({_quality_sql({k: TABLE_FIELDS[k] for k in ("customer", "lineitem")})})""")
def _(t):
    fields = profiling.quality_of_tables(_tables(t, ("customer", "lineitem")))
    return fields.select("table", "field", F.array_join("anomalies", ",").alias("anomalies"),
                         F.round("quality_score", 6).alias("quality_score"))


@query("quality_dimensions", "Q8, Q9", f"""
SELECT *, round(completeness * 0.25 + consistency * 0.25 + accuracy * 0.2 + uniqueness * 0.15 + validity * 0.15, 4)
  AS overall FROM (
SELECT "table", avg(CASE WHEN contains(anomalies, 'high_null_rate') THEN 0.3 ELSE 0.9 END) AS completeness,
  avg(CASE WHEN contains(anomalies, 'inconsistent_types') THEN 0.4 ELSE 0.9 END) AS consistency, 0.8::DOUBLE AS accuracy,
  avg(CASE WHEN contains(anomalies, 'low_uniqueness') THEN 0.3 ELSE 0.8 END) AS uniqueness,
  avg(CASE WHEN patterns <> '' THEN 0.9 ELSE 0.7 END) AS validity, avg(quality_score) AS schema_score
FROM ({_quality_sql(TABLE_FIELDS)}) GROUP BY "table")""".replace("SELECT *, round(", """
SELECT "table", round(completeness, 4) AS completeness, round(consistency, 4) AS consistency, accuracy,
  round(uniqueness, 4) AS uniqueness, round(validity, 4) AS validity, round(schema_score, 4) AS schema_score, round("""))
def _(t):
    scores = profiling.quality_dimensions(profiling.quality_of_tables(_tables(t, TABLE_FIELDS)))
    return scores.withColumns({c: F.round(c, 4) for c in scores.columns if c != "table"})


@query("quality_issues", "Q10", f"""
SELECT "table", field, anomaly, CASE anomaly WHEN 'high_null_rate' THEN 'completeness'
    WHEN 'inconsistent_types' THEN 'consistency' ELSE 'uniqueness' END AS issue_type,
  CASE anomaly WHEN 'high_null_rate' THEN 'medium' WHEN 'inconsistent_types' THEN 'high' ELSE 'low' END AS severity
FROM (SELECT "table", field, unnest(string_split(anomalies, ',')) AS anomaly
  FROM ({_quality_sql({"lineitem": TABLE_FIELDS["lineitem"]})}) WHERE anomalies <> '')""")
def _(t):
    return profiling.quality_issues(profiling.quality_of_tables({"lineitem": t.lineitem}))


@query("catalog_overview", "Q11")
def _(t):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
             "embeddings", "pages", "benchmark", "labels", "conversations"]
    tables = {name: t.spread(name) for name in names}
    fields = profiling.quality_of_tables(tables, exact=False)
    related = hz.scored_pairs(t.spark, hz.fields_of(tables), hz.RELATION_SIGNS, hz.RELATION_MIN)
    return profiling.catalog_overview(profiling.quality_dimensions(fields), relationships=len(related))


@query("column_roles", "Q12", """
SELECT 'p_partkey' AS field, true AS is_numeric, false AS is_categorical, false AS is_date
UNION ALL SELECT 'p_name', false, (SELECT count(DISTINCT p_name) / count(p_name) < 0.5 FROM part), false
UNION ALL SELECT 'p_brand', false, (SELECT count(DISTINCT p_brand) / count(p_brand) < 0.5 FROM part), false
UNION ALL SELECT 'p_type', false, (SELECT count(DISTINCT p_type) / count(p_type) < 0.5 FROM part), false
UNION ALL SELECT 'p_size', true, false, false UNION ALL SELECT 'p_retailprice', true, false, false""")
def _(t):
    return profiling.column_roles(t.part)


@query("chart_category_counts", "Q13", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def _(t):
    return profiling.category_counts(t.orders, "o_orderpriority")


@query("chart_trend_line", "Q13", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS count, round(avg(o_totalprice), 6) AS mean,
  round(sum(o_totalprice), 6) AS total FROM orders GROUP BY 1""")
def _(t):
    line = profiling.trend_line(t.orders, "o_orderdate", "o_totalprice")
    return line.withColumns({c: F.round(c, 6) for c in ("mean", "total")})


@query("chart_scatter_pairs", "Q13", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return profiling.scatter_pairs(t.orders, "o_custkey", "o_totalprice", "o_orderkey")
