"""Queries over selections, joins, aggregates, top-k, set operations and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.functions import ordered
from tabularium.functions.time import epoch_seconds
from tabularium.operators import access, relational as rel, templates
from tabularium.plans.registry import query


@query("select_filter_order_limit", "P1, L1, L2", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def _(t):
    return rel.select_rows(
        t.orders, ["o_orderkey", "o_custkey", "o_totalprice"],
        ["o_orderstatus = 'F'", "o_totalprice > 100000"], ["o_totalprice desc", "o_orderkey"], 50,
    )


@query("derived_field", "P2", """
SELECT * REPLACE (l_shipdate::VARCHAR AS l_shipdate), l_extendedprice * (1 - l_discount) AS net_price FROM lineitem""")
def _(t):
    derived = rel.derive_field(t.lineitem, "net_price", "l_extendedprice * (1 - l_discount)")
    return derived.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


TENANT_ORDERS = """(SELECT *, 'client-' || o_orderstatus AS client_id, 'user-' || (o_custkey // 100) AS user_id,
  'orders-' || o_orderpriority AS resource_id FROM orders)"""


def tenant_orders(t):
    return access.stamp_tenant(
        t.orders, F.concat(F.lit("client-"), "o_orderstatus"),
        F.concat(F.lit("user-"), F.floor(F.col("o_custkey") / 100)),
        F.concat(F.lit("orders-"), "o_orderpriority"),
    )


@query("tenant_stamp", "S8", """
SELECT *, 'acme-corp' AS client_id, 'user-1' AS user_id, '7f9c24e8-3b12-4f1c-9a55-0d6f5f1e2a10' AS resource_id
FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders)""")
def _(t):
    return access.stamp_tenant(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice"),
        "acme-corp", "user-1", "7f9c24e8-3b12-4f1c-9a55-0d6f5f1e2a10",
    )


@query("tenant_row_filter", "P3", f"""
SELECT o_orderkey, o_totalprice FROM {TENANT_ORDERS} WHERE client_id = 'client-F' AND user_id = 'user-1'""")
def _(t):
    return access.tenant_rows(tenant_orders(t), "client-F", "user-1").select("o_orderkey", "o_totalprice")


@query("drop_system_columns", "P9", """
SELECT * REPLACE (o_orderdate::VARCHAR AS o_orderdate) FROM orders""")
def _(t):
    return access.drop_system_columns(tenant_orders(t)).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("access_levels", "P4", f"""
SELECT level, count(*) AS visible, round(sum(o_totalprice), 4) AS total FROM (
  SELECT 'user' AS level, * FROM {TENANT_ORDERS} WHERE client_id = 'client-O' AND user_id = 'user-3'
  UNION ALL SELECT 'manager', * FROM {TENANT_ORDERS} WHERE client_id = 'client-O'
  UNION ALL SELECT 'admin', * FROM {TENANT_ORDERS} WHERE client_id = 'client-O') GROUP BY level""")
def _(t):
    stamped = tenant_orders(t)
    seen = F.array_compact(F.array(*[
        F.when(access.may_see("user-3", "client-O", level), F.lit(level)) for level in ("user", "manager", "admin")
    ]))
    return (
        stamped.select("o_totalprice", F.explode(seen).alias("level"))
        .groupBy("level").agg(F.count(F.lit(1)).alias("visible"), F.round(F.sum("o_totalprice"), 4).alias("total"))
    )


ACTION_OF = """CASE event_type WHEN 'click' THEN 'view' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'update'
  WHEN 'signup' THEN 'share' ELSE 'query' END"""
LEVEL_OF = """CASE WHEN max(value) > 400 THEN 'admin' WHEN max(value) > 200 THEN 'manager' ELSE 'user' END"""


@query("permission_check", "P5", f"""
WITH requests AS (SELECT event_id, user_id, {ACTION_OF} AS action, event_type AS resource FROM events),
users AS (SELECT user_id, {LEVEL_OF} AS level, count(*) FILTER (event_type = 'signup') > 0 AS active,
  max(value) > 100 AND max(value) <= 200 AS granted_delete FROM events GROUP BY user_id),
owners AS (SELECT event_type AS resource, arg_min(user_id, event_id) AS owner FROM events GROUP BY event_type),
joined AS (SELECT r.event_id, r.action, u.*, o.owner,
  CASE WHEN action IN ('view', 'query', 'update') THEN true
       WHEN action = 'delete' THEN level <> 'user' OR (granted_delete AND r.resource = 'error')
       ELSE level <> 'user' END AS allowed,
  CASE action WHEN 'delete' THEN 'delete' ELSE 'share' END AS lacking
  FROM requests r JOIN users u USING (user_id) JOIN owners o USING (resource))
SELECT reason, reason = 'Access granted' AS granted, count(*) AS requests FROM (
  SELECT CASE WHEN NOT active THEN 'User permissions not found or inactive'
    WHEN NOT allowed THEN 'Missing permissions: ' || lacking
    WHEN owner <> user_id AND level <> 'admin' THEN 'User does not own resource and lacks admin permissions'
    ELSE 'Access granted' END AS reason FROM joined) GROUP BY reason""")
def _(t):
    events = t.events
    text_id = F.col("user_id").cast("string")
    requests = events.select(
        F.col("event_id").alias("request_id"), F.lit("acme").alias("client_id"), text_id.alias("user_id"),
        F.col("event_type").alias("resource_id"), F.expr(ACTION_OF).alias("action"),
    )
    grants = F.when(
        (F.col("top") > 100) & (F.col("top") <= 200), F.create_map(F.lit("error"), F.array(F.lit("delete")))
    )
    users = (
        events.groupBy("user_id")
        .agg(F.max("value").alias("top"), F.expr(LEVEL_OF).alias("access_level"),
             (F.count_if(F.col("event_type") == "signup") > 0).alias("is_active"))
        .select(F.lit("acme").alias("client_id"), text_id.alias("user_id"), "access_level", "is_active",
                grants.alias("resource_grants"))
    )
    owners = events.groupBy(F.col("event_type").alias("resource_id")).agg(
        F.min_by(text_id, "event_id").alias("owner_id")
    ).withColumn("client_id", F.lit("acme"))
    decided = access.check_requests(requests, users, owners)
    return decided.groupBy("reason", "granted").agg(F.count(F.lit(1)).alias("requests"))


@query("sample_rows", "P6", "SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def _(t):
    return rel.select_rows(t.part, order_by=["p_partkey"], limit=5)


@query("key_column_rows", "P7", """
SELECT c_name FROM customer ORDER BY c_custkey LIMIT 20""")
def _(t):
    return templates.key_columns(t.customer, "c_custkey")


@query("recent_rows", "P8", """
SELECT * REPLACE (o_orderdate::VARCHAR AS o_orderdate) FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY o_orderkey LIMIT 100""")
def _(t):
    return templates.recent_rows(t.orders, "1998-01-01").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("sample_query_predicates", "P13", """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
WHERE o_totalprice >= 5000 AND o_orderstatus = 'O' AND o_custkey BETWEEN 10 AND 400
  AND abs(o_totalprice - 150000) > 25000""")
def _(t):
    return rel.select_rows(
        t.orders, ["o_orderkey", "o_totalprice", "o_orderstatus"],
        ["o_totalprice >= 5000", "o_orderstatus = 'O'", "o_custkey BETWEEN 10 AND 400",
         "abs(o_totalprice - 150000) > 25000"],
    )


# ---- joins -------------------------------------------------------------------------------------

@query("join_three_resources", "J1", """
SELECT a.c_name, b.o_orderkey, c.l_linenumber, c.l_extendedprice FROM customer a
JOIN orders b ON a.c_custkey = b.o_custkey JOIN lineitem c ON b.o_orderkey = c.l_orderkey
WHERE b.o_totalprice > 200000""")
def _(t):
    return rel.join_resources(
        {"a": t.customer, "b": t.orders, "c": t.lineitem},
        ["a.c_custkey = b.o_custkey", "b.o_orderkey = c.l_orderkey"],
        ["a.c_name", "b.o_orderkey", "c.l_linenumber", "c.l_extendedprice"], "b.o_totalprice > 200000",
    )


@query("join_key_and_band", "J2", """
SELECT a.l_orderkey, a.l_linenumber, b.p_partkey, a.l_extendedprice FROM lineitem a JOIN part b
ON a.l_partkey = b.p_partkey AND a.l_extendedprice BETWEEN b.p_retailprice * 10 AND b.p_retailprice * 30""")
def _(t):
    return rel.join_resources(
        {"a": t.lineitem, "b": t.part},
        ["a.l_partkey = b.p_partkey AND a.l_extendedprice BETWEEN b.p_retailprice * 10 AND b.p_retailprice * 30"],
        ["a.l_orderkey", "a.l_linenumber", "b.p_partkey", "a.l_extendedprice"],
    )


@query("join_types", "J4", """
SELECT 'inner' AS how, count(*) AS n, count(c_custkey) AS with_customer, count(o_orderkey) AS with_order
FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000
UNION ALL SELECT 'left', count(*), count(c_custkey), count(o_orderkey)
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000
UNION ALL SELECT 'right', count(*), count(c_custkey), count(o_orderkey)
FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000
UNION ALL SELECT 'outer', count(*), count(c_custkey), count(o_orderkey)
FROM customer FULL JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000""")
def _(t):
    parts = []
    for how in ("inner", "left", "right", "outer"):
        joined = rel.join_resources(
            {"a": t.customer, "b": t.orders}, ["a.c_custkey = b.o_custkey AND b.o_totalprice > 300000"],
            ["a.c_custkey", "b.o_orderkey"], how=how,
        )
        parts.append(joined.agg(
            F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("with_customer"),
            F.count("o_orderkey").alias("with_order"),
        ).withColumn("how", F.lit(how)))
    return rel.union_aligned(*parts)


@query("semi_join_live_resources", "J5", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(t):
    live = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return rel.keep_matching(t.orders, live, "o_custkey = c_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("star_join_category_totals", "J6, P13", """
SELECT p_type, count(*) AS total_sales, round(sum(l_extendedprice), 4) AS total_revenue,
  round(avg(l_extendedprice), 4) AS avg_sale_amount
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY p_type ORDER BY total_revenue DESC""")
def _(t):
    joined = rel.join_resources(
        {"s": t.lineitem, "p": t.part, "o": t.orders},
        ["s.l_partkey = p.p_partkey", "s.l_orderkey = o.o_orderkey"],
        ["p.p_type", "s.l_extendedprice"], "o.o_orderdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00'",
    )
    return rel.aggregate(joined, ["p_type"], {
        "total_sales": "count(1)", "total_revenue": "round(sum(l_extendedprice), 4)",
        "avg_sale_amount": "round(avg(l_extendedprice), 4)",
    }).orderBy(F.desc("total_revenue"))


@query("coalesce_overlapping_sources", "J9", """
SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey, coalesce(l.c_name, r.c_name) AS c_name,
  coalesce(l.balance, r.balance) AS balance
FROM (SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer
      WHERE c_mktsegment <> 'BUILDING') l
FULL JOIN (SELECT c_custkey, upper(c_name) AS c_name, -1.0 * c_nationkey AS balance FROM customer
      WHERE c_mktsegment <> 'MACHINERY') r ON l.c_custkey = r.c_custkey""")
def _(t):
    left = t.customer.where("c_mktsegment <> 'BUILDING'").selectExpr(
        "c_custkey", "c_name", "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance")
    right = t.customer.where("c_mktsegment <> 'MACHINERY'").selectExpr(
        "c_custkey", "upper(c_name) AS c_name", "-1.0D * c_nationkey AS balance")
    return rel.coalesce_sources(left, right, "c_custkey")


@query("revenue_per_segment", "S3, J1, A1, L3", """
SELECT c_mktsegment, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY c_mktsegment ORDER BY revenue DESC""")
def revenue_per_segment(t):
    # Lines are summed per order first, so the distinct order count needs no second shuffle of lines.
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("net"))
    joined = rel.join_resources(
        {"c": t.customer, "o": t.orders, "l": lines}, ["c.c_custkey = o.o_custkey", "o.o_orderkey = l.l_orderkey"],
        ["c.c_mktsegment", "l.net"],
    )
    return rel.aggregate(
        joined, ["c_mktsegment"], {"orders": "count(1)", "revenue": "round(sum(net), 4)"}
    ).orderBy(F.desc("revenue"))


# ---- aggregates --------------------------------------------------------------------------------

@query("group_where_having", "A1", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_price,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus HAVING n > 100""")
def _(t):
    return rel.aggregate(
        t.lineitem, ["l_returnflag", "l_linestatus"],
        {"sum_qty": "sum(l_quantity)", "sum_price": "round(sum(l_extendedprice), 4)",
         "avg_disc": "round(avg(l_discount), 6)", "n": "count(1)"},
        ["l_shipdate <= TIMESTAMP_NTZ '2000-09-02 00:00:00'"], ["n > 100"],
    )


@query("default_aggregate", "A2", """
SELECT o_orderstatus, count(*) AS count, round(avg(o_totalprice), 4) AS avg_o_totalprice,
  round(sum(o_totalprice), 4) AS total_o_totalprice FROM orders GROUP BY o_orderstatus ORDER BY count DESC LIMIT 10""")
def _(t):
    return templates.default_aggregate(t.orders).withColumns(
        {c: F.round(c, 4) for c in ("avg_o_totalprice", "total_o_totalprice")})


@query("average_per_group", "A3", """
SELECT p_type, round(avg(p_retailprice), 6) AS avg_p_retailprice FROM part GROUP BY p_type""")
def _(t):
    return templates.average_per_group(t.part).withColumn("avg_p_retailprice", F.round("avg_p_retailprice", 6))


@query("count_per_group", "A4", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def _(t):
    return templates.count_per_group(t.events)


@query("sum_per_group", "A5", """
SELECT o_orderstatus, round(sum(o_totalprice), 4) AS total_o_totalprice FROM orders GROUP BY o_orderstatus""")
def _(t):
    return templates.sum_per_group(t.orders).withColumn("total_o_totalprice", F.round("total_o_totalprice", 4))


@query("count_with_preview", "A6", """
SELECT l_orderkey, l_linenumber, l_partkey, (SELECT count(*) FROM lineitem WHERE l_quantity > 25) AS total_rows
FROM lineitem WHERE l_quantity > 25 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100""")
def _(t):
    rows = t.lineitem.where("l_quantity > 25")
    total = rows.agg(F.count(F.lit(1))).scalar()
    preview = rows.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(100)
    return preview.select("l_orderkey", "l_linenumber", "l_partkey", total.alias("total_rows"))


@query("conditional_rate", "A7", """
SELECT l_linestatus, count(*) AS total, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned,
  round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 2)::DOUBLE AS return_rate
FROM lineitem GROUP BY l_linestatus""")
def _(t):
    return rel.aggregate(t.lineitem, ["l_linestatus"], {
        "total": "count(1)", "returned": "sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)",
        "return_rate": "round(100.0D * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(1), 2)",
    })


BAND = "CASE WHEN p_size < 15 THEN 'small' WHEN p_size BETWEEN 15 AND 30 THEN 'medium' ELSE 'large' END"


@query("banded_group", "A8", f"""
SELECT {BAND} AS size_band, p_type, count(*) AS parts, round(avg(p_retailprice), 6) AS avg_price
FROM part GROUP BY ALL""")
def _(t):
    banded = t.part.withColumn("size_band", F.expr(BAND))
    return rel.aggregate(banded, ["size_band", "p_type"],
                         {"parts": "count(1)", "avg_price": "round(avg(p_retailprice), 6)"})


@query("min_max_avg_panel", "A9", """
SELECT s_nationkey, count(*) AS n, min(s_acctbal) AS low, max(s_acctbal) AS high, round(avg(s_acctbal), 6) AS mean,
  round(sum(s_acctbal), 4) AS total FROM supplier GROUP BY s_nationkey""")
def _(t):
    return rel.aggregate(t.supplier, ["s_nationkey"], {
        "n": "count(1)", "low": "min(s_acctbal)", "high": "max(s_acctbal)", "mean": "round(avg(s_acctbal), 6)",
        "total": "round(sum(s_acctbal), 4)"})


# ---- sort, top-k, paging, sets -----------------------------------------------------------------

@query("order_all_rows", "L1", """
SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey""")
def _(t):
    return rel.select_rows(t.customer, ["c_custkey", "c_mktsegment", "c_acctbal"],
                           order_by=["c_mktsegment", "c_acctbal desc", "c_custkey"])


@query("top_rows_by_measure", "L3", """
SELECT p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def _(t):
    return templates.top_rows(t.part, "p_partkey")


@query("newest_first", "L4", """
SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def _(t):
    return rel.select_rows(t.events, ["event_id", "user_id", "event_type"],
                           order_by=["ts desc", "event_id desc"], limit=100)


@query("order_by_expression", "L5", """
SELECT s_suppkey, s_acctbal FROM supplier WHERE abs(s_acctbal) > 500 ORDER BY abs(s_acctbal) DESC, s_suppkey""")
def _(t):
    return rel.select_rows(t.supplier, ["s_suppkey", "s_acctbal"], ["abs(s_acctbal) > 500"],
                           ["abs(s_acctbal) desc", "s_suppkey"])


@query("keyset_page", "L6", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200""")
def _(t):
    return rel.keyset_page(t.orders, "o_orderkey", 500, 200).select("o_orderkey", "o_totalprice")


@query("result_batches", "S17", """
SELECT batch, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key,
  batch = max(batch) OVER () AS is_final FROM (
  SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders) GROUP BY batch""")
def _(t):
    placed = ordered.with_position(t.orders.select("o_orderkey"), "o_orderkey", [], "position", 4096)
    batches = placed.groupBy(F.floor((F.col("position") - 1) / 1000).alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))
    last = t.orders.agg(F.floor((F.count(F.lit(1)) - 1) / 1000)).scalar()
    return batches.withColumn("is_final", F.col("batch") == last)


@query("union_distinct", "U1", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 1000
UNION SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey < 12""")
def _(t):
    columns = ["c_custkey", "c_mktsegment"]
    return rel.union_distinct(t.customer.where("c_acctbal > 1000").select(*columns),
                              t.customer.where("c_nationkey < 12").select(*columns))


@query("union_all_aligned", "U2", """
SELECT o_orderkey, o_totalprice, o_orderpriority, NULL::VARCHAR AS o_orderstatus FROM orders
WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_totalprice, NULL, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'""")
def _(t):
    return rel.union_aligned(
        t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice", "o_orderpriority"),
        t.orders.where("o_orderstatus <> 'O'").select("o_orderkey", "o_totalprice", "o_orderstatus"),
    )


@query("distinct_values", "U3", "SELECT DISTINCT p_type, p_brand FROM part")
def _(t):
    return t.part.select("p_type", "p_brand").dropDuplicates()


# ---- windows -----------------------------------------------------------------------------------

@query("previous_value_per_series", "W1", """
SELECT event_id, event_type, value, lag(value) OVER w AS previous, round(value - lag(value) OVER w, 6) AS difference
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def _(t):
    events = t.events.select("event_id", "event_type", "ts", "value")
    lagged = ordered.with_previous(events, ["event_type"], "ts", {"previous": "value"}, 3600, ["event_id"])
    return lagged.select("event_id", "event_type", "value", "previous",
                         F.round(F.col("value") - F.col("previous"), 6).alias("difference"))


@query("latest_version", "W2", """
SELECT o_custkey, o_orderkey AS version, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def _(t):
    versions = t.orders.select("o_custkey", F.col("o_orderkey").alias("version"), "o_totalprice")
    return rel.latest_per_key(versions, ["o_custkey"], "version")


@query("top_lines_per_order", "W3", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) <= 3""")
def _(t):
    top = rel.top_per_group(t.lineitem, ["l_orderkey"],
                            ["l_extendedprice desc", "l_linenumber", "l_partkey", "l_suppkey"], 3)
    return top.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("requests_last_minute", "W5", """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000
  RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def _(t):
    events = t.events.select("event_id", "user_id", "ts")
    return ordered.with_trailing_count(events, ["user_id"], "ts", 60, "recent").select("event_id", "user_id", "recent")


@query("requests_last_day", "W5", """
SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000
  RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def _(t):
    events = t.events.select("event_id", "event_type", "ts")
    counted = ordered.with_trailing_count(events, ["event_type"], "ts", 86400, "recent")
    return counted.select("event_id", "event_type", "recent")


SMART = {
    "smart_average": ("What is the average price of each part type?", """
SELECT p_type, round(avg(p_retailprice), 4) AS avg_p_retailprice FROM part GROUP BY p_type"""),
    "smart_count": ("How many orders by status are there?", """
SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderstatus"""),
    "smart_top": ("Top part by price", """
SELECT p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10"""),
    "smart_sum": ("total of orders totalprice per status", """
SELECT o_orderstatus, round(sum(o_totalprice), 4) AS total_o_totalprice FROM orders GROUP BY o_orderstatus"""),
    "smart_general": ("describe the customer list", """
SELECT c_name FROM customer ORDER BY c_custkey LIMIT 20"""),
}


def _smart(question):
    def build(t):
        tables = {"part": t.part, "orders": t.orders, "customer": t.customer}
        keys = {"part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey"}
        result = templates.answer(question, tables, keys)
        rounded = [c for c, kind in result.dtypes if kind == "double" and c != "p_retailprice"]
        return result.withColumns({c: F.round(c, 4) for c in rounded})
    return build


for _name, (_question, _sql) in SMART.items():
    query(_name, "H14", _sql)(_smart(_question))
