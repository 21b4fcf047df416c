"""Joins."""

from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import predicates as P
from tessera.queries.registry import query
from tessera.queries.tables import Tables, sql


@query("join_pairs", "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 200000")
def join_pairs(spark, d):
    t = Tables(spark, d)
    pairs = J.pairs(t.customer, t.orders, "c_custkey", "o_custkey", P.Equal("c_mktsegment", "BUILDING"), P.GreaterThan("o_totalprice", 200000.0))
    return pairs.select("left.c_custkey", "left.c_name", "right.o_orderkey", "right.o_totalprice")


@query("join_count", "SELECT count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey")
def join_count(spark, d):
    t = Tables(spark, d)
    return J.pairs(t.customer, t.orders, "c_custkey", "o_custkey").agg(F.count("*").alias("n"))


@query("join_multivalue", "SELECT u.user_id, k.event_type AS kind, k.n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 100) u JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) k ON u.event_type = k.event_type")
def join_multivalue(spark, d):
    e = Tables(spark, d).events
    users = e.filter("value > 100").groupBy("user_id").agg(F.collect_list("event_type").alias("kinds"))
    kinds = e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return J.pairs(users, kinds, "kinds", "kind").select("left.user_id", "right.kind", "right.n")


@query("join_using_three", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL")
def join_using_three(spark, d):
    t = Tables(spark, d)
    return t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


@query("semi_exists_in", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
def semi_exists_in(spark, d):
    t = Tables(spark, d)
    return P.select(t.customer, P.ExistsIn(t.orders, "c_custkey", "o_custkey", P.GreaterThan("o_totalprice", 250000.0))).select("c_custkey")


@query("anti_exists_in", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti_exists_in(spark, d):
    t = Tables(spark, d)
    return P.select(t.customer, ~P.ExistsIn(t.orders, "c_custkey", "o_custkey")).select("c_custkey")


@query("semi_nested", "SELECT c_custkey FROM customer c WHERE (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') OR c_acctbal < 0) AND NOT (c_nationkey = 1 AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey))")
def semi_nested(spark, d):
    t = Tables(spark, d)
    p = (P.ExistsIn(t.orders, "c_custkey", "o_custkey", P.Equal("o_orderstatus", "P")) | P.LessThan("c_acctbal", 0.0)) & ~(P.Equal("c_nationkey", 1) & P.ExistsIn(t.supplier, "c_nationkey", "s_nationkey"))
    return P.select(t.customer, p).select("c_custkey")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
def join_left(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders.filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_full_diff", "SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, c_nationkey + (c_custkey % 2)::INTEGER AS v FROM customer WHERE c_custkey % 5 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def join_full_diff(spark, d):
    c = Tables(spark, d).customer
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    new = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") + (F.col("c_custkey") % 2).cast("int")).alias("v"))
    return J.differences(old, new, ["k"], "v")


@query("anti_changed_rows", "SELECT b.k, b.v FROM (SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS v FROM part) b WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size END AS v FROM part) a WHERE a.k = b.k AND a.v IS NOT DISTINCT FROM b.v)")
def anti_changed_rows(spark, d):
    p = Tables(spark, d).part
    state = lambda m: p.select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % m != 0, F.col("p_size")).alias("v"))
    return J.changed_rows(state(2), state(4), ["k"], "v")


_RATES = "(VALUES ('F', 'EUR', 0.9::DOUBLE), ('O', 'EUR', 1.1::DOUBLE), ('O', 'USD', 1.0::DOUBLE)) r(unit, to_unit, factor)"


@query("join_rates", f"SELECT o_custkey, round(sum(o_totalprice * factor), 4) AS total FROM orders JOIN {_RATES} ON o_orderstatus = unit AND to_unit = 'EUR' GROUP BY o_custkey")
def join_rates(spark, d):
    rates = spark.createDataFrame([("F", "EUR", 0.9), ("O", "EUR", 1.1), ("O", "USD", 1.0)], "unit string, to_unit string, factor double")
    return J.converted(Tables(spark, d).orders, rates, "o_orderstatus", "EUR", "o_totalprice").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("total"))


@query("aggregate_then_join", "SELECT p_brand, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def aggregate_then_join(spark, d):
    t = Tables(spark, d)
    return J.aggregate_then_join(t.lineitem, "l_partkey", "l_quantity", t.part.select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


_VIEWS = "(SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'view')"
_BUYS = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')"


def _sides(spark, d):
    e = Tables(spark, d).events
    return e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", "value", F.col("event_id").alias("view_id"))


@query("asof_inner_totals", f"SELECT count(*) AS n, round(sum(v.value), 2) AS total FROM {_BUYS} p ASOF JOIN {_VIEWS} v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_inner_totals(spark, d):
    left, right = _sides(spark, d)
    return J.asof(left, right, ["user_id"], "ts", "ts", ["value"], tie=["view_id"]).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("asof_left_rows", f"SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value FROM {_BUYS} p ASOF LEFT JOIN {_VIEWS} v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_left_rows(spark, d):
    left, right = _sides(spark, d)
    return J.asof(left, right, ["user_id"], "ts", "ts", ["view_id", "value"], "left", tie=["view_id"]).select("event_id", "user_id", "view_id", "value")


@query("asof_hot_keys", f"SELECT p.event_id, v.event_id AS view_id FROM {_BUYS} p ASOF LEFT JOIN {_VIEWS} v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_hot_keys(spark, d):
    left, right = _sides(spark, d)
    return J.asof_salted(left, right, ["user_id"], "ts", "ts", ["view_id"], "1 day", "left", tie=["view_id"]).select("event_id", "view_id")


@query("join_cross", "SELECT r_name, o_orderpriority FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)")
def join_cross(spark, d):
    t = Tables(spark, d)
    return t.region.crossJoin(t.orders.select("o_orderpriority").distinct()).select("r_name", "o_orderpriority")


@query("join_next_line", "SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def join_next_line(spark, d):
    return sql(spark, d, "SELECT a.conv_id, a.turn, b.role AS next_role FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")


@query("join_semi_anti_sql", "SELECT s_suppkey, 'semi' AS kind FROM supplier SEMI JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 2 UNION ALL SELECT s_suppkey, 'anti' FROM supplier ANTI JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 2")
def join_semi_anti_sql(spark, d):
    return sql(spark, d, "SELECT s_suppkey, 'semi' AS kind FROM {supplier} LEFT SEMI JOIN {nation} ON s_nationkey = n_nationkey AND n_regionkey = 2 UNION ALL SELECT s_suppkey, 'anti' FROM {supplier} LEFT ANTI JOIN {nation} ON s_nationkey = n_nationkey AND n_regionkey = 2")


@query("share_of_total", "SELECT o_orderpriority, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share FROM orders GROUP BY o_orderpriority")
def share_of_total(spark, d):
    return sql(spark, d, "SELECT o_orderpriority, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM {orders}), 6) AS share FROM {orders} GROUP BY o_orderpriority")


@query("live_join", "SELECT c_custkey, t.tier FROM customer JOIN (VALUES ('BUILDING', 1::BIGINT), ('MACHINERY', 2::BIGINT)) t(segment, tier) ON c_mktsegment = segment")
def live_join(spark, d):
    from dataclasses import make_dataclass

    from tessera.layout import Layout
    from tessera.sources.live import LiveTable

    tier = make_dataclass("Tier", [("segment", str), ("tier", int)])
    live = LiveTable(spark, "tiers", lambda: [tier("BUILDING", 1), tier("MACHINERY", 2)], Layout.of(tier))
    return Tables(spark, d).customer.join(live.hinted(), F.col("c_mktsegment") == F.col("segment")).select("c_custkey", "tier")
