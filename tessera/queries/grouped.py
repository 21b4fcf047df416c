"""Aggregations, pivots, roll-ups, time buckets."""

from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators.predicates import key_statistics
from tessera.queries.registry import query
from tessera.queries.tables import Tables, sql


@query("agg_sum_filtered", "SELECT count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def agg_sum_filtered(spark, d):
    l = Tables(spark, d).lineitem.filter("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")  # noqa: E741
    return l.agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("agg_count", "SELECT count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS big FROM events")
def agg_count(spark, d):
    return Tables(spark, d).events.agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("big"))


@query("agg_group", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def agg_group(spark, d):
    l = Tables(spark, d).lineitem.filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("agg_group_ordinal", "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_group_ordinal(spark, d):
    return sql(spark, d, "SELECT year(o_orderdate)::bigint AS y, o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1, 2")


@query("agg_group_all", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY ALL")
def agg_group_all(spark, d):
    return sql(spark, d, "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM {customer} GROUP BY ALL")


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND sum(o_totalprice) <> 0")
def agg_having(spark, d):
    o = Tables(spark, d).orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return o.filter("n >= 12 AND s <> 0").drop("s")


@query("agg_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY event_type")
def agg_count_distinct(spark, d):
    return Tables(spark, d).events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("agg_approx_distinct", "SELECT count(DISTINCT o_custkey) AS exact, true AS near FROM orders")
def agg_approx_distinct(spark, d):
    o = Tables(spark, d).orders.select("o_custkey")
    # asked at once, the plan would keep a sketch for each distinct key
    o = o.agg(F.count_distinct("o_custkey").alias("exact")).join(o.agg(F.approx_count_distinct("o_custkey", 0.02).alias("a")))
    return o.select("exact", (F.abs(F.col("a") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@query("agg_median", "SELECT o_orderpriority, median(o_totalprice) AS mid FROM orders GROUP BY o_orderpriority")
def agg_median(spark, d):
    return A.quantiles(Tables(spark, d).orders, ["o_orderpriority"], "o_totalprice", {"mid": 0.5})


@query("agg_quantile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10 FROM lineitem GROUP BY l_returnflag")
def agg_quantile(spark, d):
    both = A.quantiles(Tables(spark, d).lineitem, ["l_returnflag"], "l_extendedprice", {"p95": 0.95, "p10": 0.1})
    return both.select("l_returnflag", F.round("p95", 4).alias("p95"), F.round("p10", 4).alias("p10"))


@query("agg_quantile_by_ranges", "SELECT l_shipmode, round(quantile_cont(l_quantity, 0.25), 4) AS q25, round(median(l_extendedprice), 4) AS mid, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 'x' ELSE l_returnflag END AS l_shipmode FROM lineitem) GROUP BY 1")
def agg_quantile_by_ranges(spark, d):
    """The way of large tables, whatever the size."""
    l = Tables(spark, d).lineitem.withColumn("l_shipmode", F.when(F.col("l_suppkey") % 3 == 0, "x").otherwise(F.col("l_returnflag")))  # noqa: E741
    a = A.quantiles(l, ["l_shipmode"], "l_quantity", {"q25": 0.25}, kept=0)
    b = A.quantiles(l, ["l_shipmode"], "l_extendedprice", {"mid": 0.5, "p99": 0.99}, kept=0)
    return a.join(b, "l_shipmode").select("l_shipmode", *[F.round(c, 4).alias(c) for c in ("q25", "mid", "p99")])


@query("agg_latest_per_user", "SELECT user_id, arg_max(v, (ts, event_id)) AS v FROM (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY user_id")
def agg_latest_per_user(spark, d):
    e = Tables(spark, d).events.select("user_id", "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return A.latest(e, ["user_id"], ["ts", "event_id"], "v")


@query("agg_filter_clause", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS spent FROM events GROUP BY user_id")
def agg_filter_clause(spark, d):
    return sql(spark, d, "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS spent FROM {events} GROUP BY user_id")


_KINDS = ["click", "error", "purchase", "signup", "view"]
_CELLS = ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in _KINDS)


@query("pivot_discovered", f"SELECT user_id, {_CELLS} FROM events GROUP BY user_id")
def pivot_discovered(spark, d):
    return A.pivot(Tables(spark, d).events, ["user_id"], "event_type", {"n": F.count("*")})


_PAIRS = ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}_n\", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS \"{s}_total\"" for s in "FO")


@query("pivot_in_list_multi", f"SELECT o_orderpriority, {_PAIRS} FROM orders GROUP BY o_orderpriority")
def pivot_in_list_multi(spark, d):
    out = A.pivot(Tables(spark, d).orders, ["o_orderpriority"], "o_orderstatus", {"n": F.count("*"), "total": F.sum("o_totalprice")}, ["F", "O"])
    return out.withColumns({c: F.round(c, 2) for c in ("F_total", "O_total")})


@query("pivot_sql", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY o_orderpriority")
def pivot_sql(spark, d):
    out = sql(spark, d, "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM {orders}) PIVOT (count(1) FOR o_orderstatus IN ('F', 'O'))")
    return out.fillna(0)


_YEARS = range(1995, 2002)


@query("pivot_year", "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (WHERE year(o_orderdate) = {y}) AS y{y}" for y in _YEARS) + " FROM orders GROUP BY o_orderstatus")
def pivot_year(spark, d):
    out = A.pivot(Tables(spark, d).orders, ["o_orderstatus"], F.year("o_orderdate"), {"n": F.count("*")}, list(_YEARS))
    return out.withColumnsRenamed({str(y): f"y{y}" for y in _YEARS})


@query("pivot_conditional", "SELECT year(o_orderdate) AS y, " + ", ".join(f"round(sum(CASE WHEN month(o_orderdate) = {m} THEN o_totalprice END), 2) AS m{m}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
def pivot_conditional(spark, d):
    o = Tables(spark, d).orders.withColumns({"y": F.year("o_orderdate").cast("long"), "m": F.month("o_orderdate")})
    out = o.groupBy("y").agg(*A.conditional_sums(["y"], "m", "o_totalprice", list(range(1, 13))))
    return out.select("y", *[F.round(F.col(str(m)), 2).alias(f"m{m}") for m in range(1, 13)])


@query("unpivot_charges", "SELECT l_orderkey, l_linenumber, 'l_discount' AS charge, l_discount AS rate FROM lineitem WHERE l_discount > 0.02 UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem WHERE l_tax > 0.02")
def unpivot_charges(spark, d):
    l = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", *[F.when(F.col(c) > 0.02, F.col(c)).alias(c) for c in ("l_discount", "l_tax")])  # noqa: E741
    return A.unpivot(l, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "charge", "rate")


@query("family_mean", "SELECT l_returnflag, round(avg(l_discount), 6) AS avg_l_discount, round(avg(l_tax), 6) AS avg_l_tax FROM lineitem GROUP BY l_returnflag")
def family_mean(spark, d):
    l = Tables(spark, d).lineitem  # noqa: E741
    return l.groupBy("l_returnflag").agg(*[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in A.family(l, "l_(discount|tax)")])


@query("summarize", "SELECT 's_suppkey' AS column_name, count(*) AS n, min(s_suppkey)::VARCHAR AS lo, max(s_suppkey)::VARCHAR AS hi, round(avg(s_suppkey), 4) AS mean, 0.0::DOUBLE AS nulls FROM supplier UNION ALL SELECT 's_name', count(*), min(s_name), max(s_name), NULL, 0.0 FROM supplier UNION ALL SELECT 's_nationkey', count(*), min(s_nationkey)::VARCHAR, max(s_nationkey)::VARCHAR, round(avg(s_nationkey), 4), 0.0 FROM supplier")
def summarize(spark, d):
    out = A.summarize(Tables(spark, d).supplier.drop("s_acctbal"))
    return out.select("column_name", F.col("count").alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.round("avg", 4).alias("mean"), F.col("null_percentage").cast("double").alias("nulls"))


@query("rollup_additive", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_quantity) / count(*), 6) AS avg_quantity FROM lineitem GROUP BY l_returnflag")
def rollup_additive(spark, d):
    roll = A.rollup_of(Tables(spark, d).lineitem, ["l_returnflag", "l_linestatus", "l_suppkey"], {"quantity": "l_quantity"})
    out = A.from_rollup(roll, ["l_returnflag"], ["quantity"])
    return out.withColumns({"quantity": F.round("quantity", 2), "avg_quantity": F.round("avg_quantity", 6)})


@query("cube_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(spark, d):
    return Tables(spark, d).orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("time_bucket_hour", "SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def time_bucket_hour(spark, d):
    e = Tables(spark, d).events
    return e.groupBy("user_id", A.time_bucket("ts", "1 hour").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("time_bucket_quarter", "SELECT time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS slot, count(*) AS n FROM events GROUP BY ALL")
def time_bucket_quarter(spark, d):
    return Tables(spark, d).events.groupBy(A.time_bucket("ts", "15 minutes").alias("slot")).agg(F.count("*").alias("n"))


@query("time_trunc_minute", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def time_trunc_minute(spark, d):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return Tables(spark, d).orders.groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("last_window_avg", "SELECT user_id, round(avg(value), 6) AS avg_value, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY user_id")
def last_window_avg(spark, d):
    return A.last_window(Tables(spark, d).events, ["user_id"], "ts", "value", "24 HOURS").withColumn("avg_value", F.round("avg_value", 6))


@query("key_statistics", "SELECT p_size, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20 GROUP BY p_size")
def keys_counted(spark, d):
    return key_statistics(Tables(spark, d).part, "p_size", 10, 20, descending=True)


@query("audit_totals", "SELECT o_custkey % 10 AS refresh, count(*) AS n, round(sum(abs(o_totalprice - 100000)), 2) AS moved FROM orders GROUP BY 1")
def audit_totals(spark, d):
    return Tables(spark, d).orders.groupBy((F.col("o_custkey") % 10).alias("refresh")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs(F.col("o_totalprice") - 100000)), 2).alias("moved"))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS window_start, (time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR)::TIMESTAMP AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    from tessera.streaming.tail import windowed

    out = windowed(Tables(spark, d).events, "ts", "6 hours", by=["event_type"], value="value")
    return out.withColumn("total", F.round("sum_value", 2)).drop("sum_value")


@query("session_windows", "SELECT user_id, min(ts) AS first, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark, d):
    from tessera.streaming.tail import sessions

    return sessions(Tables(spark, d).events, "ts", "2 hours", ["user_id"]).select("user_id", F.col("session_start").alias("first"), "n")
