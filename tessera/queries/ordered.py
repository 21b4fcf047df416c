"""Windows, order, paging, vectors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.aggregates import first_per_key
from tessera.operators.ordering import ascending, declared, descending, numbered
from tessera.operators.paging import Pages
from tessera.operators.vector import Metric, VectorSearch
from tessera.queries.registry import query
from tessera.queries.tables import Tables, sql

_REVENUE = "SELECT n_name, year(o_orderdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"


def _revenue(spark, d):
    """Revenue by nation and year: lines are added up by order before they meet the other tables."""
    t = Tables(spark, d)
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    met = t.orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return met.groupBy("n_name", F.year("o_orderdate").cast("long").alias("y")).agg(F.round(F.sum("r"), 4).alias("revenue"))


@query("topn_per_group", f"SELECT * FROM (SELECT n_name, y, revenue, rank() OVER (PARTITION BY y ORDER BY revenue DESC) AS place FROM ({_REVENUE})) WHERE place <= 5")
def topn_per_group(spark, d):
    place = F.rank().over(Window.partitionBy("y").orderBy(F.col("revenue").desc())).cast("long")
    return _revenue(spark, d).withColumn("place", place).filter("place <= 5")


@query("latest_by_row_number", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_by_row_number(spark, d):
    return first_per_key(Tables(spark, d).events, ["user_id", "event_type"], descending("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query("qualify_top", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def qualify_top(spark, d):
    return first_per_key(Tables(spark, d).part, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "p_retailprice")


@query("rank_of_rollup", "SELECT p_brand, total, rank() OVER (ORDER BY total DESC) AS place FROM (SELECT p_brand, round(sum(q), 2) AS total FROM (SELECT p_brand, p_size, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY p_brand)")
def rank_of_rollup(spark, d):
    t = Tables(spark, d)
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    roll = per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_size").agg(F.sum("q").alias("q"))
    totals = roll.groupBy("p_brand").agg(F.round(F.sum("q"), 2).alias("total"))  # one row per brand
    return totals.withColumn("place", F.rank().over(Window.orderBy(F.col("total").desc())).cast("long"))


@query("running_total", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS so_far, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events")
def running_total(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return Tables(spark, d).events.select("event_id", "user_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("so_far"), (F.col("value") - F.lag("value").over(w)).alias("step"))


@query("sort_declared_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey) - 1 AS position FROM orders")
def sort_declared_order(spark, d):
    order = [*declared("o_orderpriority", ["5-LOW", "1-URGENT"]), F.col("o_orderkey")]
    return numbered(Tables(spark, d).orders.select("o_orderkey", "o_orderpriority"), order).select("o_orderkey", "position")


@query("sort_nulls_last", "SELECT event_id, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) - 1 AS position FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN value END AS v FROM events)")
def sort_nulls_last(spark, d):
    e = Tables(spark, d).events.select("event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return numbered(e, [*descending("v"), *ascending("event_id")]).select("event_id", "position")


@query("topk_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_rows(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 100")
def limit_offset(spark, d):
    return sql(spark, d, "SELECT o_orderkey FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 100")


def _pages(spark, d):
    return Pages(Tables(spark, d).orders.select("o_orderdate", "o_orderkey", "o_totalprice"), ["o_orderdate", "o_orderkey"], 25)


_AT = "(SELECT o_orderdate AS k1, o_orderkey AS k2 FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1 OFFSET 500)"


def _key(spark, d):
    return tuple(_pages(spark, d).df.orderBy("o_orderdate", "o_orderkey").offset(500).limit(1).collect()[0])[:2]


@query("page_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def page_first(spark, d):
    return _pages(spark, d).after_df(None, 25).select("o_orderkey", "o_totalprice")


@query("page_last", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def page_last(spark, d):
    return _pages(spark, d).before_df(None, 25).select("o_orderkey", "o_totalprice")


@query("page_after", f"SELECT o_orderkey FROM orders, {_AT} WHERE (o_orderdate, o_orderkey) > (k1, k2) ORDER BY o_orderdate, o_orderkey LIMIT 25")
def page_after(spark, d):
    return _pages(spark, d).after_df(_key(spark, d), 25).select("o_orderkey")


@query("page_before", f"SELECT o_orderkey FROM orders, {_AT} WHERE (o_orderdate, o_orderkey) < (k1, k2) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def page_before(spark, d):
    return _pages(spark, d).before_df(_key(spark, d), 25).select("o_orderkey")


@query("page_around", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 11 OFFSET 495")
def page_around(spark, d):
    page = _pages(spark, d).around(_key(spark, d), 5)
    return spark.createDataFrame([(r["o_orderkey"],) for r in page.rows], "o_orderkey long")


@query("page_at", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 750")
def page_at(spark, d):
    return spark.createDataFrame([(r["o_orderkey"],) for r in _pages(spark, d).at(750).rows], "o_orderkey long")


@query("page_position", "SELECT 500::BIGINT AS position, count(*) AS n FROM orders")
def page_position(spark, d):
    pages = _pages(spark, d)
    return spark.createDataFrame([(pages.position(_key(spark, d)), pages.count())], "position long, n long")


def _nearest(spark, d, metric):
    e = Tables(spark, d).embeddings
    query = e.filter("vec_id = 0").first()["embedding"]
    found = VectorSearch(e, "embedding", "vec_id", metric).top_k(list(query), 10, F.col("vec_id") != 0)
    return found.withColumn("score", F.round("score", 4))


def _oracle(score: str, order: str) -> str:
    return f"SELECT e.vec_id, round(({score})::DOUBLE, 4) AS score FROM embeddings e, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) WHERE e.vec_id <> 0 ORDER BY {score} {order}, e.vec_id LIMIT 10"


@query("vector_topk_cosine", _oracle("list_cosine_similarity(e.embedding::DOUBLE[], q)", "DESC"))
def vector_topk_cosine(spark, d):
    return _nearest(spark, d, Metric.COSINE)


@query("vector_topk_euclid", _oracle("list_distance(e.embedding::DOUBLE[], q)", "ASC"))
def vector_topk_euclid(spark, d):
    return _nearest(spark, d, Metric.EUCLIDEAN)


@query("vector_topk_inner", _oracle("list_inner_product(e.embedding::DOUBLE[], q)", "DESC"))
def vector_topk_inner(spark, d):
    return _nearest(spark, d, Metric.INNER_PRODUCT)


@query("vector_topk_filtered", "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q)::DOUBLE, 4) AS score FROM embeddings e, (SELECT embedding::DOUBLE[] AS q, label AS l FROM embeddings WHERE vec_id = 0) WHERE e.vec_id <> 0 AND label = l ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q) DESC, e.vec_id LIMIT 5")
def vector_topk_filtered(spark, d):
    e = Tables(spark, d).embeddings
    q = e.filter("vec_id = 0").first()
    found = VectorSearch(e, "embedding", "vec_id").top_k(list(q["embedding"]), 5, (F.col("vec_id") != 0) & (F.col("label") == q["label"]))
    return found.withColumn("score", F.round("score", 4))
