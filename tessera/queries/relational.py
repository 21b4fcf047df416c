"""Projections, predicates, set operations, scalar functions."""

from pyspark.sql import functions as F

from tessera.journal import all_words
from tessera.operators import predicates as P
from tessera.operators.aggregates import family, first_per_key, row_total
from tessera.operators.ordering import numbered
from tessera.queries.registry import query
from tessera.queries.tables import Tables, sql


@query("project_expressions", "SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS label, round(c_acctbal * 1.1, 4) AS raised, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low' ELSE 'high' END AS band FROM customer")
def project_expressions(spark, d):
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal").between(0, 1000), "low").otherwise("high")
    return Tables(spark, d).customer.select("c_custkey", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("label"), F.round(F.col("c_acctbal") * 1.1, 4).alias("raised"), band.alias("band"))


@query("sql_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def sql_parameters(spark, d):
    return sql(spark, d, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least", status="F", least=100000)


@query("from_first", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def from_first(spark, d):
    return sql(spark, d, "FROM {nation} SELECT n_regionkey, count(*) AS n GROUP BY n_regionkey")


@query("scan_path_in_from", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def scan_path_in_from(spark, d):
    return spark.sql(f"SELECT r_regionkey, r_name FROM parquet.`{d}/region.parquet` WHERE r_regionkey > 1")


@query("series", "SELECT i * i AS square, i % 7 AS rest FROM range(1000) t(i)")
def series(spark, d):
    return spark.range(1000).select((F.col("id") * F.col("id")).alias("square"), (F.col("id") % 7).alias("rest"))


@query("values_table", "SELECT * FROM (VALUES ('FOB', 1, 0.5::DOUBLE), ('AIR', 2, 1.5::DOUBLE), ('SHIP', 3, NULL)) t(mode, code, rate)")
def values_table(spark, d):
    return spark.sql("SELECT * FROM VALUES ('FOB', 1, 0.5D), ('AIR', 2, 1.5D), ('SHIP', 3, NULL) t(mode, code, rate)")


@query("pred_eq_in_range", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 100 AND c_acctbal < 5000 AND c_nationkey = 3")
def pred_eq_in_range(spark, d):
    p = P.In("c_mktsegment", ("BUILDING", "MACHINERY")) & P.Between("c_acctbal", 100, 5000, high_inclusive=False) & P.Equal("c_nationkey", 3)
    return P.select(Tables(spark, d).customer, p).select("c_custkey")


@query("pred_less_greater", "SELECT p_partkey FROM part WHERE p_size <= 10 AND p_size > 2 OR p_retailprice < 950 AND p_retailprice >= 910")
def pred_less_greater(spark, d):
    p = P.LessThan("p_size", 10, True) & P.GreaterThan("p_size", 2) | P.LessThan("p_retailprice", 950.0) & P.GreaterThan("p_retailprice", 910.0, True)
    return P.select(Tables(spark, d).part, p).select("p_partkey")


@query("pred_in_empty", "SELECT c_custkey FROM customer WHERE false")
def pred_in_empty(spark, d):
    return P.select(Tables(spark, d).customer, P.In("c_name", ())).select("c_custkey")


@query("pred_startswith", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S') AND p_type LIKE '%E%'")
def pred_startswith(spark, d):
    return P.select(Tables(spark, d).part, P.StartsWith("p_type", "S") & P.Contains("p_type", "E")).select("p_partkey", "p_type")


@query("pred_between_forms", "SELECT o_orderkey, (o_totalprice BETWEEN 1000 AND 50000) AS a, (o_totalprice > 1000 AND o_totalprice < 50000) AS b, (o_totalprice > 1000 AND o_totalprice <= 50000) AS c FROM orders")
def pred_between_forms(spark, d):
    o = Tables(spark, d).orders
    forms = {"a": P.Between("o_totalprice", 1000, 50000), "b": P.Between("o_totalprice", 1000, 50000, False, False), "c": P.Between("o_totalprice", 1000, 50000, False, True)}
    return o.select("o_orderkey", *[p.column(o).alias(n) for n, p in forms.items()])


@query("pred_has", "SELECT user_id, count(*) AS n FROM (SELECT user_id, CASE WHEN event_type = 'view' THEN value END AS v FROM events) WHERE v IS NOT NULL GROUP BY user_id")
def pred_has(spark, d):
    e = Tables(spark, d).events.select("user_id", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return P.select(e, P.Has("v")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("pred_not_null_rule", "SELECT event_id FROM events EXCEPT SELECT event_id FROM events WHERE CASE WHEN event_type = 'view' THEN value END > 50")
def pred_not_null_rule(spark, d):
    e = Tables(spark, d).events.select("event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return P.select(e, ~P.GreaterThan("v", 50)).select("event_id")


@query("pred_and_or_not", "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_brand = 'Brand#11') AND NOT (p_retailprice > 1500 AND p_size < 45)")
def pred_and_or_not(spark, d):
    p = P.And(P.Or(P.GreaterThan("p_size", 40), P.Equal("p_brand", "Brand#11")), P.Not(P.And(P.GreaterThan("p_retailprice", 1500.0), P.LessThan("p_size", 45))))
    return P.select(Tables(spark, d).part, p).select("p_partkey")


@query("pred_all_none", "SELECT s_suppkey FROM supplier")
def pred_all_none(spark, d):
    return P.select(Tables(spark, d).supplier, P.Or(P.All(), P.Nothing())).select("s_suppkey")


@query("pred_filter_function", "SELECT p_partkey FROM part WHERE length(p_name) % 3 = 0")
def pred_filter_function(spark, d):
    return P.select(Tables(spark, d).part, P.Filter("p_name", lambda v: len(v) % 3 == 0)).select("p_partkey")


@query("pred_multi_valued", "SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'signup')")
def pred_multi_valued(spark, d):
    users = Tables(spark, d).events.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return P.select(users, P.Equal("kinds", "signup")).select("user_id")


@query("null_safe_compare", "SELECT event_id FROM (SELECT event_id, CASE WHEN value > 50 THEN event_type END AS a, CASE WHEN value > 20 THEN event_type END AS b FROM events) WHERE a IS DISTINCT FROM b")
def null_safe_compare(spark, d):
    e = Tables(spark, d).events.select("event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("a"), F.when(F.col("value") > 20, F.col("event_type")).alias("b"))
    return e.filter(~F.col("a").eqNullSafe(F.col("b"))).select("event_id")


@query("like_escape", "SELECT p_partkey FROM part WHERE p_name ILIKE '%a%e%' AND p_brand LIKE 'Brand#1_' AND NOT p_name LIKE '%!%%' ESCAPE '!'")
def like_escape(spark, d):
    return sql(spark, d, "SELECT p_partkey FROM {part} WHERE p_name ILIKE '%a%e%' AND p_brand LIKE 'Brand#1_' AND NOT p_name LIKE '%!%%' ESCAPE '!'")


@query("regex_match", "SELECT c_custkey, regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1) AS number, regexp_replace(c_name, '[0-9]', 'x', 'g') AS masked FROM customer WHERE regexp_matches(c_name, '[13579]$')")
def regex_match(spark, d):
    c = Tables(spark, d).customer.filter(F.col("c_name").rlike("[13579]$"))
    return c.select("c_custkey", F.regexp_extract("c_name", "#0*([1-9][0-9]*)$", 1).alias("number"), F.regexp_replace("c_name", "[0-9]", "x").alias("masked"))


@query("regex_extract_all", "SELECT item_id, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n FROM benchmark")
def regex_extract_all(spark, d):
    return Tables(spark, d).benchmark.select("item_id", F.size(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1)).cast("long").alias("n"))


@query("in_subquery_exists", "SELECT n_name FROM nation n WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AND EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < 0)")
def in_subquery_exists(spark, d):
    return sql(spark, d, "SELECT n_name FROM {nation} n WHERE n_nationkey IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000) AND EXISTS (SELECT 1 FROM {customer} c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < 0)")


@query("select_columns_regex", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_quantity = 1")
def select_columns_regex(spark, d):
    l = Tables(spark, d).lineitem.filter("l_quantity = 1")  # noqa: E741
    return l.select(*family(l, "l_(order|line|ship)(key|number|date)"))


@query("exclude_columns", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def exclude_columns(spark, d):
    return Tables(spark, d).supplier.drop("s_nationkey")


@query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return Tables(spark, d).orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("distinct_on", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_on(spark, d):
    o = Tables(spark, d).orders
    return first_per_key(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("search_all_words", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%ion%' AND lower(text) LIKE '%license%'")
def search_all_words(spark, d):
    docs = Tables(spark, d).documents
    return docs.filter(all_words(["text"], "the ion LICENSE")).select("doc_id")


@query("search_any_column", "SELECT conv_id, turn FROM conversations WHERE (lower(text) LIKE '%the%' AND lower(text) LIKE '%a%') OR (lower(role) LIKE '%the%' AND lower(role) LIKE '%a%')")
def search_any_column(spark, d):
    c = Tables(spark, d).conversations
    return c.filter(all_words(["text", "role"], "the a")).select("conv_id", "turn")


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    t = Tables(spark, d)
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("set_union", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_union(spark, d):
    t = Tables(spark, d)
    return t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).union(t.supplier.filter("s_acctbal > 9000").select("s_nationkey")).distinct()


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    t = Tables(spark, d)
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("set_except_all", "SELECT l_linestatus FROM lineitem WHERE l_quantity < 10 EXCEPT ALL SELECT l_linestatus FROM lineitem WHERE l_quantity < 9")
def set_except_all(spark, d):
    l = Tables(spark, d).lineitem  # noqa: E741
    return l.filter("l_quantity < 10").select("l_linestatus").exceptAll(l.filter("l_quantity < 9").select("l_linestatus"))


@query("set_union_all", "SELECT 'c' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier")
def set_union_all(spark, d):
    t = Tables(spark, d)
    return t.customer.select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("bal")).unionAll(t.supplier.select(F.lit("s"), "s_acctbal"))


@query("fn_strings", "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS len, substr(p_name, 2, 5) AS part, replace(p_brand, '#', '-') AS rep, trim('  ' || p_type || ' ') AS trimmed, lpad(p_size::VARCHAR, 4, '0') AS pad, starts_with(p_brand, 'Brand#1') AS starts, split_part(p_brand, '#', 2) AS tail FROM part")
def fn_strings(spark, d):
    c = F.col
    return Tables(spark, d).part.select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.length("p_name").cast("long").alias("len"), F.substring("p_name", 2, 5).alias("part"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("rep"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"), F.lpad(c("p_size").cast("string"), 4, "0").alias("pad"), c("p_brand").startswith("Brand#1").alias("starts"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("tail"))


@query("fn_dates", "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, year(ts) AS y, month(ts) AS m, dayofmonth(ts) AS dd, strftime(ts, '%Y-%m-%d %H:%M') AS text, ts + INTERVAL 90 MINUTE AS later, epoch_ms(date_trunc('second', ts)) AS ms, ts::DATE AS day FROM events")
def fn_dates(spark, d):
    return sql(spark, d, "SELECT event_id, date_trunc('hour', ts)::timestamp_ntz AS h, year(ts)::bigint AS y, month(ts)::bigint AS m, dayofmonth(ts)::bigint AS dd, date_format(ts, 'yyyy-MM-dd HH:mm') AS text, ts + INTERVAL 90 MINUTE AS later, unix_millis(date_trunc('second', ts)::timestamp) AS ms, ts::date AS day FROM {events}")


@query("fn_math", "SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS rest, l_orderkey // 7 AS whole, abs(l_discount - l_tax) AS gap, greatest(l_discount, l_tax) AS top, least(l_discount, l_tax) AS low, l_extendedprice / nullif(l_quantity, 1) AS per FROM lineitem")
def fn_math(spark, d):
    return sql(spark, d, "SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS rest, l_orderkey div 7 AS whole, abs(l_discount - l_tax) AS gap, greatest(l_discount, l_tax) AS top, least(l_discount, l_tax) AS low, l_extendedprice / nullif(l_quantity, 1) AS per FROM {lineitem}")


@query("fn_nulls", "SELECT event_id, coalesce(CASE WHEN value > 50 THEN event_type END, 'none') AS kind, nullif(event_type, 'view') AS other FROM events")
def fn_nulls(spark, d):
    return Tables(spark, d).events.select("event_id", F.coalesce(F.when(F.col("value") > 50, F.col("event_type")), F.lit("none")).alias("kind"), F.nullif(F.col("event_type"), F.lit("view")).alias("other"))


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, (json_extract_string(props, '$.k'))::BIGINT + 1 AS next, json_extract_string(props, '$.missing') AS missing FROM events")
def json_extract(spark, d):
    k = F.get_json_object("props", "$.k")
    return Tables(spark, d).events.select("event_id", k.alias("k"), (k.cast("long") + 1).alias("next"), F.get_json_object("props", "$.missing").alias("missing"))


_TURNS = "(SELECT conv_id, list(role ORDER BY turn) AS roles, list(length(text) ORDER BY turn) AS sizes FROM conversations GROUP BY conv_id)"


def _turns(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("size"))))
    return Tables(spark, d).conversations.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.size").alias("sizes"))


@query("nested_list", f"SELECT conv_id, len(roles) AS n, list_contains(roles, 'assistant') AS has, roles[1] AS first, list_sum(sizes)::BIGINT AS total, list_position(roles, 'assistant')::BIGINT AS place FROM {_TURNS}")
def nested_list(spark, d):
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    place = F.nullif(F.array_position("roles", "assistant"), F.lit(0))
    return _turns(spark, d).select("conv_id", F.size("roles").cast("long").alias("n"), F.array_contains("roles", "assistant").alias("has"), F.element_at("roles", 1).alias("first"), total.alias("total"), place.alias("place"))


@query("nested_unnest", f"SELECT conv_id, unnest(sizes) AS size FROM {_TURNS}")
def nested_unnest(spark, d):
    return _turns(spark, d).select("conv_id", F.explode("sizes").alias("size"))


@query("nested_struct_map", "SELECT user_id, max(CASE WHEN event_type = 'click' THEN n END) AS clicks, sum(n)::BIGINT AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def nested_struct_map(spark, d):
    counts = Tables(spark, d).events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    owner = maps.select(F.struct("user_id", "m").alias("owner"))
    return owner.select(F.col("owner.user_id").alias("user_id"), F.try_element_at("owner.m", F.lit("click")).alias("clicks"), F.aggregate(F.map_values("owner.m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("string_aggregation", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_aggregation(spark, d):
    return sql(spark, d, "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")


@query("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def row_numbers(spark, d):
    return numbered(Tables(spark, d).orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "position")


@query("row_wise_total", "SELECT l_orderkey, l_linenumber, round(l_discount + l_tax, 6) AS charges, greatest(l_discount, l_tax) AS top FROM lineitem")
def row_wise_total(spark, d):
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", F.round(row_total(["l_discount", "l_tax"]), 6).alias("charges"), F.greatest("l_discount", "l_tax").alias("top"))


@query("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
def recursive_cte(spark, d):
    return spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
