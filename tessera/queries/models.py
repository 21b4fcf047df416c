"""Measures, sparse views, materialized roll-ups, journals and user functions over the tables."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tessera.functions import udf
from tessera.materialization import Materialization
from tessera.measures import Field, Measure, MeasureHistory, MeasureRefresh, MeasureTable
from tessera.operators.aggregates import rollup_of
from tessera.plans.lineage import ensure_checkpoint_dir
from tessera.plans.spread import spread
from tessera.queries.registry import query
from tessera.queries.tables import Tables, sql
from tessera.sparse import wide_view
from tessera.store import Store


def scratch(spark) -> Store:
    """A new store in the folder that the whole cluster shares."""
    return Store(spark, f"{ensure_checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}")


#: Lines of an order as a measure: record is the order; price by flag, status, shipping year; units are two currencies.
LINES = Measure("lines", (Field("flag", ("R", "A")), Field("status"), Field("year"), Field("unit")), "unit")
_KEYED = "SELECT l_orderkey AS record_id, l_returnflag AS flag, l_linestatus AS status, year(l_shipdate)::VARCHAR AS year, CASE WHEN l_suppkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS unit, l_extendedprice AS price, l_quantity AS qty, l_linenumber AS line FROM lineitem"
_VALUES = f"(SELECT record_id, flag, status, year, unit, sum(price) AS value FROM ({_KEYED}) GROUP BY ALL)"


def _values(spark, d):
    unit = F.when(F.col("l_suppkey") % 2 == 0, "EUR").otherwise("USD")
    l = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").cast("string").alias("year"), unit.alias("unit"), "l_extendedprice", "l_linenumber")  # noqa: E741
    return spread(l, "record_id").groupBy("record_id", "flag", "status", "year", "unit").agg(F.sum("l_extendedprice").alias("value"))


_kept: dict[tuple, MeasureTable] = {}


def _once(make):
    """A measure table that queries only read, made once per session and folder."""

    def get(spark, d):
        key = (make.__name__, spark.sparkContext.applicationId, d)
        if key not in _kept:
            _kept[key] = make(spark, d)
        return _kept[key]

    return get


def _filled(spark, d):
    table = MeasureTable(scratch(spark), LINES).create()
    table.append(_values(spark, d), part="first", by="loader", at=dt.datetime(2024, 1, 1))
    return table


_shown = _once(_filled)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 2) for n in names})


@query("measure_pivot", f"SELECT flag, round(sum(value) FILTER (WHERE status = 'F'), 2) AS F, round(sum(value) FILTER (WHERE status = 'O'), 2) AS O FROM {_VALUES} WHERE unit = 'EUR' GROUP BY flag")
def measure_pivot(spark, d):
    return _rounded(_shown(spark, d).query().rows("flag").columns("status").where("unit", "EUR").df(), "F", "O")


@query("measure_convert", f"SELECT year, round(sum(CASE unit WHEN 'EUR' THEN value * 1.25 ELSE value END), 4) AS value FROM {_VALUES} GROUP BY year")
def measure_convert(spark, d):
    rates = spark.createDataFrame([("EUR", "USD", 1.25), ("USD", "USD", 1.0)], "unit string, to_unit string, factor double")
    return _shown(spark, d).query().rows("year").convert_to("USD", rates).df().withColumn("value", F.round("value", 4))


@query("measure_declared_order", f"SELECT flag, unit, round(sum(value), 2) AS value FROM {_VALUES} WHERE year IN ('1996', '1997') GROUP BY flag, unit")
def measure_declared_order(spark, d):
    return _rounded(_shown(spark, d).query().rows("flag", "unit").where("year", "1996", "1997").df(), "value")


@query("measure_records", f"SELECT record_id, round(sum(value), 2) AS value FROM {_VALUES} WHERE unit = 'USD' AND record_id IN (1, 2, 3, 4, 5, 32, 33) GROUP BY record_id")
def measure_records(spark, d):
    return _rounded(_shown(spark, d).query().rows("record_id").where("unit", "USD").records([1, 2, 3, 4, 5, 32, 33]).df(), "value")


@query("measure_latest_per_key", f"SELECT unit, round(sum(CASE WHEN record_id % 5 = 0 THEN 1.0 ELSE value END), 2) AS value FROM {_VALUES} GROUP BY unit")
def measure_latest_per_key(spark, d):
    table = _filled(spark, d)
    again = _values(spark, d).filter("record_id % 5 = 0").withColumn("value", F.lit(1.0))
    table.append(again, part="second", by="editor", at=dt.datetime(2024, 2, 1))
    return _rounded(table.query().rows("unit").latest_per_key().df(), "value")


@query("measure_parts", f"SELECT part, count(*) AS \"values\", count(DISTINCT record_id) AS records FROM (SELECT record_id, 'first' AS part FROM {_VALUES} UNION ALL SELECT record_id, 'second' FROM {_VALUES} WHERE record_id % 5 = 0) GROUP BY part")
def measure_parts(spark, d):
    table = _filled(spark, d)
    table.append(_values(spark, d).filter("record_id % 5 = 0"), part="second")
    return table.parts()


def _refreshes(spark, d):
    """A full set of all orders, an increment that sets a fifth of them to 1 per key, and a removal of some."""
    store = scratch(spark)
    table = MeasureTable(store, LINES).create()
    values = _values(spark, d)
    at = lambda h: dt.datetime(2024, 3, 1, h)
    MeasureRefresh(store, at(9), "full").by("svc").full(table, values).commit()
    MeasureRefresh(store, at(10), "inc").by("svc").increment(table, values.filter("record_id % 5 = 0").withColumn("value", F.lit(1.0))).commit()
    MeasureRefresh(store, at(11), "gone").by("svc").remove(table, [1, 2, 3, 5, 35]).commit()
    return table


_live = _once(_refreshes)
_at = lambda h: dt.datetime(2024, 3, 1, h)


def _refreshed(spark, d):
    return _live(spark, d), _at


_INC = f"(SELECT * REPLACE (CASE WHEN record_id % 5 = 0 THEN 1.0 ELSE value END AS value) FROM {_VALUES})"


@query("measure_as_of", f"SELECT flag, unit, round(sum(value), 2) AS value FROM {_INC} GROUP BY flag, unit")
def measure_as_of(spark, d):
    table, at = _refreshed(spark, d)
    return _rounded(table.query().rows("flag", "unit").as_of(at(10)).df(), "value")


@query("measure_as_of_shipped", f"SELECT flag, unit, round(sum(value), 2) AS value FROM {_INC} GROUP BY flag, unit")
def measure_as_of_shipped(spark, d):
    table = _refreshes(spark, d)
    history = MeasureHistory(scratch(spark))
    history.ship(table)
    return _rounded(table.query().rows("flag", "unit").as_of(_at(10), history).df(), "value")


@query("measure_live_after_refreshes", f"SELECT year, unit, round(sum(value), 2) AS value FROM {_INC} WHERE record_id NOT IN (1, 2, 3, 5, 35) GROUP BY year, unit")
def measure_live_after_refreshes(spark, d):
    table, _ = _refreshed(spark, d)
    return _rounded(table.query().rows("year", "unit").df(), "value")


@query("measure_show_zeros", f"SELECT record_id, unit, CASE WHEN record_id IN (1, 2, 3, 5, 35) THEN 0.0::DOUBLE ELSE round(sum(value), 2) END AS value FROM {_INC} WHERE record_id < 40 GROUP BY record_id, unit")
def measure_show_zeros(spark, d):
    table, at = _refreshed(spark, d)
    out = table.query().rows("record_id", "unit").records(range(40)).as_of(at(11)).show_zeros().df()
    return out.withColumn("value", F.round(F.when(F.abs("value") < 1e-6, 0.0).otherwise(F.col("value")), 2))


@query("measure_diff_contributions", f"SELECT refresh_id, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 'full' AS refresh_id, value FROM {_VALUES} UNION ALL SELECT 'inc', 1.0 - value FROM {_VALUES} WHERE record_id % 5 = 0 AND value <> 1.0 UNION ALL SELECT 'gone', -value FROM {_INC} WHERE record_id IN (1, 2, 3, 5, 35)) GROUP BY refresh_id")
def measure_diff_contributions(spark, d):
    table, _ = _refreshed(spark, d)
    rows = table.store.read(table.contributions_table)
    return rows.groupBy("refresh_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("measure_state_is_sum", f"SELECT 'live' AS source, unit, count(*) AS n, round(sum(value), 2) AS total FROM {_INC} WHERE record_id NOT IN (1, 2, 3, 5, 35) GROUP BY unit UNION ALL SELECT 'contributions', unit, count(*), round(sum(value), 2) FROM {_INC} WHERE record_id NOT IN (1, 2, 3, 5, 35) GROUP BY unit")
def measure_state_is_sum(spark, d):
    """The live state, and the keys whose contributions don't cancel out: the same."""
    table, _ = _refreshed(spark, d)
    keys = ["record_id", *LINES.names]
    per_key = lambda name: spread(table.store.read(name), "record_id").groupBy(*keys).agg(F.round(F.sum("value"), 4).alias("value")).filter("value <> 0")
    shown = lambda name, source: per_key(name).groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.lit(source).alias("source"), "unit", "n", "total")
    return shown(table.values_table, "live").unionAll(shown(table.contributions_table, "contributions"))


@query("measure_restore", f"SELECT unit, round(sum(value), 2) AS value, count(*) AS n FROM {_VALUES} GROUP BY unit")
def measure_restore(spark, d):
    table = _filled(spark, d)
    place = f"{table.store.files.root}_archive"
    table.archive(place, "first")
    table.restore(place)
    rows = table.store.read(table.values_table)
    return rows.groupBy("unit").agg(F.round(F.sum("value"), 2).alias("value"), F.count("*").alias("n"))


@query("measure_from_files", f"SELECT year, round(sum(value), 2) AS value FROM {_VALUES} WHERE unit = 'EUR' GROUP BY year")
def measure_from_files(spark, d):
    table = _filled(spark, d)
    place = f"{table.store.files.root}_archive"
    table.archive(place, "first")
    return _rounded(table.query().from_files(place).rows("year").where("unit", "EUR").df(), "value")


_POINTS = "(SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL)"


def _points(spark, d):
    return Tables(spark, d).events.groupBy(F.col("user_id").alias("record_id"), F.col("event_type").alias("attribute")).agg(F.max("value").alias("value"))


@query("sparse_wide_view", f"SELECT user_id AS record_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'purchase') AS purchase, NULL::DOUBLE AS unknown FROM {_POINTS} WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def sparse_wide_view(spark, d):
    return wide_view(_points(spark, d), ["click", "purchase", "unknown"])


@query("sparse_read", f"SELECT event_type AS attribute, value FROM {_POINTS} WHERE user_id = 7")
def sparse_read(spark, d):
    from tessera.sparse import SparseTable

    table = SparseTable(scratch(spark), "points").create()
    table.append_points(_points(spark, d))
    table.optimize()
    return spark.createDataFrame(list(table.read(7).items()), "attribute string, value double")


@query("rollup_incremental", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag")
def rollup_incremental(spark, d):
    lines = Tables(spark, d).lineitem
    roll = lambda df: rollup_of(df, ["l_returnflag", "l_linestatus"], {"price": "l_extendedprice"})
    m = Materialization(scratch(spark), "roll", lambda: roll(lines.filter("l_orderkey % 4 <> 0")))
    m.create_if_absent()
    m.append_delta(roll(lines.filter("l_orderkey % 4 = 0")), batch="rest")
    m.append_delta(roll(lines.filter("l_orderkey % 4 = 0")), batch="rest")
    return m.answer(["l_returnflag"], ["price"]).select("l_returnflag", "n", F.round("price", 2).alias("price"))


@query("upsert_delete_update", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS bal, CASE WHEN c_nationkey = 2 THEN 'N2' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 10 <> 9")
def upsert_delete_update(spark, d):
    store = scratch(spark)
    c = Tables(spark, d).customer.select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"), "c_nationkey")

    def work(s):
        s.create("people", c.schema, ["c_custkey"])
        s.insert("people", c.filter("c_custkey % 2 = 0"))
        s.insert_missing("people", c)
        s.upsert("people", c.filter("c_custkey % 4 = 0").withColumn("bal", F.lit(0.0)))
        s.delete_keys("people", c.filter("c_custkey % 10 = 9").select("c_custkey"))
        s.update_where("people", "c_nationkey = 2", {"seg": "N2"})

    store.change(work)
    return store.read("people").drop("c_nationkey")


@query("journal_sequences", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, text FROM conversations")
def journal_sequences(spark, d):
    from tessera.journal import Journal
    from tessera.schema import columns

    j = Journal(scratch(spark), "talk", columns(conv_id="long", seq="long", text="string"), ["conv_id", "seq"], sequence="seq", within=["conv_id"]).open()
    turns = Tables(spark, d).conversations
    for half in (turns.filter("turn < 2"), turns.filter("turn >= 2")):
        j.append(half.repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").select("conv_id", F.lit(None).cast("long").alias("seq"), "text"))
    return j.df()


@query("udf_null_rule", "SELECT event_id, CASE WHEN event_type = 'view' THEN value * 2 + 1 END AS doubled FROM events")
def udf_null_rule(spark, d):
    udf.register_vectorised(spark, "tessera_doubled", "double", lambda v: v * 2 + 1)
    return sql(spark, d, "SELECT event_id, tessera_doubled(CASE WHEN event_type = 'view' THEN value END) AS doubled FROM {events}")


@query("udf_scalar", "SELECT c_custkey, reverse(c_mktsegment) AS turned FROM customer")
def udf_scalar(spark, d):
    udf.register(spark, "tessera_turned", "string", lambda s: s[::-1])
    return sql(spark, d, "SELECT c_custkey, tessera_turned(c_mktsegment) AS turned FROM {customer}")


@query("udf_once_per_distinct", "SELECT o_orderkey, length(o_orderpriority) AS n FROM orders")
def udf_once_per_distinct(spark, d):
    return udf.once_per_value(Tables(spark, d).orders, "o_orderpriority", "long", len, "n").select("o_orderkey", "n")


@query("udtf_rows", "SELECT i AS n, i * i AS square FROM range(1, 11) t(i)")
def udtf_rows(spark, d):
    def squares(end: int):
        for i in range(1, end + 1):
            yield i, i * i

    udf.table_function(spark, "tessera_squares", "n long, square long", squares)
    return spark.sql("SELECT * FROM tessera_squares(10)")


@query("live_source", "SELECT i % 3 AS g, sum(i)::BIGINT AS total FROM range(1000) t(i) GROUP BY 1")
def live_source(spark, d):
    from tessera.sources.live import row_source

    spark.dataSource.register(row_source("tessera_numbers", "i long", lambda a, b: ((i,) for i in range(a, b)), lambda: 1000))
    rows = spark.read.format("tessera_numbers").load()
    return rows.groupBy((F.col("i") % 3).alias("g")).agg(F.sum("i").alias("total"))
