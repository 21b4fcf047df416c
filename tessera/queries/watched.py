"""Sessions, guards, functions and what is measured about queries."""

import dataclasses
import datetime as dt
import decimal
import json
import urllib.request
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tessera.functions import udf
from tessera.guard import GuardedQuery, Hardening, QueryPolicy, Rejected, WhenOver
from tessera.metrics import Dashboard, Metrics, QueryProfile, Recorder, Snapshot, diagnose
from tessera.queries.filed import _name, place
from tessera.queries.models import scratch
from tessera.queries.registry import query
from tessera.queries.tables import Tables, sql
from tessera.rows import Cancelled, CancelSignal, Rows
from tessera.session import Engine, ReadError


@dataclasses.dataclass(frozen=True)
class Customer:
    id: int
    name: str
    balance: float


@query("rows_as_records", "SELECT c_custkey AS id, c_name AS name, round(c_acctbal * 2, 2) AS twice FROM customer WHERE c_acctbal < 0")
def rows_as_records(spark, d):
    """Rows as objects, columns taken by position."""
    found = Rows(Tables(spark, d).customer.filter("c_acctbal < 0").select("c_custkey", "c_name", "c_acctbal")).records(Customer)
    return spark.createDataFrame([(c.id, c.name, round(c.balance * 2, 2)) for c in found], "id long, name string, twice double")


@query("row_caps", "SELECT o_orderkey, (SELECT count(*) FROM orders) > 10 AS cut, (SELECT count(*) FROM orders) > 10 AS refused, (SELECT count(*) FROM orders) > 3 AS bytes_refused FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10)")
def row_caps(spark, d):
    name = _name("orders")
    Tables(spark, d).orders.createOrReplaceTempView(name)
    asked = f"SELECT o_orderkey FROM {name} ORDER BY o_orderkey"

    def refuses(**caps) -> bool:
        try:
            GuardedQuery(spark, QueryPolicy(timeout=None, **caps)).run(asked)
        except Rejected:
            return True
        return False

    got = GuardedQuery(spark, QueryPolicy(max_rows=10, when_over=WhenOver.TRUNCATE, timeout=None)).run(asked)
    refused = refuses(max_rows=10), refuses(max_rows=1 << 30, max_bytes=24)
    rows = [(r["o_orderkey"], got.truncated, *refused) for r in got.rows]
    return spark.createDataFrame(rows, "o_orderkey long, cut boolean, refused boolean, bytes_refused boolean")


@query("cancelled_query", "SELECT count(*) AS n, true AS cancelled, true AS late FROM events")
def cancelled_query(spark, d):
    """A query under a signal that was given, one past its deadline, and one that runs."""
    e = Tables(spark, d).events
    signal = CancelSignal()
    signal.cancel()

    def stopped(rows: Rows) -> bool:
        try:
            rows.collect()
        except Cancelled:
            return True
        return False

    endless = spark.range(0, 10**12, 1, 2).selectExpr("sum(sin(id))")
    return spark.createDataFrame([(Rows(e).timeout(300).count(), stopped(Rows(e).under(signal)), stopped(Rows(endless).timeout(0.5)))], "n long, cancelled boolean, late boolean")


@query("statement", "SELECT n_regionkey, count(*) AS n, max(n_nationkey) AS last FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def statement(spark, d):
    """Any statement through the engine, and what it left asked with a parameter."""
    e, name = Engine(spark), _name("nations")
    e.execute(f"CREATE TEMPORARY VIEW {name} USING parquet OPTIONS (path '{d}/nation.parquet')")
    return e.query(f"SELECT n_regionkey, count(*) AS n, max(n_nationkey) AS last FROM {name} WHERE n_nationkey > :least GROUP BY n_regionkey", least=3).df


@query("meta_functions", "SELECT typeof(o_totalprice) = 'DOUBLE' AS number, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey, true AS known FROM orders WHERE o_orderkey < 200")
def meta_functions(spark, d):
    """Types, settings and the session's database as values; numbers given in order."""
    from tessera.operators.ordering import numbered

    o = sql(spark, d, "SELECT typeof(o_totalprice) = 'double' AS number, o_orderkey, current_database() IS NOT NULL AND current_catalog() IS NOT NULL AS known FROM {orders} WHERE o_orderkey < 200")
    return numbered(o, [F.col("o_orderkey")], "place")


@query("udf_nullable", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' ELSE 'missing' END AS shown FROM events")
def udf_nullable(spark, d):
    """A function that sees nulls."""
    udf.register_nullable(spark, "tessera_or_missing", "string", lambda v: "missing" if v is None else v)
    return sql(spark, d, "SELECT event_id, tessera_or_missing(CASE WHEN event_type = 'view' THEN event_type END) AS shown FROM {events}")


@query("udf_types", "SELECT o_orderkey, (o_orderdate::DATE + 1) AS next, (o_totalprice > 1000) AS dear, round(o_totalprice, 2)::DECIMAL(18, 2) AS price, 2::BIGINT AS refused FROM orders WHERE o_orderkey % 10 = 1")
def udf_types(spark, d):
    """Dates, truth values and decimals in and out; bytes and maps are refused."""
    udf.register(spark, "tessera_next", "date", lambda v: v + dt.timedelta(days=1))
    udf.register(spark, "tessera_dear", "boolean", lambda v: v > 1000)
    udf.register(spark, "tessera_price", "decimal(18,2)", lambda v: v.quantize(decimal.Decimal("0.01")))
    refused = 0
    for kind in ("binary", "map<string,int>"):
        try:
            udf.register(spark, "tessera_bad", kind, lambda v: v)
        except udf.UnsupportedType:
            refused += 1
    out = sql(spark, d, "SELECT o_orderkey, tessera_next(o_orderdate::date) AS next, tessera_dear(o_totalprice) AS dear, tessera_price(round(o_totalprice, 2)::decimal(18, 2)) AS price FROM {orders} WHERE o_orderkey % 10 = 1")
    return out.withColumn("refused", F.lit(refused).cast("long"))


@query("udf_lifetime", "SELECT r_regionkey, r_regionkey + 1 AS more, false AS elsewhere FROM region")
def udf_lifetime(spark, d):
    """A function is known to the session that it was registered with."""
    e = Engine(spark)
    e.register_function("tessera_more", "int", lambda v: v + 1)
    other = spark.newSession().catalog.functionExists("tessera_more")
    return sql(spark, d, "SELECT r_regionkey, tessera_more(r_regionkey) AS more FROM {region}").withColumn("elsewhere", F.lit(other))


_ASKED = (
    ("SELECT * FROM t PIVOT (count(1) FOR r_name IN ('ASIA'))", True, False),
    ("SELECT count(*) FROM t", True, True),
    ("SELECT * FROM other", True, False),
    ("CREATE TEMPORARY MACRO plus(a) a + 1", False, False),
    ("DELETE FROM t", False, False),
    ("SELECT * FROM parquet.`{d}/region.parquet`", False, True),
    ("SELECT * FROM parquet.`{d}/../region.parquet`", False, False),
    ("SELECT * FROM parquet.`{d}/*.parquet`", False, False),
)


@query("guard_policies", "SELECT * FROM (VALUES " + ", ".join("('" + s.replace("'", "''") + f"', {str(a).lower()}, {str(b).lower()})" for s, a, b in _ASKED) + ") t(statement, open, strict)")
def guard_policies(spark, d):
    """What an open policy lets through, and one of a single table, no pivots and a folder of files; refusals have reasons."""
    folder = str(urlparse(d).path)
    open_, strict = GuardedQuery(spark), GuardedQuery(spark, QueryPolicy(tables=frozenset({"t"}), allow_pivot=False, folders=(folder,)))
    allowed = lambda g, s: g.why_rejected(s.replace("{d}", folder)) is None
    return spark.createDataFrame([(s, allowed(open_, s), allowed(strict, s)) for s, _, _ in _ASKED], "statement string, open boolean, strict boolean")


@query("reads_checked", "SELECT n_nationkey, 3::BIGINT AS refused FROM nation WHERE n_regionkey = 1")
def reads_checked(spark, d):
    """The engine's own SQL must be one statement that gives rows; hardened sessions don't read files by path."""
    e, refused = Engine(spark), 0
    for bad in ("SELECT 1; SELECT 2", "DROP VIEW x"):
        try:
            e.query(bad)
        except ReadError:
            refused += 1
    hard = spark.newSession()
    Hardening.apply(hard)
    try:
        hard.sql(f"SELECT * FROM parquet.`{d}/nation.parquet`").schema
    except Exception as x:  # an analysis error, whose type differs by version
        refused += "TABLE_OR_VIEW_NOT_FOUND" in str(x) or "UNSUPPORTED" in str(x)
    name = _name("nation")
    Tables(spark, d).nation.createOrReplaceTempView(name)
    return e.query(f"SELECT n_nationkey FROM {name} WHERE n_regionkey = ?", 1).df.withColumn("refused", F.lit(refused).cast("long"))


def _timed(spark, d) -> Metrics:
    m = Metrics()
    for r in Tables(spark, d).nation.select("n_nationkey", "n_name").collect():
        with m.timed(f"SELECT {r['n_nationkey']} FROM nation WHERE n_name = '{r['n_name']}'"):
            pass
    return m


@query("metrics_recorded", "SELECT 'SELECT ? FROM nation WHERE n_name = ?' AS statement, count(*) AS runs, 2::BIGINT AS days, 1::BIGINT AS expired FROM nation")
def metrics_recorded(spark, d):
    """Statements told apart by their shape, written as lines of a day's file and read back; old days go."""
    folder = urlparse(place(spark)).path
    r, s = Recorder(folder, keep_days=2), _timed(spark, d).snapshot()
    for day in (1, 5, 6):
        r.write(s, dt.date(2024, 5, day))
    expired = r.delete_expired(dt.date(2024, 5, 6))
    lines = spark.read.text(f"file:{folder}/*.jsonl")
    timers = lines.select(F.from_json(F.get_json_object("value", "$.timers"), "map<string, struct<count: long>>").alias("t"))
    each = timers.select(F.explode("t").alias("statement", "v")).groupBy("statement").agg(F.max("v.count").alias("runs"), F.count("*").alias("days"))
    return each.withColumn("expired", F.lit(len(expired)).cast("long"))


@query("dashboard", "SELECT 'SELECT ? FROM nation WHERE n_name = ?' AS statement, count(*) AS runs, count(*) AS recorded FROM nation")
def dashboard(spark, d):
    """The page's numbers over HTTP, and what its recorder wrote when it closed."""
    m, folder = Metrics(), urlparse(place(spark)).path
    board = Dashboard(m, recorder=Recorder(folder), every=3600)
    try:
        for t in [_timed(spark, d).snapshot()]:
            for shape, timer in t.timers.items():
                for _ in range(timer.count):
                    with m.timed(shape):
                        pass
        base = f"http://127.0.0.1:{board.port}"
        seen = json.load(urllib.request.urlopen(f"{base}/metrics.json"))["timers"]
        if "<table>" not in urllib.request.urlopen(base).read().decode() or not isinstance(json.load(urllib.request.urlopen(f"{base}/processes.json")), list):
            raise AssertionError("no page, or no processes")
    finally:
        board.close()
    recorded = board.recorded()
    return spark.createDataFrame([(k, v["count"], recorded) for k, v in seen.items()], "statement string, runs long, recorded long")


@query("diagnosis", "SELECT user_id, count(*) >= 20 AND count(*) FILTER (WHERE event_type = 'error') >= 0.05 * count(*) AS failing FROM events GROUP BY user_id")
def diagnosis(spark, d):
    """Events as statements: users of whose events one in twenty or more is an error, if they have twenty."""
    counts = Tables(spark, d).events.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("e")).collect()
    found = [(r["user_id"], any(f.cause.name == "FAILING" for f in diagnose(Snapshot(0, {}, {"statements": r["n"], "errors": r["e"]}, {})))) for r in counts]
    return spark.createDataFrame(found, "user_id long, failing boolean")


@query("query_profile", "SELECT 'Filter' AS operator, count(*) AS n FROM events WHERE value > 50 AND event_type LIKE '%i%'")
def query_profile(spark, d):
    """Rows that came out of a plan's filter."""
    e = Tables(spark, d).events.filter("value > 50 AND event_type LIKE '%i%'").select("event_id")
    rows = [int(v["numOutputRows"]) for name, v in QueryProfile.of(e).operators if name.strip() == "Filter"]
    return spark.createDataFrame([("Filter", n) for n in rows], "operator string, n long")


@query("races_counted", "SELECT 2::BIGINT AS changes, 1::BIGINT AS lost, count(*) AS n FROM nation")
def races_counted(spark, d):
    """Changes, and those made again because another was faster, as the store counts them."""
    store, m = scratch(spark), Metrics()
    store.metrics = m
    n = Tables(spark, d).nation
    store.change(lambda c: c.replace("n", n.limit(0)))
    first = []

    def work(c):
        if not first:
            first.append(1)
            type(store)(spark, store.files.root).change(lambda other: other.note("n", seen=True))
        c.append("n", n)

    store.change(work)
    counted = m.snapshot().counters
    return spark.createDataFrame([(counted["changes"], counted["lost_races"], store.read("n").count())], "changes long, lost long, n long")
