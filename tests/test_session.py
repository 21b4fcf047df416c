"""Layouts, rows, guard, catalog, sessions, sources, functions, metrics."""

import dataclasses
import datetime as dt
import decimal
import enum
import json
import time
import urllib.request
import uuid
from typing import Annotated

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import Catalog, QueryExamples, families
from tessera.functions import udf
from tessera.guard import GuardedQuery, Hardening, QueryPolicy, Rejected, WhenOver, size_of
from tessera.layout import Info, Layout, LayoutError, Vector, described
from tessera.metrics import Cause, Dashboard, Metrics, QueryProfile, Recorder, Snapshot, Timer, diagnose, shape
from tessera.plans import parse
from tessera.rows import Cancelled, CancelSignal, Rows
from tessera.session import Engine, QuerySession, ReadError
from tessera.sources import files
from tessera.sources.live import LiveTable, row_source, snapshot
from tessera.sources.remote import IcebergCatalog, ObjectStore
from tessera.sources.textfile import FileTable, FileTables, LineSource, RowParser


class Color(enum.Enum):
    RED = "r"
    BLUE = "b"


@dataclasses.dataclass
class Owner:
    name: str
    age: int


@dataclasses.dataclass
class Everything:
    id: int
    s: str | None
    flag: bool | None
    f: float | None
    d: decimal.Decimal | None
    u: uuid.UUID | None
    color: Color | None
    day: dt.date | None
    at: dt.datetime | None
    clock: dt.time | None
    raw: bytes | None
    tags: list[str] | None
    counts: dict[str, int] | None
    owner: Owner | None
    price: Annotated[float | None, Info("what it costs", "EUR")]
    v: Annotated[list[float] | None, Vector(2)]


FULL = Everything(1, "é", True, 1.5, decimal.Decimal("1.2345678901"), uuid.UUID(int=5), Color.BLUE, dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 2, 3, 4, 5), dt.time(1, 2, 3), b"\x00\xff", ["a", ""], {"x": 1}, Owner("o", 9), 2.5, [1.0, 2.0])
EMPTY = Everything(2, *[None] * 15)


def test_layout_round_trip(spark, tmp_path):
    layout = Layout.of(Everything)
    layout.df(spark, [FULL, EMPTY]).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(layout.items(back), key=lambda i: i.id) == [FULL, EMPTY]
    assert back.schema["price"].metadata == {"description": "what it costs", "unit": "EUR"}
    assert layout.key == "id" and back.filter("color = 1").count() == 1
    assert described(back, "f", unit="m").schema["f"].metadata == {"unit": "m"}


def test_layout_refusals(spark):
    for kind in (list[list[int]], complex, dict[str, list[int]], int | str):
        with pytest.raises(LayoutError):
            Layout.of(dataclasses.make_dataclass("X", [("id", int), ("x", kind)]))
    layout = Layout.of(Everything)
    with pytest.raises(LayoutError, match="2 dimensions, the value has 3"):
        layout.row(dataclasses.replace(FULL, v=[1.0, 2.0, 3.0]))
    wrong = layout.df(spark, [FULL]).withColumn("v", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="2 dimensions"):
        layout.check_vectors(wrong).collect()


def test_rows(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') t(n, s)")
    pair = dataclasses.make_dataclass("Pair", [("n", int), ("s", str)])
    r = Rows(df)
    assert r.records(pair) == [pair(1, "a"), pair(2, "b")] and r.list() == [1, 2] and r.count() == 2
    seen = []
    assert r.for_each_value(seen.append) == 2 and seen == [1, 2]
    assert Rows(df.limit(1).select("s")).scalar() == "a" and Rows(df.limit(0)).scalar_optional() is None
    for bad in (lambda: r.scalar(), lambda: Rows(df.limit(0)).scalar(), lambda: Rows(spark.sql("SELECT null")).scalar_optional(), lambda: r.records(Owner) and r.records(Everything)):
        with pytest.raises(LookupError):
            bad()


def test_deadline_and_signal(spark):
    endless = spark.range(0, 10**12, 1, 2).selectExpr("sum(sin(id))")
    began = time.time()
    with pytest.raises(Cancelled):
        Rows(endless).timeout(1).collect()
    signal = CancelSignal(lambda: time.time() > began + 3)
    with pytest.raises(Cancelled):
        Rows(endless).under(signal).collect()
    assert time.time() - began < 30
    with pytest.raises(Cancelled):
        Rows(endless).under(signal).collect()


@pytest.fixture
def events(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.createOrReplaceTempView("events")
    yield df
    spark.catalog.dropTempView("events")


ALLOWED = """select 1
select count(*) from events;
with a as (select * from events) select * from a where value > (select avg(value) from events)
explain select * from events
select * from range(5)
FROM events SELECT user_id
select event_type, count(*) from events group by all having count(*) > 1 order by 2 limit 3
select * from events pivot (count(1) for event_type in ('view', 'click'))
values (1), (2)
with recursive r(n) as (select 1 union all select n + 1 from r where n < 5) select * from r
select ';' as x -- comment ;
select user_id in (select 1) from events
select row_number() over w from events window w as (order by ts)
(select 1) union all (select 2) intersect select 3""".split("\n")
REFUSED = """drop table events
select 1; select 2
insert into events select * from events
create table x as select 1
create temporary view x as select 1
select * from parquet.`/tmp/x`
select * from events where exists (select 1 from csv.`/tmp/x`)
with a as (select * from json.`/tmp/x`) select * from a
set a = b
reset
selec 1
describe events
show tables
refresh table events
cache table events
add jar '/tmp/x.jar'
explain drop table events
select * from read_files('/x')
use other
truncate table events
""".split("\n")


def test_guard(spark, events):
    g = GuardedQuery(spark)
    for sql in ALLOWED:
        assert g.why_rejected(sql) is None, sql
    for sql in REFUSED:
        assert g.why_rejected(sql), sql
        with pytest.raises(Rejected):
            g.run(sql)
    strict = GuardedQuery(spark, QueryPolicy(tables=frozenset({"other"}), allow_pivot=False))
    assert strict.why_rejected("select * from events") and strict.why_rejected(ALLOWED[7])
    assert strict.why_rejected("with a as (select 1) select * from a") is None


def test_guard_caps(spark, events, store):
    many = "select * from range(100)"
    with pytest.raises(Rejected):
        GuardedQuery(spark, QueryPolicy(max_rows=10)).run(many)
    cut = GuardedQuery(spark, QueryPolicy(max_rows=10, when_over=WhenOver.TRUNCATE)).run(many)
    assert len(cut.rows) == 10 and cut.truncated
    assert not GuardedQuery(spark, QueryPolicy(max_rows=100)).run(many).truncated
    with pytest.raises(Rejected):
        GuardedQuery(spark, QueryPolicy(max_bytes=100)).run(many)
    assert size_of([1, "ab", {"k": [1.0, None]}, b"xyz"]) == 8 + 2 + 1 + 8 + 1 + 3
    with pytest.raises(Cancelled):
        GuardedQuery(spark, QueryPolicy(timeout=1)).run("select sum(sin(id)) from range(1000000000000)")
    assert GuardedQuery(spark, QueryPolicy(max_rows=1)).store(many, store, "kept") == 100


def test_hardening(spark):
    old = {k: spark.conf.get(k, None) for k in Hardening.SETTINGS}
    try:
        Hardening.apply(spark)
        with pytest.raises(Exception):
            spark.sql("select * from parquet.`/root/testdata/sf0.001/region.parquet`").collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_columns_read(spark, events):
    path = "file:/root/testdata/sf0.001/events.parquet"
    assert parse.columns_read(spark.sql("select user_id, sum(value) from events where event_type = 'view' group by 1")) == {path: ["event_type", "user_id", "value"]}
    assert parse.columns_read(spark.sql("select 1")) == {}


def test_catalog_and_examples(spark, events):
    c = Catalog(spark)
    c.describe_table("events", "what users did")
    c.describe_column("events", "value", "amount", "EUR")
    assert "events: what users did" in c.describe("events") and "value double (amount; in EUR)" in c.describe("events")
    p = c.profile("events")
    assert p.count == 1000 and len(p.sample) == 5 and len(p.columns) == 6
    assert c.distinct_values("events", "event_type") == ["click", "error", "purchase", "signup", "view"] and c.distinct_values("events", "event_id", 10) is None
    guard = GuardedQuery(spark)
    empty = events.limit(0)
    for df in (events, empty):
        df.createOrReplaceTempView("events")
        found = QueryExamples(spark).of("events")
        assert len(found) >= 6
        for e in found:
            guard.run(e.sql)
    wide = spark.createDataFrame([("h", 1.0, 2.0, 3.0)], "host string, cpu_1 double, cpu_2 double, cpu_3 double")
    wide.withColumnRenamed("host", "the host").createOrReplaceTempView("wide")
    titles = [e.title for e in QueryExamples(spark).of("wide")]
    assert "Mean of the cpu family" in titles
    for e in QueryExamples(spark).of("wide"):
        guard.run(e.sql)
    assert families(["a_1", "a_2", "b_1"]) == {}


@dataclasses.dataclass
class Item:
    id: int
    name: str


def test_engine(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path / "db"))
    assert e.query("SELECT ? + 1 AS n", 2).scalar() == 3 and e.query("SELECT :x AS n", x=5).scalar() == 5
    for bad in ("select 1; select 2", "create table x as select 1", ""):
        with pytest.raises(ReadError):
            e.query(bad)
    layout = Layout.of(Item)
    e.create_table("items", layout)
    assert e.write("items", [Item(1, "a"), Item(2, "b"), Item(1, "c")], layout) == 2
    assert sorted(e.objects("items", layout), key=lambda i: i.id) == [Item(1, "c"), Item(2, "b")]
    assert e.objects("items", layout, F.col("id") == 2) == [Item(2, "b")]
    assert e.export_table("items", str(tmp_path / "out")) == 2
    assert e.metrics.snapshot().counters["statements"] >= 2


def test_query_session(spark, tmp_path):
    (tmp_path / "Über sales-2024.csv").write_text("id,v\n1,2.5\n2,3.5\n")
    (tmp_path / "more.jsonl").write_text('{"id": 1, "s": "x"}\n')
    q = QuerySession(spark)
    assert q.register(str(tmp_path / "Über sales-2024.csv")) == "uber_sales_2024"
    assert q.register(str(tmp_path / "more.jsonl")) == "more"
    got = q.run("select s, v from uber_sales_2024 join more using (id)")
    assert [tuple(r) for r in got.rows] == [("x", 2.5)]
    q.alias("sales", "uber_sales_2024")
    q.register_sql("big", "select * from sales where v > 3")
    assert q.run("select count(*) from big").rows[0][0] == 1
    with pytest.raises(Rejected):
        q.register_sql("bad", "drop table sales")
    w = q.window("select * from sales order by id desc")
    assert len(w) == 2
    q.register_items("items", lambda: [Item(1, "a")], Layout.of(Item), live=True)
    assert q.run("select name from items").rows[0][0] == "a"
    assert q.names() == ["big", "items", "more", "sales", "uber_sales_2024"] and q.examples("sales")
    q.unregister("big")
    with pytest.raises(Exception):
        q.run("select * from big")


@pytest.mark.parametrize(("path", "name"), [("/d/a b.parquet", "a_b"), ("/d/2024.csv.gz", "t_2024"), ("/d/select.json", "t_select"), ("/d/...", "data"), ("/d/Ünïté.ndjson", "unite"), ("/d/x.csv", "x_2")])
def test_table_names(path, name):
    assert files.table_name(path, {"x"}) == name


def test_readers(spark, tmp_path):
    assert files.reader_for("/a/b.JSONL.gz") == "json_lines" and files.reader_for("x.tsv") == "tsv"
    with pytest.raises(files.UnknownFormat):
        files.reader_for("/a/b.exe")
    files.partitioned(spark.range(10).withColumn("g", F.col("id") % 2), str(tmp_path / "p"), ["g"], ["id"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("g = 1").count() == 5
    (tmp_path / "t.txt").write_text("a\nb")
    assert files.texts(spark, str(tmp_path / "t.txt")).first()["value"] == "a\nb"
    assert files.blobs(spark, str(tmp_path / "t.txt")).first()["length"] == 3


def test_live_tables(spark):
    items = [Item(1, "a")]
    live = LiveTable(spark, "live", items, Layout.of(Item))
    assert live.sql("select count(*) from live").first()[0] == 1
    items.append(Item(2, "b"))
    assert live.sql("select count(*) from live").first()[0] == 2 and live.df("name").columns == ["name"]
    snapshot(spark, "frozen", items, Layout.of(Item))
    items.append(Item(3, "c"))
    assert spark.table("frozen").count() == 2
    with pytest.raises(LayoutError):
        LiveTable(spark, "x", [], Layout.of(dataclasses.make_dataclass("B", [("id", int), ("b", bytes)])))
    spark.dataSource.register(row_source("squares", "n long, sq long", lambda a, b: ((i, i * i) for i in range(a, b)), lambda: 10, 3))
    assert spark.read.format("squares").load().agg(F.sum("sq")).first()[0] == 285


def test_file_table(spark, store, tmp_path):
    path = tmp_path / "app.log"
    path.write_text("header\nINFO 1\nskip me\nERROR 2\nINFO ")
    schema = T.StructType([T.StructField("level", T.StringType()), T.StructField("n", T.LongType())])
    parser = RowParser(schema, lambda s: (s.split()[0], int(s.split()[1])) if len(s.split()) == 2 else None, lambda raw: raw.rlike("^[A-Z]+ "))
    t = FileTable(store, "log", LineSource(str(path), skip=1), parser).column("loud", "boolean", lambda raw: raw.contains("ERROR"))
    up = t.update()
    assert (up.rows_added, up.rebuilt, up.rows) == (2, False, 2)
    with path.open("a") as f:
        f.write("3\nERROR 4\n")
    up = t.update()
    assert (up.rows_added, up.rebuilt, up.rows) == (2, False, 4)
    assert t.update().rows_added == 0
    t.register()
    assert [tuple(r) for r in spark.sql("select level, n, loud, line from log order by line").collect()] == [("INFO", 1, False, 0), ("ERROR", 2, True, 2), ("INFO", 3, False, 3), ("ERROR", 4, True, 4)]
    path.write_text("other header\nWARN 9\n")
    up = t.update()
    assert (up.rebuilt, up.rows) == (True, 1)
    stop = CancelSignal()
    stop.cancel()
    path.write_text("other header\nWARN 9\nWARN 10\n")
    with pytest.raises(Cancelled):
        t.update(stop)
    assert t.df().count() == 1
    room = FileTables(store)
    assert room.size() > 0 and room.trim(0, frozenset({"log"})) == [] and room.trim(0) == ["log"]


def test_functions(spark):
    calls = spark.sparkContext.accumulator(0)

    def slow(v):
        calls.add(1)
        return v * 2

    udf.register(spark, "plus", "long", lambda a, b: a + b)
    udf.register_nullable(spark, "shown", "string", lambda a: "none" if a is None else str(a))
    udf.register_vectorised(spark, "half", "double", lambda a: a / 2)
    df = spark.sql("select plus(1, 2) a, plus(1, null) b, shown(cast(null as int)) c, half(3.0D) d, half(null) e")
    assert tuple(df.first()) == (3, None, "none", 1.5, None)
    values = spark.createDataFrame([(i % 3 if i % 4 else None,) for i in range(100)], "v long")
    out = udf.once_per_value(values, "v", "long", slow, "w")
    assert out.count() == 100 and out.filter("v IS NULL AND w IS NULL").count() == 25
    for bad in ("binary", "map<string,int>"):
        with pytest.raises(udf.UnsupportedType):
            udf.register(spark, "bad", bad, lambda a: a)
    with pytest.raises(udf.UnsupportedType):
        udf.register(spark, "bad", "long", lambda a, b, c, d: 1)


def test_remote_settings():
    s = ObjectStore.s3("http://host:9000").keys("id", "hidden").scope("s3a://data")
    assert s.settings() == {"fs.s3a.bucket.data.endpoint": "http://host:9000", "fs.s3a.bucket.data.path.style.access": "true", "fs.s3a.bucket.data.connection.ssl.enabled": "false", "fs.s3a.bucket.data.access.key": "id", "fs.s3a.bucket.data.secret.key": "hidden"}
    assert "hidden" not in repr(s) and ObjectStore.aws("eu-west-1").settings() == {"fs.s3a.endpoint.region": "eu-west-1"}
    c = IcebergCatalog.rest("http://host/").warehouse("w").oauth2("c", "s").retries(3)
    assert c.settings()["spark.sql.catalog.lake.uri"] == "http://host" and c.settings()["spark.sql.catalog.lake.credential"] == "c:s"
    assert len(c.tidy("db.t", 7)) == 3
    for bad in (lambda: ObjectStore.s3("host"), lambda: ObjectStore.aws("x").scope("/local")):
        with pytest.raises(ValueError):
            bad()


def test_metrics(spark, tmp_path):
    assert shape("SELECT a1, 'it''s', -2.5e3 FROM t2 WHERE x IN (1, 2,3) -- 5") == "SELECT a1, ?, ? FROM t2 WHERE x IN (?)"
    t = Timer()
    for i in range(1, 1001):
        t.add(i / 1000)
    assert t.quantile(0.5) == pytest.approx(0.5, rel=0.05) and t.quantile(1) == pytest.approx(1, rel=0.05)
    m = Metrics()
    for i in range(40):
        with m.timed(f"SELECT {i}"):
            pass
    before = m.snapshot()
    for _ in range(10):
        with pytest.raises(ZeroDivisionError), m.timed("SELECT 1/0"):
            1 / 0
    since = m.snapshot().minus(before)
    assert since.counters == {"errors": 10, "statements": 10} and list(since.timers) == ["SELECT ?/?"]
    assert [f.cause for f in diagnose(m.snapshot())] == [Cause.FAILING] and diagnose(since) == []
    busy = Snapshot(0, {}, {"statements": 100, "lost_races": 50, "changes": 100}, {"busy_cores": 8, "cores": 8})
    assert [f.cause for f in diagnose(busy)] == [Cause.LOST_RACES, Cause.FULL_CLUSTER]
    r = Recorder(str(tmp_path), keep_days=2)
    assert json.loads(open(r.write(since, dt.date(2024, 1, 1))).read())["counters"]["errors"] == 10
    assert r.delete_expired(dt.date(2024, 1, 3)) == [] and r.delete_expired(dt.date(2024, 1, 4)) == ["metrics-2024-01-01.jsonl"]
    board = Dashboard(m)
    try:
        base = f"http://127.0.0.1:{board.port}"
        assert "SELECT ?" in urllib.request.urlopen(base).read().decode()
        assert json.load(urllib.request.urlopen(f"{base}/metrics.json"))["counters"]["statements"] == 50
    finally:
        board.close()
    profile = QueryProfile.of(spark.range(100).filter("id % 2 = 0"))
    assert any(v.get("numOutputRows") == "50" for _, v in profile.operators)
