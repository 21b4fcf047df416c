"""Stores, collections, measures, journals and materializations: what is written, refused, exported and read back."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.collection import Collection
from tessera.guard import GuardedQuery
from tessera.journal import Journal
from tessera.materialization import Materialization
from tessera.measures import Dictionary, Field, Measure, MeasureError, MeasureHistory, MeasureRefresh, MeasureTable
from tessera.operators import predicates as P
from tessera.operators.paging import Pages
from tessera.plans.spread import spread
from tessera.queries.filed import Nation, _name, nations, place
from tessera.queries.models import _INC, _VALUES, LINES, _at, _filled, _once, _refreshes, _rounded, _values, scratch
from tessera.queries.registry import query
from tessera.queries.tables import Tables
from tessera.schema import columns
from tessera.store import BulkWriter, Store, StoreError


def refused(work) -> bool:
    try:
        work()
    except StoreError:
        return True
    return False


# tables


@query("bulk_writer", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'again' ELSE c_name END AS name FROM customer")
def bulk_writer(spark, d):
    """Rows in chunks; of rows that repeat a key the last one counts."""
    store = scratch(spark)
    store.change(lambda c: c.create("people", columns(id="long", name="string"), ["id"]))
    rows = Tables(spark, d).customer.select("c_custkey", "c_name").orderBy("c_custkey").collect()
    with BulkWriter(store, "people", chunk=1 + len(rows) // 3) as w:
        w.add_all(rows)
        w.add_all((r["c_custkey"], "again") for r in rows if r["c_custkey"] % 5 == 0)
    return store.read("people")


@query("bulk_import_refuses", "SELECT s_suppkey AS id, s_name AS name, true AS refused, (SELECT count(*) FROM supplier) AS written FROM supplier")
def bulk_import_refuses(spark, d):
    """New keys only: a second import of the same is an error and changes nothing."""
    store = scratch(spark)
    store.change(lambda c: c.create("suppliers", columns(id="long", name="string"), ["id"]))
    rows = [tuple(r) for r in Tables(spark, d).supplier.select("s_suppkey", "s_name").collect()]

    def load() -> int:
        with BulkWriter(store, "suppliers", new_keys=True) as w:
            w.add_all(rows)
        return w.written

    written, again = load(), refused(load)
    return store.read("suppliers").withColumns({"refused": F.lit(again), "written": F.lit(written).cast("long")})


@query("table_from_query", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 3")
def table_from_query(spark, d):
    """A query's result as a table, taken by the guard without its caps, and again in place of itself."""
    store, name = scratch(spark), _name("orders")
    Tables(spark, d).orders.createOrReplaceTempView(name)
    GuardedQuery(spark).store(f"SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM {name} GROUP BY o_custkey", store, "totals")
    store.change(lambda c: c.replace("totals", c.read("totals").filter("n > 3").drop("n")))
    return store.read("totals")


@query("deltas", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'late' WHEN o_orderkey % 2 = 0 THEN 'upserted' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 3 AND o_orderkey % 11 <> 5")
def deltas(spark, d):
    """Upserts, deletes and updates that write what they change: the first folder stays as it was written."""
    store = scratch(spark)
    o = Tables(spark, d).orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))

    def made(c):
        c.create("o", o.schema, ["o_orderkey"])
        c.append("o", o)

    store.change(made)
    first = store.state().tables["o"]["folders"][0]
    even = o.filter("o_orderkey % 2 = 0")
    store.change(lambda c: c.upsert("o", even.withColumn("status", F.lit("first")).unionAll(even.withColumn("status", F.lit("upserted")))))
    store.change(lambda c: c.delete_keys("o", o.filter("o_orderkey % 7 = 3").select("o_orderkey")))
    store.change(lambda c: c.update_where("o", "o_orderkey % 6 = 0", {"status": "late"}))
    store.change(lambda c: c.delete_where("o", "o_orderkey % 11 = 5"))
    entry = store.state().tables["o"]
    if entry["folders"][0] != first or len(entry["folders"]) != 3:
        raise AssertionError("the table was written anew")
    return store.read("o")


@query("change_made_again", "SELECT n_nationkey AS key, 2::BIGINT AS tries FROM nation UNION ALL SELECT r_regionkey + 100, 2 FROM region")
def change_made_again(spark, d):
    """A change that another writer was faster than is made again on what that one left."""
    t, store, tries = Tables(spark, d), scratch(spark), []
    n, r = t.nation.select(F.col("n_nationkey").alias("key")), t.region.select((F.col("r_regionkey") + 100).alias("key"))
    store.change(lambda c: c.replace("keys", n.limit(0)))

    def work(c):
        tries.append(c.number)
        if len(tries) == 1:
            Store(spark, store.files.root).change(lambda other: other.append("keys", r))
        c.append("keys", n)

    store.change(work)
    return store.read("keys").withColumn("tries", F.lit(len(tries)).cast("long"))


@query("sorted_rewrite", "SELECT o_orderdate, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000 GROUP BY o_orderdate")
def sorted_rewrite(spark, d):
    store = scratch(spark)
    store.change(lambda c: c.replace("o", Tables(spark, d).orders))
    store.sorted_rewrite("o", ["o_totalprice"], 4)
    return store.read("o").filter("o_totalprice BETWEEN 50000 AND 60000").groupBy("o_orderdate").agg(F.count("*").alias("n"))


@query("store_housekeeping", "SELECT 'noted' AS step, count(*) AS n FROM part UNION ALL SELECT 'compacted', count(*) FROM part UNION ALL SELECT 'files', 1 UNION ALL SELECT 'cleared', 0 UNION ALL SELECT 'tables', 0")
def store_housekeeping(spark, d):
    store, p = scratch(spark), Tables(spark, d).part
    store.change(lambda c: c.replace("part", p.filter("p_size < 20")))
    store.change(lambda c: c.append("part", p.filter("p_size >= 20 OR p_size IS NULL")))
    store.analyze("part")
    steps = [("noted", store.notes("part")["rows"])]
    store.compact("part")
    steps += [("compacted", store.read("part").count()), ("files", len(store.state().tables["part"]["folders"]))]
    store.clear("part")
    steps.append(("cleared", store.read("part").count()))
    store.drop("part")
    steps.append(("tables", len(store.names())))
    return spark.createDataFrame(steps, "step string, n long")


@query("described_names", "SELECT column_name FROM (DESCRIBE customer)")
def described_names(spark, d):
    """Names of a table's columns, from its description."""
    store = scratch(spark)
    store.change(lambda c: c.create("customer", Tables(spark, d).customer.schema, ["c_custkey"]))
    text = store.describe("customer")
    return spark.createDataFrame([(x.split()[0],) for x in text[text.index("(") + 1 : text.rindex(")")].split(", ")], "column_name string")


# collections


@query("objects_in_order", "SELECT 'sorted' AS kind, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) AS place, n_nationkey::BIGINT AS key FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'page', row_number() OVER (ORDER BY n_nationkey), n_nationkey FROM nation WHERE n_nationkey > 6 AND n_nationkey <= 13")
def objects_in_order(spark, d):
    c = Collection(scratch(spark), "nations", Nation).create()
    c.add_all(nations(spark, d))
    found = c.retrieve(~P.Equal("region", 2), [F.col("region").desc(), F.col("key")])
    rows = [("sorted", i + 1, x.key) for i, x in enumerate(found)] + [("page", i + 1, x.key) for i, x in enumerate(c.read_page(6, 7))]
    return spark.createDataFrame(rows, "kind string, place long, key long")


@query("page_bounded", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 30) UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey < 90 ORDER BY o_orderkey DESC LIMIT 30)")
def page_bounded(spark, d):
    """Pages after and before a key whose searches end near the key."""
    p = Pages(Tables(spark, d).orders.select("o_orderkey"), ["o_orderkey"], 30, bounded=True)
    rows = [*p.after((100,)).rows, *p.before((90,)).rows]
    if p.searches > 4:
        raise AssertionError("more searches than two for a page")
    return spark.createDataFrame([(r["o_orderkey"],) for r in rows], "o_orderkey long")


# measures


@query("archive_notes", "SELECT 'lines' AS measure, l_returnflag AS part, 4::BIGINT AS fields FROM lineitem GROUP BY l_returnflag")
def archive_notes(spark, d):
    table, at = _by_flag(spark, d), place(spark)
    for part in [r["part"] for r in table.parts().collect()]:
        table.archive(at, part)
    return table.archive_notes(at).select("measure", "part", F.size("fields").cast("long").alias("fields"))


def _by_flag(spark, d):
    table, values = MeasureTable(scratch(spark), LINES).create(), _values(spark, d)
    for i, flag in enumerate(sorted(r[0] for r in values.select("flag").distinct().collect())):
        table.append(values.filter(F.col("flag") == flag), part=flag, at=dt.datetime(2024, 1, 1 + i))
    return table


@query("archive_by_size", f"SELECT flag AS part, CASE WHEN flag = (SELECT max(l_returnflag) FROM lineitem) THEN 'table' ELSE 'files' END AS place, count(*) AS n FROM {_VALUES} GROUP BY flag")
def archive_by_size(spark, d):
    """Parts go to files, those written first before others, until the table is small enough; the last one stays."""
    table, at = _by_flag(spark, d), place(spark)
    table.archive_when_larger_than(at, 0)
    here = table.store.read(table.values_table).groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit("table").alias("place"), "n")
    return here.unionAll(table.archived(at).groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit("files"), "n"))


@query("unit_rule", f"SELECT unit, round(sum(value), 2) AS value, true AS mixed_refused FROM {_VALUES} GROUP BY unit")
def unit_rule(spark, d):
    table = _filled_once(spark, d)
    mixed = refused(lambda: table.query().rows("flag").df())
    out = None
    for unit in ("EUR", "USD"):
        one = table.query().rows().where("unit", unit).df().select(F.lit(unit).alias("unit"), F.round("value", 2).alias("value"))
        out = one if out is None else out.unionAll(one)
    return out.withColumn("mixed_refused", F.lit(mixed))


def _filled_again(spark, d):
    return _filled(spark, d)


_filled_once = _once(_filled_again)


@query("field_default", "SELECT source, year, round(sum(l_extendedprice), 2) AS value FROM (SELECT 'files' AS source, 'before' AS year, l_extendedprice FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'table', 'before', l_extendedprice FROM lineitem WHERE l_returnflag <> 'A') GROUP BY source, year")
def field_default(spark, d):
    """A field that older rows and files don't have reads as its default; without one it is refused."""
    narrow = Measure("flags", (Field("flag"),))
    store, at, t = scratch(spark), place(spark), Tables(spark, d).lineitem
    table = MeasureTable(store, narrow).create()
    lines = t.select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("flag"), "l_extendedprice")
    values = spread(lines, "record_id").groupBy("record_id", "flag").agg(F.sum("l_extendedprice").alias("value"))
    table.append(values.filter("flag = 'A'"), part="old")
    table.append(values.filter("flag <> 'A'"), part="new")
    table.archive(at, "old")
    if not refused(lambda: MeasureTable(store, Measure("flags", (Field("flag"), Field("year")))).migrate()):
        raise AssertionError("a field without a default was added")
    wider = MeasureTable(store, Measure("flags", (Field("flag"), Field("year", default="before")))).migrate()
    both = [wider.query().from_files(at), wider.query()]
    out = [q.rows("year").df().select(F.lit(s).alias("source"), "year", F.round("value", 2).alias("value")) for s, q in zip(("files", "table"), both, strict=True)]
    return out[0].unionAll(out[1])


_AS_OF = f"SELECT flag, unit, round(sum(value), 2) AS value FROM {_INC} GROUP BY flag, unit"


@query("history_files", _AS_OF)
def history_files(spark, d):
    """Refreshes shipped, exported by day, compacted and pruned; a pruned moment is read from the files alone."""
    table = _refreshes(spark, d)
    history, at = MeasureHistory(scratch(spark)), place(spark)
    MeasureRefresh(table.store, _at(12), "all anew").by("svc").full(table, _values(spark, d)).commit()
    if history.ship(table)[0] != 4 or history.export(table, at) != 4 or history.export(table, at) != 0:
        raise AssertionError("refreshes are shipped and exported once")
    if history.compact(table, at, dt.date(2024, 3, 1)) < 1 or not history.prune(table):
        raise AssertionError("there was something to compact and to prune")
    if not refused(lambda: table.query().rows("flag", "unit").as_of(_at(10), history).df()):
        raise AssertionError("a pruned moment was answered")
    return _rounded(table.query().rows("flag", "unit").as_of(_at(10), history).from_files(at).df(), "value")


@query("history_rebuild", f"SELECT flag, unit, round(sum(value), 2) AS value, 3::BIGINT AS forgotten FROM {_INC} GROUP BY flag, unit")
def history_rebuild(spark, d):
    """The live state set back to a moment of the history, whose ledger the live store then forgets."""
    table = _refreshes(spark, d)
    history = MeasureHistory(scratch(spark))
    if not refused(lambda: history.rebuild(table)):
        raise AssertionError("what waits to be shipped would be lost")
    history.ship(table)
    history.rebuild(table, _at(10))
    n = history.forget_shipped(table, dt.timedelta(hours=-1))
    return _rounded(table.query().rows("flag", "unit").df(), "value").withColumn("forgotten", F.lit(n).cast("long"))


@query(
    "refresh_once",
    f"SELECT attempt, outcome, round((SELECT sum(value) FROM {_INC} WHERE record_id NOT IN (1, 2, 3, 5, 35)), 2) AS total FROM (VALUES ('the same id', 'known'), ('an earlier moment', 'refused'), ('another writer', 'refused'), ('one measure twice', 'refused'), ('nothing', 'refused')) t(attempt, outcome)",
)
def refresh_once(spark, d):
    table = _refreshes(spark, d)
    refresh, empty = (lambda h, id: MeasureRefresh(table.store, _at(h), id)), spark.createDataFrame([], LINES.key_schema)
    attempts = {
        "the same id": lambda: refresh(12, "inc").by("svc").full(table, empty).commit(),
        "an earlier moment": lambda: refresh(8, "late").by("svc").full(table, empty).commit(),
        "another writer": lambda: refresh(12, "x").by("rival").full(table, empty).commit(),
        "one measure twice": lambda: refresh(12, "x").by("svc").full(table, empty).remove(table, [1]).commit(),
        "nothing": lambda: refresh(12, "x").by("svc").commit(),
    }

    def outcome(work) -> str:
        try:
            return "committed" if work() else "known"
        except MeasureError:
            return "refused"

    rows = spark.createDataFrame([(k, outcome(w)) for k, w in attempts.items()], "attempt string, outcome string")
    total = table.store.read(table.values_table).agg(F.round(F.sum("value"), 2).alias("total"))
    return rows.join(F.broadcast(total))


@query("measure_writes", f"SELECT unit, round(sum(value), 2) AS value, (SELECT count(*) FROM {_VALUES} WHERE record_id % 6 = 0 AND value <> 7) AS changed FROM (SELECT unit, CASE WHEN record_id % 6 = 0 THEN 7.0 WHEN record_id % 3 = 0 THEN 1.0 ELSE value END AS value FROM {_VALUES}) GROUP BY unit")
def measure_writes(spark, d):
    """Records replaced, then values appended where they differ from the last ones."""
    table, values = _filled(spark, d), _values(spark, d)
    table.replace(values.filter("record_id % 3 = 0").withColumn("value", F.lit(1.0)), at=dt.datetime(2024, 1, 2))
    seven = values.filter("record_id % 6 = 0").withColumn("value", F.lit(7.0))
    n = table.append_changes(seven, at=dt.datetime(2024, 1, 3))
    if table.append_changes(seven, at=dt.datetime(2024, 1, 4)):
        raise AssertionError("nothing had changed")
    return _rounded(table.query().rows("unit").latest_per_key().df(), "value").withColumn("changed", F.lit(n).cast("long"))


@query("dictionary_ids", "SELECT c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, row_number() OVER (ORDER BY c_mktsegment, c_nationkey::VARCHAR) AS id, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey")
def dictionary_ids(spark, d):
    pairs = Tables(spark, d).customer.select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    known = Dictionary(scratch(spark), "pairs", ["segment", "nation"]).create()
    known.resolve(pairs.limit(0))
    return known.resolve(pairs).groupBy("segment", "nation", "id").agg(F.count("*").alias("n"))


# journals, materializations


def _talk(spark, d, version=1):
    schema = columns(conv_id="long", turn="long", role="string", text="string")
    j = Journal(scratch(spark), "talk", schema, ["conv_id", "turn"], ["conv_id", "turn"], searchable=["text"]).open()
    j.append(Tables(spark, d).conversations.select("conv_id", "turn", "role", "text"))
    return j


@query("journal_search", "SELECT conv_id, turn, position('de' IN lower(text)) > 0 AS shown FROM conversations WHERE text ILIKE '%de%' AND text ILIKE '%la%' ORDER BY conv_id DESC, turn DESC LIMIT 25")
def journal_search(spark, d):
    """The newest records that have all words, with the words' surroundings."""
    hits = _talk(spark, d).search("DE la", limit=25)
    return spark.createDataFrame([(h.record["conv_id"], h.record["turn"], any(w in h.snippet.lower() for w in ("de", "la"))) for h in hits], "conv_id long, turn long, shown boolean")


@query("journal_pages", "SELECT conv_id, turn, 'none' AS mood, n FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS place, count(*) OVER () AS n FROM conversations WHERE role = 'user') WHERE place BETWEEN 6 AND 10")
def journal_pages(spark, d):
    """A journal brought to a new version, one role taken out, and its second page."""
    old = _talk(spark, d)
    j = Journal(old.store, "talk", old.schema, old.key, searchable=["text"]).open(2, {2: lambda df: df.withColumn("mood", F.lit("none"))})
    j.delete_where(F.col("role") != "user")
    if j.version() != 2 or not refused(lambda: old.open()):
        raise AssertionError("a newer journal was opened by an older program")
    pages = j.pages(5)
    page = pages.after(pages.first().last_key)
    return spark.createDataFrame([(r["conv_id"], r["turn"], r["mood"], j.count()) for r in page.rows], "conv_id long, turn long, mood string, n long")


@query("materialization_refresh", "SELECT o_orderstatus, count(*) AS n, true AS built, false AS rebuilt FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderstatus")
def materialization_refresh(spark, d):
    store, name = scratch(spark), _name("half")
    o = Tables(spark, d).orders
    o.filter("o_orderkey % 2 = 1").createOrReplaceTempView(name)
    m = Materialization(store, "per_status", f"SELECT o_orderstatus, count(*) AS n FROM {name} GROUP BY o_orderstatus")
    built, again = m.create_if_absent(), m.create_if_absent()
    reader = m.df()  # goes on with what it began with
    before = reader.count()
    o.filter("o_orderkey % 2 = 0").createOrReplaceTempView(name)
    if m.refresh_if_older_than(dt.timedelta(hours=1)) or not m.refresh_if_older_than(dt.timedelta(0)) or reader.count() != before:
        raise AssertionError("refreshed when it was young, or not when it was old")
    return m.df().withColumns({"built": F.lit(built), "rebuilt": F.lit(again)})
