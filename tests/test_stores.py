"""The versioned store, journals, sparse tables, materializations, streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.journal import Journal
from tessera.materialization import Materialization
from tessera.operators.aggregates import rollup_of
from tessera.schema import columns
from tessera.sparse import SparseBatch, SparseTable
from tessera.store import MOST_DELETES, BulkWriter, Conflict, Store, StoreError
from tessera.streaming.tail import append_to, fold_into, sessions, tail_files, windowed


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_store_changes(spark, store):
    rows = lambda a, b, v: spark.range(a, b).select("id", F.lit(v).alias("v"))
    store.change(lambda c: c.create("t", rows(0, 1, "a").schema, ["id"]))
    store.change(lambda c: c.insert("t", rows(0, 4, "a")))
    with pytest.raises(StoreError):
        store.change(lambda c: c.insert("t", rows(3, 5, "b")))
    store.change(lambda c: c.insert_missing("t", rows(3, 5, "b")))
    store.change(lambda c: c.upsert("t", rows(0, 2, "c")))
    assert pairs(store.read("t"), "id", "v") == [(0, "c"), (1, "c"), (2, "a"), (3, "a"), (4, "b")]
    old = store.read("t")  # a reader keeps the state it began with
    store.change(lambda c: c.delete_where("t", "id > 2"))
    store.change(lambda c: c.update_where("t", "id = 2", {"v": "z"}))
    store.change(lambda c: c.delete_keys("t", spark.createDataFrame([(0,)], "id long")))
    assert pairs(store.read("t"), "id", "v") == [(1, "c"), (2, "z")]
    assert old.count() == 5
    with pytest.raises(StoreError):
        store.change(lambda c: c.append("t", rows(0, 1, "a").withColumn("w", F.lit(1))))
    store.sorted_rewrite("t", ["id"])
    assert store.vacuum() == []  # nothing is old enough
    assert store.vacuum(idle=0) and store.read("t").count() == 2


def test_changes_show_together_or_not(spark, store):
    df = spark.range(3)

    def broken(c):
        c.replace("a", df)
        c.replace("b", df)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        store.change(broken)
    assert store.names() == []

    def both(c):
        c.replace("a", df)
        c.replace("b", df)

    store.change(both)
    assert store.names() == ["a", "b"]


def test_a_slower_writer_tries_again(spark, store):
    store.change(lambda c: c.replace("n", spark.range(1)))
    seen = []

    def slow(c):
        seen.append(c.number)
        if len(seen) == 1:  # someone else publishes in between
            Store(spark, store.files.root).change(lambda d: d.append("n", spark.range(1)))
        c.append("n", spark.range(1))

    store.change(slow)
    assert len(seen) == 2 and store.read("n").count() == 3

    def never(c):
        Store(spark, store.files.root).change(lambda d: d.note("n", x=1))
        c.note("n", y=1)

    store.TRIES = 2
    with pytest.raises(Conflict):
        store.change(never)


MESSAGE = columns(chat="long", seq="long", role="string", text="string")


def journal(store):
    return Journal(store, "chat", MESSAGE, ["chat", "seq"], sequence="seq", within=["chat"], searchable=["text"]).open()


def test_journal(spark, store):
    j = journal(store)
    j.append([(1, None, "user", "Hello big World"), (1, None, "bot", "100% sure_thing"), (2, None, "user", "other")])
    got = j.append_and_get([(1, None, "user", "world, goodbye")])
    assert [(r.chat, r.seq) for r in got] == [(1, 3)]
    assert [(r.seq, r.text) for r in j.pages(2, F.col("chat") == 1).first().rows] == [(1, "Hello big World"), (2, "100% sure_thing")]
    assert [h.record.seq for h in j.search("WORLD")] == [3, 1]
    assert [h.snippet for h in j.search("world hello")] == ["Hello big World"]
    assert [h.record.seq for h in j.search("100% sure_")] == [2]
    assert j.search("100%sure") == [] and j.search(" ") == []
    assert j.update((2, 1), {"text": "changed"}) and j.get(2, 1).text == "changed"
    assert j.delete(2, 1) and j.get(2, 1) is None and j.count() == 3
    with pytest.raises(StoreError):
        j.update((1, 1), {"seq": 9})


def test_journal_migrates(spark, store):
    journal(store).append([(1, None, "user", "a")])
    wider = Journal(store, "chat", MESSAGE, ["chat", "seq"])
    wider.open(2, {2: lambda df: df.withColumn("cost", F.lit(0.0))})
    assert wider.version() == 2 and wider.get(1, 1).cost == 0.0
    with pytest.raises(StoreError):
        journal(store)


def test_sparse(spark, store):
    t = SparseTable(store, "s").create()
    t.append(SparseBatch().record(1).put("a", 1).put("b", 2).record(2).put("c", 3))
    assert t.read(1) == {"a": 1.0, "b": 2.0}
    assert pairs(t.wide("a", "zz"), "record_id", "a", "zz") == [(1, 1.0, None)]
    t.replace(SparseBatch().record(1).put("c", 9))
    t.optimize()
    assert pairs(t.wide("a", "c"), "record_id", "c") == [(1, 9.0), (2, 3.0)]
    t.delete([2])
    assert t.attributes() == ["c"]
    with pytest.raises(StoreError):
        SparseBatch().record(1).put("a", 1).put("a", 2)


def test_materialization(spark, store):
    sales = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 4.0), ("y", 1, 6.0)], "make string, year int, price double")
    m = Materialization(store, "roll", lambda: rollup_of(sales, ["make", "year"], {"price": "price"}))
    assert m.is_older_than(dt.timedelta(days=1))
    assert m.create_if_absent() and not m.create_if_absent()
    assert not m.refresh_if_older_than(dt.timedelta(days=1))
    more = spark.createDataFrame([("x", 1, 10.0)], sales.schema)
    assert m.append_delta(rollup_of(more, ["make", "year"], {"price": "price"}), batch="b1")
    assert not m.append_delta(rollup_of(more, ["make", "year"], {"price": "price"}), batch="b1")
    assert pairs(m.answer(["make"], ["price"]), "make", "n", "price") == [("x", 3, 16.0), ("y", 1, 6.0)]
    assert m.row_count() == 4
    m.fold(["make", "year"], ["n", "price"])
    assert m.row_count() == 3
    m.drop()
    assert not store.exists("roll")


def test_streams(spark, store, tmp_path):
    events = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1, 0, 0)), (2, "a", dt.datetime(2024, 1, 1, 0, 1)), (3, "b", dt.datetime(2024, 1, 1, 2, 0))], "id long, k string, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: tail_files(spark, str(tmp_path / "in"), events.schema)
    append_to(stream(), store, "events", str(tmp_path / "c1")).awaitTermination()
    events.limit(1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    append_to(stream(), store, "events", str(tmp_path / "c1")).awaitTermination()
    assert store.read("events").count() == 4
    m = Materialization(store, "per_k", lambda: events.limit(0).groupBy("k").agg(F.count("*").alias("n")))
    m.create_if_absent()
    fold_into(stream(), m, lambda b: b.groupBy("k").agg(F.count("*").alias("n")), str(tmp_path / "c2")).awaitTermination()
    assert pairs(m.df().groupBy("k").agg(F.sum("n").alias("n")), "k", "n") == [("a", 3), ("b", 1)]
    assert pairs(windowed(events, "ts", "1 hour"), "n") == [(1,), (2,)]
    assert pairs(sessions(events, "ts", "30 minutes", ["k"]), "k", "n") == [("a", 2), ("b", 1)]


def test_bulk_writer_and_housekeeping(spark, store):
    schema = columns(id="long", v="string")
    store.change(lambda c: c.create("t", schema, ["id"]))
    with BulkWriter(store, "t", chunk=3) as w:
        w.add_all([(1, "a"), (2, "b"), (1, "c"), (3, "d"), (2, "e")])
    assert w.written == 3 and pairs(store.read("t"), "id", "v") == [(1, "c"), (2, "e"), (3, "d")]
    with pytest.raises(StoreError), BulkWriter(store, "t", new_keys=True) as w:
        w.add(1, "x")
    assert store.describe("t") == "t(id long, v string) key id"
    assert store.compact("t") == 1 and store.analyze("t")["rows"] == 3
    store.clear("t")
    assert store.read("t").count() == 0 and store.exists("t")
    store.drop("t")
    assert not store.exists("t")


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_a_dictionary(spark, store, seed):
    """Random upserts, deletes and updates by key and condition, each writing no more than what it changes."""
    rng = random.Random(seed)
    schema = columns(id="long", v="string", n="long")
    store.change(lambda c: c.create("t", schema, ["id"]))
    have = {}
    for step in range(24):
        kind = rng.choice(["upsert", "upsert", "delete", "where", "update", "insert"])
        ids = [rng.choice([None, *range(30)]) for _ in range(rng.randint(1, 6))]
        before = set(store.state().tables["t"]["folders"])
        if kind == "upsert":
            rows = [(i, f"{step}-{j}", j) for j, i in enumerate(ids)]
            have |= {r[0]: r[1:] for r in rows}
            store.change(lambda c: c.upsert("t", spark.createDataFrame(rows, schema)))
        elif kind == "insert":
            rows = [(i, "new", 0) for i in {*ids} - have.keys() if i is not None]
            have |= {r[0]: r[1:] for r in rows}
            store.change(lambda c: c.insert("t", spark.createDataFrame(rows, schema)))
        elif kind == "delete":
            have = {i: r for i, r in have.items() if i not in ids}
            store.change(lambda c: c.delete_keys("t", spark.createDataFrame([(i,) for i in ids], "id long")))
        elif kind == "where":
            have = {i: r for i, r in have.items() if r[1] != step % 4 or i is None}
            store.change(lambda c: c.delete_where("t", f"n = {step % 4} AND id IS NOT NULL"))
        else:
            have = {i: (f"u{step}", r[1]) if r[1] == step % 3 else r for i, r in have.items()}
            store.change(lambda c: c.update_where("t", f"n = {step % 3}", {"v": f"u{step}"}))
        entry = store.state().tables["t"]
        assert before <= set(entry["folders"]) or not entry["deletes"]  # nothing is written anew but by folding
        assert len(entry["deletes"]) <= MOST_DELETES
        if step % 6 == 5:
            assert pairs(store.read("t").fillna({"id": -1}), "id", "v", "n") == sorted((-1 if i is None else i, *r) for i, r in have.items())
    store.change(lambda c: c.update_where("t", "id < 5", {"id": F.col("id") + 100}))
    assert pairs(store.read("t").filter("id >= 100"), "id") == sorted((i + 100,) for i in have if i is not None and i < 5)
    store.vacuum(idle=0)
    assert store.read("t").count() == len(have)


def test_a_writer_that_fails_publishes_nothing(spark, store):
    store.change(lambda c: c.create("t", columns(id="long", v="string"), ["id"]))
    with pytest.raises(RuntimeError), BulkWriter(store, "t", chunk=2) as w:
        w.add_all([(1, "a"), (2, "b"), (3, "c")])
        raise RuntimeError
    assert store.read("t").count() == 0
    with BulkWriter(store, "t", chunk=2) as w:
        w.add_all((i % 50, f"{i}") for i in range(101))
    assert w.written == 50 and pairs(store.read("t").filter("id < 2"), "id", "v") == [(0, "100"), (1, "51")]
    assert len(store.state().tables["t"]["folders"]) == 1
