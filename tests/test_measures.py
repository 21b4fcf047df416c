"""Measures: answers held against sums over plain lists; refreshes, as-of reads, history, archives."""

import collections
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.measures import Batch, Dictionary, Field, Measure, MeasureError, MeasureHistory, MeasureRefresh, MeasureTable
from tessera.store import Store

SALES = Measure("sales", (Field("shop"), Field("size", ("small", "mid", "big")), Field("currency")), "currency")
SHOPS, SIZES, CURRENCIES = ("north", "south", "east"), ("big", "mid", "small", "extra"), ("SEK", "NOK")


def random_values(seed, records=range(8), each=5):
    """{(record, shop, size, currency): value}"""
    rng, keys = random.Random(seed), list(itertools.product(SHOPS, SIZES, CURRENCIES))
    return {(r, *k): float(rng.randint(-40, 90)) or 1.0 for r in records for k in rng.sample(keys, each)}


def batch(measure, values, records=()):
    b = Batch(measure)
    for r in sorted({k[0] for k in values} | set(records)):
        b.record(r)
        for k, v in values.items():
            if k[0] == r:
                b.put(v, *k[1:])
    return b


def table(store, values):
    t = MeasureTable(store, SALES).create()
    t.append(batch(SALES, values))
    return t


def totals(values, *places, where=lambda k: True):
    out = collections.defaultdict(float)
    for k, v in values.items():
        if where(k):
            out[tuple(k[p] for p in places)] += v
    return dict(out)


def answer(df):
    return {tuple(r[:-1]): r[-1] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_against_sums(spark, store, seed):
    values = random_values(seed)
    t = table(store, values)
    assert answer(t.query().rows("shop", "currency").df()) == totals(values, 1, 3)
    assert answer(t.query().rows("size").where("currency", "SEK").records([0, 3, 5]).df()) == totals(values, 2, where=lambda k: k[3] == "SEK" and k[0] in (0, 3, 5))
    some = spark.createDataFrame([(2,), (2,), (7,)], "record_id long")
    assert answer(t.query().rows("record_id", "currency").records(some).df()) == totals(values, 0, 3, where=lambda k: k[0] in (2, 7))
    assert answer(t.query().rows("shop").where("currency", "NOK").where("shop", "east", "west").df()) == totals(values, 1, where=lambda k: k[3] == "NOK" and k[1] == "east")
    assert t.query().rows("shop").where("currency", "SEK").records([]).df().count() == 0


def test_pivot_in_declared_order(spark, store):
    values = random_values(3)
    t = table(store, values)
    q = t.query().rows("shop").columns("size").where("currency", "NOK").df()
    want = totals(values, 1, 2, where=lambda k: k[3] == "NOK")
    seen = {k[1] for k in want}
    assert q.columns == ["shop", *[s for s in ("small", "mid", "big", "extra") if s in seen]]
    assert {(r["shop"], s): r[s] for r in q.collect() for s in q.columns[1:] if r[s] is not None} == want
    sizes = [r["size"] for r in t.query().rows("size").where("currency", "SEK").df().collect()]
    assert sizes == sorted(sizes, key=lambda s: ("small", "mid", "big").index(s) if s in ("small", "mid", "big") else 3)


def test_units(spark, store):
    values = random_values(4)
    t = table(store, values)
    for mixed in (t.query().rows("shop"), t.query().rows("shop").where("currency", "SEK", "NOK")):
        with pytest.raises(MeasureError):
            mixed.df()
    rates = spark.createDataFrame([("SEK", "EUR", 0.125), ("NOK", "EUR", 0.25), ("EUR", "SEK", 8.0)], "unit string, to_unit string, factor double")
    factor = {"SEK": 0.125, "NOK": 0.25}
    worth = {k: v * factor[k[3]] for k, v in values.items()}
    assert answer(t.query().rows("shop").convert_to("EUR", rates).df()) == totals(worth, 1)
    assert answer(t.query().rows("shop").convert_to("EUR", rates.filter("unit <> 'NOK'")).df()) == totals(worth, 1, where=lambda k: k[3] == "SEK")


def test_replace_append_changes_parts(spark, store):
    values = random_values(5)
    t = table(store, values)
    new = random_values(6, records=(1, 2))
    t.replace(batch(SALES, new, records=(1, 2, 4)), part="again")
    values = {k: v for k, v in values.items() if k[0] not in (1, 2, 4)} | new
    assert answer(t.query().rows("record_id", "currency").df()) == totals(values, 0, 3)
    assert t.append_changes(batch(SALES, values)) == 0
    changed = {k: v + 1 for k, v in values.items() if k[0] == 3}
    assert t.append_changes(batch(SALES, values | changed), part="later", at=dt.datetime(2100, 1, 1)) == len(changed)
    assert answer(t.query().rows("record_id", "currency").latest_per_key().df()) == totals(values | changed, 0, 3)
    counts = collections.Counter("again" if k in new else "" for k in values) + collections.Counter({"later": len(changed)})
    assert {r["part"]: r["values"] for r in t.parts().collect()} == dict(counts)
    assert (t.value_count(), t.record_count(), t.key_count()) == (len(values) + len(changed), len({k[0] for k in values}), len({k[1:] for k in values}))
    t.delete_records([3])
    assert answer(t.query().rows("record_id", "currency").df()) == totals({k: v for k, v in values.items() if k[0] != 3}, 0, 3)


def test_archives(spark, store, tmp_path):
    values, old = random_values(7), random_values(8, records=(50, 51))
    t = table(store, values)
    t.append(batch(SALES, old), part="old year")
    place = str(tmp_path / "archive")
    assert t.archive(place, "old year") == len(old) and t.archive(place, "none") == 0
    assert t.value_count() == len(values)
    assert answer(t.query().from_files(place).rows("shop", "currency").df()) == totals(old, 1, 3)
    assert [tuple(r) for r in t.archive_notes(place).collect()] == [("sales", "old year", ["shop", "size", "currency"])]
    for _ in range(2):  # put back in place of what is there
        assert t.restore(place) == len(old) and t.value_count() == len(values) + len(old)
    assert t.archive_when_larger_than(place, 0) == [""]  # the part written first; the last one stays
    assert t.value_count() == len(old)


def test_batches_refuse():
    for wrong in (lambda: Batch(SALES).put(1, "north", "big", "SEK"), lambda: Batch(SALES).record(1).put(1, "north"), lambda: Batch(SALES).record(1).put(None, "north", "big", "SEK"), lambda: batch(SALES, {(1, "north", "big", "SEK"): 2.0}).put(3, "north", "big", "SEK")):
        with pytest.raises(MeasureError):
            wrong()


STOCK = Measure("stock", (Field("item"), Field("place")))


class Log:
    """What refreshes did, kept as plain states by hour."""

    def __init__(self, store):
        self.store, self.table, self.states, self.now = store, MeasureTable(store, STOCK).create(), {}, {}

    def refresh(self, hour, name, kind, values=None, records=()):
        r = MeasureRefresh(self.store, at(hour), name).by("feed")
        if kind == "remove":
            done = r.remove(self.table, records).commit()
            touched = set(records)
        else:
            done = getattr(r, kind)(self.table, batch(STOCK, values, records)).commit()
            touched = {k[0] for k in values} | set(records) if kind == "increment" else {k[0] for k in self.now}
        if done:
            self.now = {k: v for k, v in self.now.items() if k[0] not in touched} | (values or {})
            self.states[hour] = self.now
        return done


def at(hour):
    return dt.datetime(2023, 6, 14, hour, 30)


def stock(seed, records, each=3):
    rng = random.Random(seed)
    return {(r, i, p): float(rng.randint(1, 60)) for r in records for i, p in rng.sample(list(itertools.product("abc", ("shelf", "store"))), each)}


def filled(store):
    log = Log(store)
    first = stock(1, range(6))
    assert log.refresh(1, "morning", "full", first)
    assert log.refresh(3, "fix", "increment", {k: v + 2 for k, v in first.items() if k[0] == 2} | stock(2, [9]))
    assert log.refresh(4, "gone", "remove", records=[0, 5, 77])
    assert log.refresh(6, "wide", "increment", stock(3, [1, 2, 10]), records=[3])
    return log


def state(t, hour, history=None, files=()):
    q = t.query().rows("record_id", "item", "place").as_of(at(hour), history)
    return answer((q.from_files(*files) if files else q).df())


def check(log, history=None, files=()):
    for hour in range(8):
        want = next((s for h, s in sorted(log.states.items(), reverse=True) if h <= hour), {})
        assert state(log.table, hour, history, files) == want, hour


def test_states_at_any_hour(spark, store):
    log = filled(store)
    check(log)
    assert answer(log.table.query().rows("record_id", "item", "place").df()) == log.now
    zeros = answer(log.table.query().rows("record_id", "item", "place").as_of(at(4)).show_zeros().df())
    assert {k: v for k, v in zeros.items() if v} == log.states[4] and all(k in zeros for k in log.states[1])
    moved = collections.Counter(r.refresh_id for r in store.read("stock_contribution").collect())
    differs = lambda a, b: sum(a.get(k, 0) != b.get(k, 0) for k in a.keys() | b.keys())
    assert moved == {"morning": len(log.states[1]), "fix": differs(log.states[1], log.states[3]), "gone": differs(log.states[3], log.states[4]), "wide": differs(log.states[4], log.states[6])}


def test_refreshes_refuse(spark, store):
    log = filled(store)
    assert not log.refresh(6, "fix", "increment", stock(9, [1]))  # committed before
    with pytest.raises(MeasureError):
        log.refresh(2, "late", "full", stock(9, [1]))
    with pytest.raises(MeasureError):
        MeasureRefresh(store, at(9), "x").by("rival").full(log.table, Batch(STOCK).record(1)).commit()
    with pytest.raises(MeasureError):
        MeasureRefresh(store, at(9), "none").commit()
    with pytest.raises(MeasureError):
        MeasureRefresh(store, at(9), "two").full(log.table, Batch(STOCK)).remove(log.table, [1])
    check(log)


def test_history(spark, store, tmp_path):
    log = filled(store)
    t, history = log.table, MeasureHistory(Store(spark, str(tmp_path / "history")))
    waiting = store.read("stock_contribution").count()
    assert history.ship(t) == (4, waiting) and history.ship(t) == (0, 0)
    check(log, history)
    log.refresh(7, "next day", "full", stock(5, range(4)))
    check(log, history)  # the last one waits in the live store
    with pytest.raises(MeasureError):
        history.rebuild(t)
    history.ship(t)
    assert history.rebuild(t, at(4)) == len(log.states[4])
    assert answer(t.query().rows("record_id", "item", "place").df()) == log.states[4]
    files = str(tmp_path / "files")
    assert history.export(t, files) == 5 and history.export(t, files) == 0
    assert history.prune(t) == waiting
    with pytest.raises(MeasureError):
        state(t, 3, history)
    check(log, history, (files,))
    assert history.forget_shipped(t, dt.timedelta(hours=-1)) == 5
    assert not MeasureRefresh(store, at(7), "next day").by("feed").full(t, Batch(STOCK).record(3)).commit(history)


def test_exports_are_written_once(spark, store, tmp_path):
    """A lost race, a crash before files are moved, and compaction leave every refresh in the files once."""
    log = filled(store)
    t, other = log.table, Store(spark, str(tmp_path / "history"))
    history, files, raced = MeasureHistory(other), str(tmp_path / "files"), []
    history.ship(t)
    plain = other.files.create

    def slow(name, text):
        if not raced:
            raced.append(name)
            Store(spark, other.files.root).change(lambda c: c.create("someone", c.schema("stock_contribution")))
        return plain(name, text)

    other.files.create = slow
    assert history.export(t, files) == 4 and raced
    rows = spark.read.parquet(f"{files}/measure=stock")
    assert rows.select("refresh_id").distinct().count() == 4 and rows.filter("record_id IS NOT NULL").count() == other.read("stock_contribution").count()
    log.refresh(7, "next", "increment", stock(6, [1, 2]))
    history.ship(t)
    settle, MeasureHistory._settle = MeasureHistory._settle, lambda *_: None  # ends before its files are moved
    try:
        history.export(t, files)
    finally:
        MeasureHistory._settle = settle
    assert spark.read.parquet(f"{files}/measure=stock").count() == rows.count()
    assert history.export(t, files) == 0
    check(log, None, (files,))
    day = dt.date(2023, 6, 14)
    n = history.compact(t, files, day)
    assert n > 1 and history.compact(t, files, day) == 1
    check(log, None, (files,))


def test_an_empty_full_set_ships(spark, store, tmp_path):
    log = filled(store)
    log.refresh(7, "cleared", "full", {}, records=[1])
    history = MeasureHistory(Store(spark, str(tmp_path / "history")))
    history.ship(log.table)
    assert state(log.table, 7, history) == {}


def test_fields_are_added(spark, store):
    t = MeasureTable(store, STOCK).create()
    t.append(batch(STOCK, stock(1, [1, 2])))
    wider = Measure("stock", (*STOCK.fields, Field("owner", default="us")))
    assert answer(MeasureTable(store, wider).migrate().query().rows("owner").df()) == {("us",): sum(stock(1, [1, 2]).values())}
    with pytest.raises(MeasureError):
        MeasureTable(store, STOCK).migrate()
    with pytest.raises(MeasureError):
        MeasureTable(store, Measure("stock", (*wider.fields, Field("no_default")))).migrate()


def test_dictionary(spark, store):
    d = Dictionary(store, "pairs", ["left", "right"]).create()
    first = spark.createDataFrame([("p", "q"), ("p", None), ("p", "q")], "left string, right string")
    again = spark.createDataFrame([("r", "s"), ("p", None)], "left string, right string")
    ids = {(r.left, r.right): r.id for df in (first, again, first) for r in d.resolve(df).collect()}
    assert sorted(ids.values()) == [1, 2, 3] and ids[("r", "s")] == 3
    assert d.resolve(first).count() == 3 and store.read("pairs").agg(F.count_distinct("id")).first()[0] == 3
