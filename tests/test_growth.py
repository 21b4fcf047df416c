"""What a task or the driver holds doesn't grow with the table."""

import pytest

from tessera import guard
from tessera.guard import GuardedQuery, QueryPolicy, Rejected, WhenOver


@pytest.mark.parametrize("sql", ["select id from range(5000) order by id", "select cast(id + 1000 as string) s from range(5000) order by id"])
def test_a_cap_of_bytes_bounds_what_the_driver_reads(spark, monkeypatch, sql):
    read = []

    def spied(name):
        real = getattr(guard.Rows, name, None)

        def call(self, *args):
            found = real(self, *args)
            read.append(len(found))
            return found

        if real is not None:
            monkeypatch.setattr(guard.Rows, name, call)

    spied("collect"), spied("until")
    policy = QueryPolicy(max_rows=1 << 30, max_bytes=100, timeout=60)
    with pytest.raises(Rejected, match="bytes"):
        GuardedQuery(spark, policy).run(sql)
    cut = GuardedQuery(spark, guard.relaxed(policy, when_over=WhenOver.TRUNCATE)).run(sql)
    assert cut.truncated and [str(r[0]) for r in cut.rows] == [str(i + (1000 if "string" in sql else 0)) for i in range(len(cut.rows))]
    assert len(cut.rows) in (12, 25) and max(read) <= 101


def test_rows_without_bytes_are_read_to_the_end(spark):
    got = GuardedQuery(spark, QueryPolicy(max_rows=1 << 30, max_bytes=10, timeout=60)).run("select '' s from range(3000)")
    assert len(got.rows) == 3000 and not got.truncated


def test_no_sketch_for_each_distinct_key(spark):
    from tessera.queries import QUERIES

    plan = QUERIES["agg_approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "approx_count_distinct" in plan
    assert not [line for line in plan.splitlines() if "keys=[o_custkey" in line and "approx_count_distinct" in line]


def most_rows_of_a_task(df) -> int:
    from pyspark.sql import functions as F

    return df.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]


def test_sums_per_key_get_as_many_tasks_as_their_bytes_call_for(spark, store, monkeypatch):
    from tessera.measures import Field, Measure, MeasureTable, as_rows
    from tessera.plans import spread

    monkeypatch.setattr(spread, "TASK_BYTES", 2_000)
    measure = Measure("grown", (Field("kind"),))
    table = MeasureTable(store, measure).create()
    rows = spark.range(20_000).selectExpr("id AS record_id", "'a' AS kind", "CAST(id AS DOUBLE) AS value")
    table.append(rows)
    stored = store.read("grown_value")
    assert spread.tasks_for(stored) > 30
    checked = as_rows(measure, stored, spark)[0]
    sums = table.query().rows("record_id").df()
    assert most_rows_of_a_task(checked) < 20_000 / 20 and sums.count() == 20_000
    # dealt out once, and not again for a sum per key
    assert spread.spread(checked, "record_id") is checked
    assert checked.groupBy("record_id", "kind").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_long_lists_of_deleted_keys_and_nulls(spark, store, monkeypatch):
    from tessera import store as stores
    from tessera.plans import spread
    from tessera.schema import columns

    monkeypatch.setattr(stores, "FEW_KEYS", 3), monkeypatch.setattr(spread, "TASK_BYTES", 100)
    rows = [(i % 50 if i % 7 else None, str(i % 3) if i % 5 else None) for i in range(200)]
    gone = [(i if i % 4 else None, None if i % 3 else "1") for i in range(60)]
    store.change(lambda c: (c.create("t", columns(a="long", b="string")), c.append("t", spark.createDataFrame(rows, "a long, b string"))))
    store.change(lambda c: c.delete_keys("t", spark.createDataFrame(gone, "a long, b string")))
    left = store.read("t")
    assert sorted(map(tuple, left.collect()), key=repr) == sorted((r for r in rows if r not in set(gone)), key=repr)
    plan = left._jdf.queryExecution().executedPlan().toString()
    parts = [int(x.split(",")[0].split(")")[0]) for x in plan.replace("REPARTITION", "\nREPARTITION").split("hashpartitioning(_k")[1:] for x in [x.split(", ", 1)[1]]]
    assert parts and min(parts) > 8  # more than the session's shuffle partitions


def test_a_day_is_exported_in_many_files_and_compacted(spark, store, tmp_path, monkeypatch):
    import datetime as dt

    from tessera import measures
    from tessera.measures import Field, Measure, MeasureHistory, MeasureRefresh, MeasureTable
    from tessera.plans import spread
    from tessera.store import Store

    monkeypatch.setattr(spread, "TASK_BYTES", 4_000), monkeypatch.setattr(measures, "FILE_BYTES", 40_000)
    table = MeasureTable(store, Measure("grown", (Field("colour"),))).create()
    at = lambda h: dt.datetime(2024, 3, 1, h)
    rows = spark.range(20_000).selectExpr("id AS record_id", "'a' AS colour", "CAST(id AS DOUBLE) AS value")
    MeasureRefresh(store, at(9), "full").full(table, rows).commit()
    MeasureRefresh(store, at(10), "none").remove(table, [-1]).commit()  # changes nothing, and is exported too
    history, place = MeasureHistory(Store(spark, str(tmp_path / "past"))), str(tmp_path / "files")
    assert history.ship(table) == (2, 20_000) and history.export(table, place) == 2
    files = lambda: sum(1 for _ in (tmp_path / "files" / "measure=grown" / "day=2024-03-01").glob("*.parquet"))
    many = files()
    assert many > 8
    assert history.compact(table, place, dt.date(2024, 3, 1)) == many and 1 <= files() < many
    assert {r["refresh_id"] for r in spark.read.parquet(place).select("refresh_id").distinct().collect()} == {"full", "none"}
    got = table.query().rows().as_of(at(11), history).from_files(place).df().first()
    assert got["value"] == sum(range(20_000))
