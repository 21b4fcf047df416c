"""Predicates, joins, aggregates, order, paging and vectors on small tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import predicates as P
from tessera.operators.ordering import ascending, declared, descending, numbered
from tessera.operators.paging import Pages, ResultWindow
from tessera.operators.vector import Metric, VectorIndex, VectorSearch


@pytest.fixture(scope="module")
def cars(spark):
    rng = random.Random(7)
    makers = ["Ford", "Honda", "Toyota", "BMW", None]
    rows = [(i, rng.choice(makers), rng.choice(["RED", "BLUE", None]), rng.choice([3, 5]), round(rng.uniform(0, 100), 2), [rng.choice("abc") for _ in range(rng.randint(0, 3))] or None) for i in range(300)]
    return spark.createDataFrame(rows, "id long, make string, color string, doors int, price double, tags array<string>").cache()


def brute(p, r):
    """The predicate on a row, in plain Python; comparisons with null match nothing."""
    if isinstance(p, (P.And, P.Or)):
        return (all if isinstance(p, P.And) else any)(brute(q, r) for q in p.parts)
    if isinstance(p, P.Not):
        return not brute(p.parts[0], r)
    if isinstance(p, P.All):
        return True
    v = r[p.attribute]
    if isinstance(p, P.Has):
        return bool(v) if isinstance(v, list) else v is not None
    tests = {
        P.Equal: lambda x: x == p.value,
        P.In: lambda x: x in p.values,
        P.LessThan: lambda x: x < p.value or p.inclusive and x == p.value,
        P.GreaterThan: lambda x: x > p.value or p.inclusive and x == p.value,
        P.Between: lambda x: p.low < x < p.high or p.low_inclusive and x == p.low or p.high_inclusive and x == p.high,
        P.StartsWith: lambda x: x.startswith(p.prefix),
    }
    return any(tests[type(p)](x) for x in (v if isinstance(v, list) else [v]) if x is not None) if v is not None else False


def random_predicate(rng, depth=0):
    if depth < 3 and rng.random() < 0.6:
        kind = rng.choice([P.And, P.Or, P.Not])
        return P.Not(random_predicate(rng, depth + 1)) if kind is P.Not else kind(random_predicate(rng, depth + 1), random_predicate(rng, depth + 1))
    return rng.choice(
        [
            P.Equal("make", "Ford"),
            P.In("make", ("Ford", "BMW")),
            P.In("make", ()),
            P.LessThan("price", 40.0, True),
            P.GreaterThan("price", 60.0),
            P.Between("price", 20.0, 80.0, rng.random() < 0.5, rng.random() < 0.5),
            P.StartsWith("make", "T"),
            P.Has("color"),
            P.Has("tags"),
            P.Equal("tags", "a"),
            P.Equal("doors", 3),
            P.All(),
        ]
    )


def test_predicates_against_plain_python(cars):
    rng, rows = random.Random(1), cars.collect()
    for _ in range(40):
        p = random_predicate(rng)
        assert {r.id for r in P.select(cars, p).collect()} == {r.id for r in rows if brute(p, r)}


def test_existence(spark, cars):
    makers = spark.createDataFrame([("Ford", "US"), ("BMW", "DE"), ("Ford", "US"), (None, "XX")], "name string, country string")
    ids = lambda p: {r.id for r in P.select(cars, p).collect()}
    rows = cars.collect()
    known = P.ExistsIn(makers, "make", "name")
    german = P.ExistsIn(makers, "make", "name", P.Equal("country", "DE"))
    assert ids(known) == {r.id for r in rows if r.make in ("Ford", "BMW")}
    assert ids(~known) == {r.id for r in rows if r.make not in ("Ford", "BMW")}  # null makes too
    assert ids(german | P.LessThan("price", 10.0)) == {r.id for r in rows if r.make == "BMW" or r.price < 10}
    assert ids(~(german & P.Equal("doors", 3)) & known) == {r.id for r in rows if r.make in ("Ford", "BMW") and not (r.make == "BMW" and r.doors == 3)}


def test_filter_function_and_statistics(cars):
    rows = cars.collect()
    assert P.select(cars, P.Filter("make", lambda m: len(m) == 4)).count() == sum(r.make == "Ford" for r in rows)
    stats = [(r.tags, r.n) for r in P.key_statistics(cars, "tags", "a", "b", descending=True).collect()]
    assert stats == [(t, sum(t in (r.tags or []) for r in rows)) for t in "ba"]


def test_plain_filters_reach_the_scan(spark, cars, tmp_path):
    cars.write.parquet(str(tmp_path / "cars"))
    df = P.select(spark.read.parquet(str(tmp_path / "cars")), P.Equal("doors", 3) & P.StartsWith("make", "F")).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(doors,3)" in plan and "StringStartsWith(make,F)" in plan


def minute(m):
    return None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 3000, 10)])) for i in range(200)]
    right = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 3000, 30)]), rng.choice([None, i / 2])) for i in range(150)]
    ldf = spark.createDataFrame([(i, k, minute(t)) for i, k, t in left], "id long, k string, ts timestamp_ntz")
    rdf = spark.createDataFrame([(i, k, minute(t), v) for i, k, t, v in right], "rid long, k string, ts timestamp_ntz, v double")
    want = {}
    for i, k, t in left:
        met = [r for r in right if k is not None and t is not None and r[1] == k and r[2] is not None and r[2] <= t]
        best = max(met, key=lambda r: (r[2], r[0]), default=None)
        want[i] = None if best is None else (best[0], best[3])
    for how in ("left", "inner"):
        plain = J.asof(ldf, rdf, ["k"], "ts", "ts", ["rid", "v"], how, tie=["rid"])
        salted = J.asof_salted(ldf.dropna(), rdf, ["k"], "ts", "ts", ["rid", "v"], "4 hours", how, tie=["rid"])
        got = {r.id: None if r.rid is None else (r.rid, r.v) for r in plain.collect()}
        assert got == (want if how == "left" else {i: w for i, w in want.items() if w})
        some = {r.id: None if r.rid is None else (r.rid, r.v) for r in salted.collect()}
        assert some == {i: w for i, w in got.items() if left[i][1] is not None and left[i][2] is not None}


def test_differences_and_rates(spark):
    old = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, v double")
    new = spark.createDataFrame([(1, 1.0), (2, None), (4, None), (3, 9.0)], "k long, v double")
    assert sorted((r.k, r.old, r.new) for r in J.differences(old, new, ["k"], "v").collect()) == [(3, 3.0, 9.0), (4, None, None)]
    assert sorted((r.k, r.v) for r in J.changed_rows(old, new, ["k"], "v").collect()) == [(3, 9.0), (4, None)]


def test_pivots(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", None), ("b", None, 5.0)], "g string, p string, v double")
    out = A.pivot(df, ["g"], "p", {"n": F.count("*"), "s": F.sum("v")}).orderBy("g")
    assert out.columns == ["g", "x_n", "x_s", "y_n", "y_s"]
    assert [tuple(r) for r in out.collect()] == [("a", 1, 1.0, 1, 2.0), ("b", 1, None, 0, None)]
    with pytest.raises(ValueError):
        A.pivot(df, ["g"], "p", {"n": F.count("*")}, most=1)
    long = A.unpivot(out.select("g", "x_s", "y_s"), ["g"], ["x_s", "y_s"])
    assert sorted((r["g"], r["name"], r["value"]) for r in long.collect()) == [("a", "x_s", 1.0), ("a", "y_s", 2.0)]
    assert [r.t for r in out.select(A.row_total(["x_s", "y_s"]).alias("t")).collect()] == [3.0, None]


def test_summary(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, [2]), (3, "c", None)], "n int, s string, l array<int>")
    out = {r.column_name: r for r in A.summarize(df).collect()}
    assert (out["n"].min, out["n"].max, out["n"].avg, out["n"].q50) == ("1", "3", 2.0, 2.0)
    assert (out["s"].approx_unique, out["s"].null_percentage, out["l"].null_percentage) == (2, 33.33, 33.33)
    assert [r["count"] for r in A.summarize(df.limit(0)).collect()] == [0, 0, 0]


def test_order(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["10y", None, "2y", "zz", "aa", "5y"])], "i long, v string")
    got = [r.v for r in df.orderBy(*declared("v", ["2y", "5y", "10y"])).collect()]
    assert got == ["2y", "5y", "10y", "aa", "zz", None]
    assert [r.v for r in df.orderBy(*descending("v")).collect()][-1] is None
    many = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000).repartition(7)
    assert all(r.x == r.p for r in numbered(many, [F.col("x")], "p", 5).collect())


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 3), f"m{i}") for i in range(50)]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, text string").repartition(4).cache()


@pytest.mark.parametrize("down", [frozenset(), frozenset({"ts"}), frozenset({"ts", "id"})])
def test_pages_walk_the_whole_order(messages, down):
    pages = Pages(messages, ["ts", "id"], 7, down)
    want = [r.id for r in messages.orderBy(*pages.sort()).collect()]
    page, seen = pages.first(), []
    assert not page.has_before
    while True:
        seen += [r.id for r in page.rows]
        if not page.has_after:
            break
        page = pages.after(page.last_key)
        assert page.has_before
    assert seen == want
    page, back = pages.last(), []
    while True:
        back = [r.id for r in page.rows] + back
        if not page.has_before:
            break
        page = pages.before(page.first_key)
        assert page.has_after
    assert back == want


def test_page_positions(messages):
    pages = Pages(messages, ["ts", "id"], 5)
    key = (dt.datetime(2024, 1, 1, 0, 0, 4), 13)
    assert pages.position(key) == 13 and pages.count() == 50
    assert [r.id for r in pages.around(key, 2).rows] == [11, 12, 13, 14, 15]
    assert [r.id for r in pages.around((key[0], 100), 1).rows] == [14, 15]
    at = pages.at(45)
    assert [r.id for r in at.rows] == [45, 46, 47, 48, 49] and at.has_before and not at.has_after
    assert pages.at(99).rows == [] and Pages(messages.limit(0), ["ts", "id"], 5).first().rows == []


def test_result_window(messages):
    w = ResultWindow(messages, [F.col("id")])
    assert len(w) == 50 and [r.id for r in w.rows(48, 10)] == [48, 49]
    w.sort("text", descending=True)
    assert [r.id for r in w.rows(0, 2)] == [9, 8] and w.value(0, "text") == "m9"
    w.unsort()
    assert w.value(3, "id") == 3
    w.close()


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [3.0, 4.0]), (3, "b", [0.0, 0.0]), (4, "b", [1.0]), (5, "b", None)], "id int, c string, v array<float>")
    top = lambda metric, q, k=9, where=None: [(r.id, r.score) for r in VectorSearch(df, "v", "id").metric(metric).top_k(q, k, where).collect()]
    assert top(Metric.EUCLIDEAN, [0.0, 0.0]) == [(3, 0.0), (1, 1.0), (2, 5.0)]
    assert top(Metric.COSINE, [1.0, 0.0]) == [(1, 1.0), (2, pytest.approx(0.6))]
    assert top(Metric.INNER_PRODUCT, [1.0, 1.0], 1) == [(2, 7.0)]
    assert top(Metric.EUCLIDEAN, [0.0, 0.0], 9, F.col("c") == "a") == [(1, 1.0), (2, 5.0)]
    with pytest.raises(ValueError):
        VectorSearch(df, "v", "id", dimensions=2).top_k([1.0], 1)


def test_vector_index(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    index = VectorIndex.build(df, "embedding", "vec_id", str(tmp_path / "index"), lists=8)
    assert spark.read.parquet(str(tmp_path / "index")).count() == df.count()
    for r in df.limit(5).collect():
        exact = [x.vec_id for x in VectorSearch(df, "embedding", "vec_id").top_k(list(r.embedding), 5).collect()]
        assert [x.vec_id for x in index.top_k(list(r.embedding), 5, probes=8).collect()] == exact
        assert len(set(exact) & {x.vec_id for x in index.top_k(list(r.embedding), 5).collect()}) >= 4


@pytest.mark.parametrize("kept", [0, 10**9])
def test_quantiles_both_ways(spark, kept):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1e3) for _ in range(500)], "b": [5.0] * 40, "c": [float(rng.randint(0, 3)) for _ in range(90)], "d": [1.0], "e": [1e300, -1e300, *[rng.random() for _ in range(200)]], None: [2.0, 4.0], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.low, r.mid, r.high) for r in A.quantiles(df, ["g"], "v", {"low": 0.0, "mid": 0.5, "high": 0.93}, kept=kept).collect()}
    for g, vs in groups.items():
        want = tuple(float(np.quantile(vs, q)) for q in (0.0, 0.5, 0.93)) if vs else (None, None, None)
        assert got[g] == (pytest.approx(want, rel=1e-9) if vs else want)
    assert tuple(A.quantiles(df.filter("g = 'c'"), [], "v", {"mid": 0.5}, kept=kept).first()) == (np.median(groups["c"]),)


def test_existence_by_elements(spark):
    df = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, []), (4, None), (5, ["y", "q", None])], "id long, tags array<string>")
    other = spark.createDataFrame([("y",), ("q",), ("w",), (None,)], "tag string")
    has = P.ExistsIn(other, "tags", "tag")
    ids = lambda p: sorted(r.id for r in P.select(df, p).collect())
    assert ids(has) == [1, 5] and ids(~has) == [2, 3, 4]
    assert ids(has | P.Equal("id", 2)) == [1, 2, 5] and ids(~has & P.GreaterThan("id", 2)) == [3, 4]
    plan = P.select(df, has)._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan.lower()


def test_broadcast_by_bytes(spark):
    marked = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    wide = spark.range(2000).select(F.repeat(F.lit("x"), 1000).alias("s"), "id").repartition(2)
    assert marked(J.broadcast_if_small(wide, 4 << 20)) and not marked(J.broadcast_if_small(wide, 1 << 16))
    assert not marked(J.broadcast_if_small(wide, 1 << 14, rows=10))


def test_asof_chooses_by_size(spark):
    rng = random.Random(4)
    made = lambda n, c: spark.createDataFrame([(rng.choice("aab"), rng.randint(0, 5000), i) for i in range(n)], f"k string, s long, {c} long").select("k", F.timestamp_seconds("s").alias(f"t_{c}"), c)
    left, right = made(300, "x").cache(), made(300, "y").cache()
    how = dict(keys=["k"], left_time="t_x", right_time="t_y", columns=["y"], how="left", tie=["y"])
    plain, chosen = (sorted(map(tuple, df.collect()), key=repr) for df in (J.asof_any(left, right, **how), J.asof_any(left, right, **how, most=50)))
    assert plain == chosen and len(plain) == 300
