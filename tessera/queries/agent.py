"""Guarded SQL, lineage, catalog, sessions, files, result windows, streams over the tables."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import QueryExamples
from tessera.guard import GuardedQuery, QueryPolicy
from tessera.materialization import Materialization
from tessera.operators.paging import ResultWindow
from tessera.operators.vector import VectorIndex
from tessera.plans import parse
from tessera.plans.lineage import cut, ensure_checkpoint_dir
from tessera.queries.models import scratch
from tessera.queries.registry import query
from tessera.queries.tables import Tables
from tessera.rows import Rows
from tessera.session import QuerySession
from tessera.sources.textfile import FileTable, LineSource, RowParser
from tessera.streaming.tail import append_to, fold_into, tail_files, windowed

_STATEMENTS = {
    "SELECT count(*) FROM orders": True,
    "WITH a AS (SELECT 1 AS x) SELECT x FROM a": True,
    "EXPLAIN SELECT 1": True,
    "DROP TABLE orders": False,
    "SELECT 1; SELECT 2": False,
    "INSERT INTO orders SELECT * FROM orders": False,
    "SELECT * FROM parquet.`/tmp/x`": False,
    "SET a = b": False,
    "SELEC 1": False,
}


@query("guard_rejects", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {str(ok).lower()})" for s, ok in _STATEMENTS.items()) + ") t(statement, allowed)")
def guard_rejects(spark, d):
    guard = GuardedQuery(spark)
    return spark.createDataFrame([(s, guard.why_rejected(s) is None) for s in _STATEMENTS], "statement string, allowed boolean")


@query("guarded_rows", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def guarded_rows(spark, d):
    name = f"orders_{uuid.uuid4().hex}"
    Tables(spark, d).orders.createOrReplaceTempView(name)
    got = GuardedQuery(spark, QueryPolicy(timeout=None)).run(f"SELECT o_orderpriority, count(*) AS n FROM {name} GROUP BY ALL")
    return spark.createDataFrame([tuple(r) for r in got.rows], "o_orderpriority string, n long")


@query("lineage_columns", "SELECT unnest(['event_type', 'user_id', 'value']) AS column_name")
def lineage_columns(spark, d):
    e = Tables(spark, d).events.filter("event_type = 'view'").groupBy("user_id").agg(F.sum("value"))
    found = parse.columns_read(e)
    return spark.createDataFrame([(c,) for columns in found.values() for c in columns], "column_name string")


@query("examples_valid", "SELECT 0::BIGINT AS failed, true AS several")
def examples_valid(spark, d):
    guard, failed, n = GuardedQuery(spark, QueryPolicy(timeout=None)), 0, 0
    for table in ("events", "orders", "part"):
        name = f"{table}_{uuid.uuid4().hex[:8]}"
        getattr(Tables(spark, d), table).createOrReplaceTempView(name)
        for example in QueryExamples(spark).of(name):
            n += 1
            failed += guard.why_rejected(example.sql) is not None or spark.sql(example.sql).schema is None
    return spark.createDataFrame([(failed, n > 15)], "failed long, several boolean")


@query("session_registered_file", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2")
def session_registered_file(spark, d):
    q = QuerySession(spark)
    nation, region = (q.register(f"{d}/{t}.parquet", f"{t}_{uuid.uuid4().hex[:8]}") for t in ("nation", "region"))
    got = q.run(f"SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_regionkey < 2")
    return spark.createDataFrame([tuple(r) for r in got.rows], "n_name string, r_name string")


@query("rows_terminals", "SELECT count(*) AS n, min(c_custkey) AS first, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS debts FROM customer")
def rows_terminals(spark, d):
    c = Tables(spark, d).customer
    first, debts = Rows(c.orderBy("c_custkey").limit(1).select("c_custkey")).scalar(), []
    Rows(c.filter("c_acctbal < 0").select("c_custkey")).for_each_value(debts.append)
    return spark.createDataFrame([(Rows(c).count(), first, len(debts))], "n long, first long, debts long")


@query("result_window", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 90")
def result_window(spark, d):
    w = ResultWindow(Tables(spark, d).orders.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")])
    w.sort("o_totalprice", descending=True)
    return spark.createDataFrame([(r["o_orderkey"],) for r in w.rows(90, 10)], "o_orderkey long")


@query("file_table_lines", "SELECT event_type AS kind, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def file_table_lines(spark, d):
    """Events written as lines of text, parsed back through a file table."""
    folder = f"{ensure_checkpoint_dir(spark)}/lines/{uuid.uuid4().hex}"
    Tables(spark, d).events.select(F.concat_ws(" ", "event_type", "user_id")).coalesce(1).write.text(folder)
    from tessera.store import FileSystem

    part = next(n for n in FileSystem(spark, folder).names("") if n.startswith("part-"))
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("user", T.LongType())])
    table = FileTable(scratch(spark), "lines", LineSource(f"{folder}/{part}"), RowParser(schema, lambda s: (s.split()[0], int(s.split()[1]))))
    table.update()
    return table.df().groupBy("kind").agg(F.count("*").alias("n"), F.sum("user").alias("users"))


def _stream(spark, d):
    events = Tables(spark, d).events
    return tail_files(spark, d, events.schema, pattern="events.parquet")


def _checkpoint(spark):
    return f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


@query("stream_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_append(spark, d):
    store, place = scratch(spark), _checkpoint(spark)
    for _ in range(2):  # a second run finds nothing new
        append_to(_stream(spark, d), store, "events", place).awaitTermination()
    return store.read("events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_rollup", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_rollup(spark, d):
    per = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    m = Materialization(scratch(spark), "per_user", lambda: per(Tables(spark, d).events.limit(0)))
    m.create_if_absent()
    fold_into(_stream(spark, d), m, per, _checkpoint(spark)).awaitTermination()
    return m.df().groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Daily windows of the stream, with a watermark, in complete mode to a table in memory."""
    name = f"windows_{uuid.uuid4().hex}"
    timed = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed(timed, "ts", "1 day", late="1 hour")
    out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("day"), "n")


_SIMILAR = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("vector_index_recall", f"SELECT query, count(*)::BIGINT AS neighbours, true AS enough FROM (SELECT a.vec_id AS query, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIMILAR} DESC, b.vec_id) AS place FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE place <= 10 GROUP BY query")
def vector_index_recall(spark, d):
    """Ten neighbours of every vector whose id is divisible by 100, and whether nine in ten of all are the true ones."""
    e = Tables(spark, d).embeddings
    index = VectorIndex.build(e, "embedding", "vec_id", f"{ensure_checkpoint_dir(spark)}/index/{uuid.uuid4().hex}", lists=16)
    queries = e.filter("vec_id % 100 = 0")
    near, exact = (cut(index.neighbours(queries, 10, exact=x)) for x in (False, True))
    share = near.join(exact, ["query", "vec_id"], "left_semi").count() / max(1, exact.count())
    return near.groupBy("query").agg(F.count("*").alias("neighbours")).withColumn("enough", F.lit(share >= 0.9))


@query("vector_neighbours", f"SELECT query, vec_id, round(score, 5) AS score FROM (SELECT a.vec_id AS query, b.vec_id, {_SIMILAR} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIMILAR} DESC, b.vec_id) AS place FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE place <= 10")
def vector_neighbours(spark, d):
    """The true ten, through all lists."""
    e = Tables(spark, d).embeddings
    index = VectorIndex.build(e, "embedding", "vec_id", f"{ensure_checkpoint_dir(spark)}/index/{uuid.uuid4().hex}", lists=16)
    return index.neighbours(e.filter("vec_id % 100 = 0"), 10, exact=True).withColumn("score", F.round("score", 5))
