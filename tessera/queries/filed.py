"""Files in and out: readers, names, views, text files as tables, exports."""

import dataclasses
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import Catalog
from tessera.guard import QueryPolicy
from tessera.layout import Layout
from tessera.plans import parse
from tessera.plans.lineage import ensure_checkpoint_dir
from tessera.queries.models import scratch
from tessera.queries.registry import query
from tessera.queries.tables import Tables
from tessera.session import QuerySession
from tessera.sources import files
from tessera.sources.live import snapshot
from tessera.sources.remote import IcebergCatalog, ObjectStore
from tessera.sources.textfile import FileTable, FileTables, LineSource, RowParser
from tessera.store import FileSystem


def place(spark) -> str:
    """A new folder that the whole cluster shares."""
    return f"{ensure_checkpoint_dir(spark)}/files/{uuid.uuid4().hex}"


def _name(base: str) -> str:
    return f"{base}_{uuid.uuid4().hex[:8]}"


@query("files_united_by_name", "SELECT o_orderstatus, count(*) AS n, count(CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END) AS named FROM orders GROUP BY o_orderstatus")
def files_united_by_name(spark, d):
    """Parquet files that differ in columns, by a pattern."""
    at, o = place(spark), Tables(spark, d).orders
    o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus").write.parquet(f"{at}/a.parquet")
    o.filter("o_orderstatus <> 'F'").select("o_orderpriority", "o_orderstatus", "o_orderkey").write.parquet(f"{at}/b.parquet")
    both = files.read(spark, f"{at}/*.parquet")
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("named"))


@query("files_by_folder", "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS low FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderstatus")
def files_by_folder(spark, d):
    """A folder per value, sorted, whose name is a column again; a filter on it reads no other folder."""
    at = f"{place(spark)}/orders.parquet"
    files.partitioned(Tables(spark, d).orders.select("o_orderkey", "o_orderstatus"), at, ["o_orderstatus"], ["o_orderkey"])
    return files.read(spark, at).filter("o_orderstatus IN ('F', 'P')").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"))


@query("csv_joined", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def csv_joined(spark, d):
    t, at = Tables(spark, d), f"{place(spark)}/customers.csv"
    t.customer.write.option("header", "true").csv(at)
    met = files.read(spark, at).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("json_lines", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment")
def json_lines(spark, d):
    at = f"{place(spark)}/customers.ndjson"
    Tables(spark, d).customer.write.json(at)
    return files.read(spark, at).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("reader_by_extension", "SELECT kind, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier, (VALUES ('csv.gz'), ('tsv'), ('jsonl.bz2'), ('parquet'), ('orc')) t(kind) GROUP BY kind")
def reader_by_extension(spark, d):
    at, s = place(spark), Tables(spark, d).supplier
    s.write.option("header", "true").option("compression", "gzip").csv(f"{at}/a.csv.gz")
    s.write.option("header", "true").option("sep", "\t").csv(f"{at}/a.tsv")
    s.write.option("compression", "bzip2").json(f"{at}/a.jsonl.bz2")
    s.write.parquet(f"{at}/a.parquet")
    s.write.orc(f"{at}/a.orc")
    out = None
    for kind in ("csv.gz", "tsv", "jsonl.bz2", "parquet", "orc"):
        found = files.read(spark, f"{at}/a.{kind}").agg(F.count("*").alias("n"), F.sum(F.col("s_suppkey").cast("long")).alias("keys")).select(F.lit(kind).alias("kind"), "n", "keys")
        out = found if out is None else out.unionAll(found)
    return out


@query("table_names_of_files", "SELECT p_brand || '.csv.gz' AS file, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS name FROM part GROUP BY p_brand")
def table_names_of_files(spark, d):
    brands = sorted(r[0] for r in Tables(spark, d).part.select("p_brand").distinct().collect())
    return spark.createDataFrame([(f"{b}.csv.gz", files.table_name(f"/data/{b}.csv.gz")) for b in brands], "file string, name string")


@query("session_views", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def session_views(spark, d):
    """A registered file, an alias of it, and a view of a query over the alias."""
    q = QuerySession(spark, QueryPolicy(timeout=None))
    alias, dear = _name("o"), _name("dear")
    q.alias(alias, q.register(f"{d}/orders.parquet", _name("orders")))
    q.register_sql(dear, f"SELECT * FROM {alias} WHERE o_totalprice > 100000")
    got = q.run(f"SELECT o_orderpriority, count(*) AS n FROM {dear} GROUP BY 1")
    return spark.createDataFrame([tuple(r) for r in got.rows], "o_orderpriority string, n long")


@dataclasses.dataclass(frozen=True)
class Nation:
    key: int
    name: str
    region: int


def nations(spark, d) -> list[Nation]:
    return [Nation(*r) for r in Tables(spark, d).nation.select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


@query("snapshot_of_objects", "SELECT n_regionkey::BIGINT AS region, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1")
def snapshot_of_objects(spark, d):
    """A view of objects as they were, whatever becomes of the collection."""
    items, name = nations(spark, d), _name("nations")
    snapshot(spark, name, items, Layout.of(Nation))
    items.clear()
    return spark.sql(f"SELECT region, count(*) AS n, max(name) AS last FROM {name} GROUP BY region")


def _written(spark, text: str, path: str) -> None:
    folder, _, name = path.rpartition("/")
    fs = FileSystem(spark, folder)
    if name in fs.names(""):
        fs.delete(name)
    fs.create(name, text)


_WORD_NUMBER = T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])


def _word_number(line: str) -> tuple[str, int]:
    kind, n = line.split()
    return kind, int(n)


@query("file_table_columns", "SELECT event_type AS kind, event_type = 'error' AS loud, count(*) AS n, sum(user_id)::BIGINT AS users, 2::BIGINT AS columns_read FROM events WHERE event_id % 10 <> 0 GROUP BY event_type")
def file_table_columns(spark, d):
    """Lines that aren't rows are left out beforehand, a column comes from the raw line, and a query reads the columns it
    names only."""
    at = place(spark)
    e = Tables(spark, d).events
    lines = e.select(F.concat(F.when(F.col("event_id") % 10 == 0, "# ").otherwise(""), F.concat_ws(" ", "event_type", "user_id")))
    lines.coalesce(1).write.text(at)
    part = next(n for n in FileSystem(spark, at).names("") if n.startswith("part-"))
    table = FileTable(scratch(spark), "lines", LineSource(f"{at}/{part}"), RowParser(_WORD_NUMBER, _word_number, lambda raw: ~raw.startswith("#")))
    table.column("loud", "boolean", lambda raw: raw.startswith("error")).update()
    (read,) = parse.columns_read(table.df("kind", "loud")).values()
    return table.df().groupBy("kind", "loud").agg(F.count("*").alias("n"), F.sum("n").alias("users")).withColumn("columns_read", F.lit(len(read)).cast("long"))


@query(
    "file_table_follows",
    "SELECT 1 AS step, count(*) AS added, false AS rebuilt, count(*) AS n FROM nation UNION ALL SELECT 2, count(*), false, count(*) + (SELECT count(*) FROM nation) FROM region UNION ALL SELECT 3, 0, false, (SELECT count(*) FROM region) + count(*) FROM nation UNION ALL SELECT 4, count(*), true, count(*) FROM supplier",
)
def file_table_follows(spark, d):
    """A file that grows is read from where it ended, one that was replaced anew."""
    t, path = Tables(spark, d), f"{place(spark)}/follow.log"
    table = FileTable(scratch(spark), "follow", LineSource(path), RowParser(_WORD_NUMBER, _word_number))
    text = lambda df: "".join(f"{r[0].replace(' ', '_')} {r[1]}\n" for r in df.collect())
    first, more = text(t.nation.select("n_name", "n_nationkey")), text(t.region.select("r_name", "r_regionkey"))
    steps = []
    for content in (first, first + more, first + more, text(t.supplier.select("s_name", "s_suppkey"))):
        _written(spark, content, path)
        steps.append(table.update())
    return spark.createDataFrame([(i + 1, u.rows_added, u.rebuilt, u.rows) for i, u in enumerate(steps)], "step int, added long, rebuilt boolean, n long")


@query("file_table_function", "SELECT upper(n_name) AS shout, n_nationkey * 2 AS twice FROM (SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation) WHERE n_nationkey % 2 = 1")
def file_table_function(spark, d):
    """A function for queries on a file table, replaced by another of its name."""
    path = f"{place(spark)}/names.log"
    _written(spark, "".join(f"{n.name} {n.key}\n" for n in nations(spark, d)), path)
    table = FileTable(scratch(spark), _name("names"), LineSource(path), RowParser(_WORD_NUMBER, _word_number))
    table.update()
    table.register()
    table.function("tessera_shout", "string", lambda s: s)
    table.function("tessera_shout", "string", lambda s: s.upper())
    return spark.sql(f"SELECT tessera_shout(kind) AS shout, n * 2 AS twice FROM {table.name} WHERE n % 2 = 1")


@query("file_cache_trim", "SELECT replace(lower(r_name), ' ', '_') AS name, r_regionkey::BIGINT AS place FROM region ORDER BY r_regionkey DESC LIMIT 1")
def file_cache_trim(spark, d):
    """Cached tables go, those used longest ago first, but for one in use."""
    store, regions = scratch(spark), Tables(spark, d).region.orderBy("r_regionkey").collect()
    room = FileTables(store)
    for r in regions:
        name = files.table_name(r["r_name"])
        store.change(lambda c, name=name, r=r: c.replace(name, spark.range(r["r_regionkey"] + 1)))
        room.touch(name)
    kept = files.table_name(regions[-1]["r_name"])
    room.trim(0, frozenset({kept}))
    return spark.createDataFrame([(n, store.read(n).count() - 1) for n in store.names()], "name string, place long")


@query("text_files", "SELECT 'text' AS kind, n_name AS name, length(n_name) + 1 AS bytes FROM nation UNION ALL SELECT 'blob', n_name, length(n_name) + 1 FROM nation")
def text_files(spark, d):
    """Files as rows: whole texts, and bytes with their lengths."""
    at = place(spark)
    Tables(spark, d).nation.select("n_name", "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(at)
    pattern = f"{at}/*/part-*"
    whole = files.texts(spark, pattern).select(F.lit("text").alias("kind"), F.trim(F.translate("value", "\n", "")).alias("name"), F.octet_length("value").cast("long").alias("bytes"))
    blobs = files.blobs(spark, pattern).select(F.lit("blob").alias("kind"), F.translate(F.col("content").cast("string"), "\n", "").alias("name"), F.col("length").alias("bytes"))
    return whole.unionAll(blobs)


@query("export_one_file", "SELECT o_orderstatus, count(*) AS n, 1::BIGINT AS files, (SELECT count(*) FROM orders) AS written FROM orders GROUP BY o_orderstatus")
def export_one_file(spark, d):
    at = f"{place(spark)}/out.parquet"
    n = files.export(Tables(spark, d).orders.select("o_orderkey", "o_orderstatus"), at)
    parts = sum(x.startswith("part-") for x in FileSystem(spark, at).names(""))
    return files.read(spark, at).groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumns({"files": F.lit(parts).cast("long"), "written": F.lit(n).cast("long")})


_TABLES = ("customer", "nation", "events")


@query("catalog_columns", " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE {t})" for t in _TABLES))
def catalog_columns(spark, d):
    names = {_name(t): t for t in _TABLES}
    for view, t in names.items():
        getattr(Tables(spark, d), t).createOrReplaceTempView(view)
    found = {k: v for k, v in Catalog(spark).tables().items() if k in names}
    return spark.createDataFrame([(names[t], c.name) for t, columns in found.items() for c in columns], "table_name string, column_name string")


@query("catalog_described", "SELECT column_name, CASE column_name WHEN 'value' THEN 'EUR' ELSE '' END AS unit, CASE column_name WHEN 'value' THEN 'amount' ELSE '' END AS description FROM (DESCRIBE events)")
def catalog_described(spark, d):
    view, c = _name("events"), Catalog(spark)
    Tables(spark, d).events.createOrReplaceTempView(view)
    c.describe_table(view, "what users did")
    c.describe_column(view, "value", "amount", "EUR")
    return spark.createDataFrame([(x.name, x.unit, x.description) for x in c.columns(view)], "column_name string, unit string, description string")


@query(
    "catalog_profile",
    "SELECT 'o_orderkey' AS column_name, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high, round(avg(o_orderkey), 4) AS mean, count(*) AS n FROM orders UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), NULL, count(*) FROM orders UNION ALL SELECT 'value: ' || o_orderstatus, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT o_orderstatus FROM orders)",
)
def catalog_profile(spark, d):
    view, c = _name("orders"), Catalog(spark)
    Tables(spark, d).orders.select("o_orderkey", "o_orderstatus").createOrReplaceTempView(view)
    p = c.profile(view, 3)
    rows = [(x["column_name"], x["min"], x["max"], None if x["avg"] is None else round(x["avg"], 4), p.count) for x in p.columns]
    rows += [(f"value: {v}", None, None, None, None) for v in c.distinct_values(view, "o_orderstatus")]
    return spark.createDataFrame(rows, "column_name string, low string, high string, mean double, n long")


_S3 = {"fs.s3a.bucket.lake.endpoint": "http://store:9000", "fs.s3a.bucket.lake.path.style.access": "true", "fs.s3a.bucket.lake.connection.ssl.enabled": "false", "fs.s3a.bucket.lake.access.key": "id"}


@query("remote_settings", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _S3.items()) + ", ('spark.sql.catalog.lake.uri', 'http://catalog'), ('tidy statements', '3')) t(name, value)")
def remote_settings(spark, d):
    """Settings of an object store and an Iceberg catalog, and the statements that tidy a table: there is no network."""
    s3 = {k: v for k, v in ObjectStore.s3("http://store:9000").keys("id", "hidden").scope("s3a://lake").settings().items() if "secret" not in k}
    lake = IcebergCatalog.rest("http://catalog/")
    rows = [*s3.items(), ("spark.sql.catalog.lake.uri", lake.settings()["spark.sql.catalog.lake.uri"]), ("tidy statements", str(len(lake.tidy("db.t", 7))))]
    return spark.createDataFrame(rows, "name string, value string")
