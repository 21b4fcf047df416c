"""The engine's front door: a session's tables and files by name, lazy SQL, guarded SQL, stored results."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.catalog import Catalog, Example, Profile, QueryExamples
from tessera.functions import udf
from tessera.guard import GuardedQuery, QueryPolicy, Result
from tessera.layout import Layout
from tessera.metrics import Metrics
from tessera.operators.paging import ResultWindow
from tessera.plans import parse
from tessera.rows import CancelSignal, Rows
from tessera.sources import files
from tessera.sources.live import LiveTable, snapshot
from tessera.store import Change, Store


class ReadError(ValueError):
    """A text that isn't one statement that gives rows."""


class Engine:
    """A Spark session, a store, and what is measured about its queries."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.store = Store(spark, root) if root else None
        self.metrics = Metrics()
        if self.store:
            self.store.metrics = self.metrics
        self.catalog = Catalog(spark)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Engine:
        return cls(spark, root)

    def query(self, sql: str, *args: Any, **named: Any) -> Rows:
        """The rows of one statement that reads; parameters are ``?`` or ``:name``. Nothing runs before a terminal."""
        if parse.statements(sql) != 1:
            raise ReadError("one statement is needed")
        body = sql.strip().rstrip(";")
        first = body.split(None, 1)[0].upper().lstrip("(") if body else ""
        if first not in ("SELECT", "FROM", "WITH", "VALUES", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "TABLE"):
            raise ReadError("the statement gives no rows")
        with self.metrics.timed(sql):
            return Rows(self.spark.sql(body, args=list(args) or named or None))

    def execute(self, sql: str, *args: Any, **named: Any) -> None:
        """Any statement of Spark's own tables and views."""
        with self.metrics.timed(sql):
            self.spark.sql(sql.strip().rstrip(";"), args=list(args) or named or None).collect()

    def in_transaction(self, work: Callable[[Change], Any]) -> Any:
        """Changes of the store's tables that show all at once; run again if another writer was faster."""
        return self.store.change(work)

    def create_table(self, name: str, layout: Layout) -> None:
        self.store.change(lambda c: c.create(name, layout.schema, [layout.key]))

    def write(self, name: str, items: Iterable[Any], layout: Layout, replace_keys: bool = True) -> int:
        """Writes objects: in place of those with the same keys (the last of a key counts), or refusing known keys."""
        rows = {i.__getattribute__(layout.key): i for i in items} if replace_keys else list(items)
        df = layout.df(self.spark, rows.values() if isinstance(rows, dict) else rows)
        self.store.change(lambda c: c.upsert(name, df, [layout.key]) if replace_keys else c.insert(name, df))
        return len(rows)

    def objects(self, name: str, layout: Layout, where=None) -> list[Any]:
        df = self.store.read(name)
        return layout.items(df if where is None else df.filter(where))

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def export_table(self, name: str, location: str) -> int:
        return files.export(self.store.read(name), location)

    def register_function(self, name: str, kind: str, fn: Callable) -> None:
        udf.register(self.spark, name, kind, fn)


class QuerySession:
    """Files, queries and collections under names, asked through the guard."""

    def __init__(self, spark: SparkSession, policy: QueryPolicy = QueryPolicy()):
        self.spark, self.guard, self.catalog = spark, GuardedQuery(spark, policy), Catalog(spark)
        self._names: dict[str, str] = {}

    def register(self, path: str, name: str | None = None) -> str:
        """Registers a file (or folder, or pattern) under a name after it, and returns the name."""
        name = name or files.table_name(path, self._names)
        files.read(self.spark, path).createOrReplaceTempView(name)
        self._names[name] = path
        return name

    def register_sql(self, name: str, sql: str) -> None:
        """A view of a query, which the guard checks first."""
        self.guard.check(sql)
        self.spark.sql(sql).createOrReplaceTempView(name)
        self._names[name] = sql

    def register_items(self, name: str, items: Iterable[Any] | Callable[[], Iterable[Any]], layout: Layout, live: bool = False) -> None:
        if live:
            LiveTable(self.spark, name, items, layout).refresh()
        else:
            snapshot(self.spark, name, items() if callable(items) else items, layout)
        self._names[name] = "items"

    def alias(self, alias: str, name: str) -> None:
        if name not in self._names:
            raise LookupError(f"nothing is registered as {name}")
        self.spark.table(name).createOrReplaceTempView(alias)
        self._names[alias] = name

    def unregister(self, name: str) -> None:
        self._names.pop(name)
        self.spark.catalog.dropTempView(name)

    def names(self) -> list[str]:
        return sorted(self._names)

    def run(self, sql: str, signal: CancelSignal | None = None) -> Result:
        return self.guard.run(sql, signal)

    def window(self, sql: str) -> ResultWindow:
        """The whole result, stored, to be read by position."""
        self.guard.check(sql)
        return ResultWindow(self.spark.sql(sql.strip().rstrip(";")))

    def examples(self, name: str) -> list[Example]:
        return QueryExamples(self.spark).of(name)

    def profile(self, name: str, sample: int = 5) -> Profile:
        return self.catalog.profile(name, sample)

    def columns_read(self, sql: str) -> dict[str, list[str]] | None:
        self.guard.check(sql)
        return parse.columns_read(self.spark.sql(sql))
