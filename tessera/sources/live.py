"""Collections of the running program as tables that are read anew by every query."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.layout import Layout, LayoutError


def snapshot(spark: SparkSession, name: str, items: Iterable[Any], layout: Layout) -> DataFrame:
    """A view of the collection as it is now."""
    df = layout.df(spark, list(items))
    df.createOrReplaceTempView(name)
    return df


class LiveTable:
    """A collection that queries read as it is when they run: ``df()`` takes the items of the moment.

    ``columns`` narrows the columns before any value is made. Types that can't be compared across the border (bytes,
    UUIDs) are refused."""

    REFUSED = ("binary",)

    def __init__(self, spark: SparkSession, name: str, items: Iterable[Any] | Callable[[], Iterable[Any]], layout: Layout):
        for c in layout.columns:
            if c.type.simpleString() in self.REFUSED or getattr(c.kind, "__name__", "") == "UUID":
                raise LayoutError(f"{c.name} can't be in a live table")
        self.spark, self.name, self.layout = spark, name, layout
        self._items = items if callable(items) else lambda: items

    def df(self, *columns: str) -> DataFrame:
        layout = Layout(self.layout.cls, [c for c in self.layout.columns if not columns or c.name in columns])
        return layout.df(self.spark, list(self._items()))

    def refresh(self) -> DataFrame:
        """Registers the view anew; SQL from now on sees the items of this moment."""
        df = self.df()
        df.createOrReplaceTempView(self.name)
        return df

    def sql(self, query: str, **args: Any) -> DataFrame:
        self.refresh()
        return self.spark.sql(query, args=args or None)

    def hinted(self, most: int = 100_000) -> DataFrame:
        """For joins: sent to every task if the collection has ``most`` items or fewer."""
        items = list(self._items())
        df = self.layout.df(self.spark, items)
        return F.broadcast(df) if len(items) <= most else df


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__(first)
        self.first, self.end = first, end


def row_source(name: str, schema: str, rows: Callable[[int, int], Iterator[tuple]], size: Callable[[], int], parts: int = 8) -> type[DataSource]:
    """A data source (for ``spark.dataSource.register``) over a function that gives rows ``first`` to ``end``.

    The size is asked when a query is planned; rows are made in the tasks, a range each."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            n = size()
            step = max(1, -(-n // parts))
            return [_Range(i, min(n, i + step)) for i in range(0, n, step)] or [_Range(0, 0)]

        def read(self, partition: _Range) -> Iterator[tuple]:
            yield from rows(partition.first, partition.end)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source
