"""Collections of objects that are stored in columns and asked by predicates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.layout import Layout
from tessera.operators import joins
from tessera.operators.ordering import ascending
from tessera.operators.predicates import Equal, Predicate, key_statistics, select
from tessera.store import BulkWriter, Change, Store


class Collection:
    """Objects of one dataclass in a table of a store, one for each value of the first attribute.

    Every question is one Spark plan over the columns it needs: predicates, order and limits run before any object is
    made."""

    def __init__(self, store: Store, name: str, cls: type):
        self.store, self.name, self.layout, self.spark = store, name, Layout.of(cls), store.spark

    def create(self) -> Collection:
        self.store.change(lambda c: None if c.exists(self.name) else c.create(self.name, self.layout.schema, [self.layout.key]))
        return self

    def df(self) -> DataFrame:
        return self.store.read(self.name)

    def register(self) -> DataFrame:
        """Makes the collection a view under its name, for SQL."""
        df = self.df()
        df.createOrReplaceTempView(self.name)
        return df

    # writing

    def _keyed(self, items: Iterable[Any]) -> DataFrame:
        last = {getattr(i, self.layout.key): i for i in items}
        return self.layout.df(self.spark, last.values())

    def add(self, item: Any) -> None:
        self.add_all([item])

    def add_all(self, items: Iterable[Any]) -> None:
        """Objects in place of those with the same keys."""
        df = self._keyed(items)
        self.store.change(lambda c: c.upsert(self.name, df))

    def remove_all(self, items: Iterable[Any]) -> None:
        keys = self._keyed(items).select(self.layout.key)
        self.store.change(lambda c: c.delete_keys(self.name, keys))

    def update(self, remove: Iterable[Any], add: Iterable[Any]) -> None:
        """Takes objects out and puts others in; readers see both at once."""
        gone, new = self._keyed(remove).select(self.layout.key), self._keyed(add)

        def work(c: Change) -> None:
            c.delete_keys(self.name, gone)
            c.upsert(self.name, new)

        self.store.change(work)

    def bulk_writer(self, chunk: int = 131_072, new_keys: bool = False) -> BulkWriter:
        """Takes rows (``layout.row(item)``) and writes them in chunks."""
        return BulkWriter(self.store, self.name, chunk, new_keys)

    def clear(self) -> None:
        self.store.clear(self.name)

    def optimize(self, *attributes: str) -> None:
        """Files sorted by attributes, so that questions with a range of the first one read few of them."""
        self.store.sorted_rewrite(self.name, list(attributes) or [self.layout.key])

    # asking

    def matching(self, where: Predicate | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
        df = self.df() if where is None else select(self.df(), where)
        if order:
            df = df.orderBy(*order)
        return df if limit is None else df.limit(limit)

    def retrieve(self, where: Predicate | None = None, order: list[Column] | None = None, limit: int | None = None) -> list[Any]:
        return self.layout.items(self.matching(where, order, limit))

    def stream(self, where: Predicate | None = None) -> Iterator[Any]:
        """Objects one partition at a time."""
        for row in self.matching(where).toLocalIterator():
            yield self.layout.item(row)

    def get(self, key: Any) -> Any | None:
        found = self.retrieve(Equal(self.layout.key, key), limit=1)
        return found[0] if found else None

    def __contains__(self, item: Any) -> bool:
        return self.get(getattr(item, self.layout.key)) == item

    def __len__(self) -> int:
        return self.df().count()

    def count(self, where: Predicate) -> int:
        return self.matching(where).count()

    def read_page(self, after: Any | None, limit: int) -> list[Any]:
        """Objects in the order of their keys, from the one after a key on."""
        df = self.df() if after is None else self.df().filter(F.col(self.layout.key) > F.lit(after))
        return self.layout.items(df.orderBy(*ascending(self.layout.key)).limit(limit))

    def statistics(self, attribute: str, descending: bool = False) -> list[tuple[Any, int]]:
        """Values of an attribute with how many objects have them."""
        return [(r[0], r[1]) for r in key_statistics(self.df(), attribute, descending=descending).collect()]

    def pairs(self, other: Collection, on: str, on_other: str, where: Predicate | None = None, where_other: Predicate | None = None) -> Iterator[tuple[Any, Any]]:
        """Pairs of objects that agree in an attribute."""
        for r in joins.pairs(self.df(), other.df(), on, on_other, where, where_other).toLocalIterator():
            yield self.layout.item(r["left"]), other.layout.item(r["right"])

    def describe(self) -> str:
        return self.store.describe(self.name)
