"""Journals: records that are mostly appended, numbered within groups, migrated by version and searched by words."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.layout import Layout
from tessera.operators.paging import Pages
from tessera.store import Change, Store, StoreError


def escaped(word: str) -> str:
    """A word for LIKE with its wildcards taken literally; the escape is a backslash."""
    return word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def all_words(columns: list[str], text: str) -> Column:
    """True where some column holds all words of the text, in any case."""
    words = text.split()
    if not words:
        return F.lit(False)
    hit = [reduce(Column.__and__, [F.coalesce(F.col(c).ilike(f"%{escaped(w)}%"), F.lit(False)) for w in words]) for c in columns]
    return reduce(Column.__or__, hit)


def snippet(text: str, words: list[str], around: int = 40) -> str:
    """The text near the first word found."""
    low = text.lower()
    at = min((i for i in (low.find(w.lower()) for w in words) if i >= 0), default=0)
    first, end = max(0, at - around), min(len(text), at + around)
    return ("…" if first else "") + " ".join(text[first:end].split()) + ("…" if end < len(text) else "")


@dataclass(frozen=True)
class Hit:
    record: Row
    column: str
    snippet: str


class Journal:
    """A table of a store with a key, an order and a version.

    ``sequence`` names a column that numbers records within the groups of ``within``, from 1; ``append`` fills it in.
    """

    def __init__(self, store: Store, name: str, schema: T.StructType | Layout, key: list[str], order: list[str] | None = None, sequence: str | None = None, within: list[str] | None = None, searchable: list[str] | None = None):
        self.store, self.name = store, name
        self.schema = schema.schema if isinstance(schema, Layout) else schema
        self.key, self.order = key, order or key
        self.sequence, self.within = sequence, within or []
        texts = [f.name for f in self.schema if isinstance(f.dataType, T.StringType)]
        self.searchable = searchable or texts

    def open(self, version: int = 1, migrations: dict[int, Callable[[DataFrame], DataFrame]] | None = None) -> Journal:
        """Creates the table, or brings it to ``version``: migration n makes version n of version n - 1.

        All steps show at once. A table of a later version is refused."""

        def work(c: Change) -> None:
            if not c.exists(self.name):
                c.create(self.name, self.schema, self.key, {"version": version})
                return
            have = c.tables[self.name]["notes"].get("version", 1)
            if have > version:
                raise StoreError(f"{self.name} has version {have}, this program knows {version}")
            if have < version:
                df = c.read(self.name)
                for v in range(have + 1, version + 1):
                    if not migrations or v not in migrations:
                        raise StoreError(f"no migration to version {v}")
                    df = migrations[v](df)
                c.replace(self.name, df)
                c.note(self.name, version=version)

        self.store.change(work)
        return self

    def version(self) -> int:
        return self.store.notes(self.name)["version"]

    def df(self) -> DataFrame:
        return self.store.read(self.name)

    def _numbered(self, c: Change, rows: DataFrame) -> DataFrame:
        """Rows with sequence numbers after the last of their group, in the order they were given."""
        last = c.read(self.name).groupBy(*self.within).agg(F.max(self.sequence).alias("_last"))
        place = F.row_number().over(Window.partitionBy(*self.within).orderBy("_given"))
        given = rows.drop(self.sequence).withColumn("_given", F.monotonically_increasing_id())
        kind = self.schema[self.sequence].dataType
        met = given.join(last, self.within, "left") if self.within else given.join(F.broadcast(last))
        return met.withColumn(self.sequence, (F.coalesce("_last", F.lit(0)) + place).cast(kind)).select(*self.schema.names)

    def append(self, rows: DataFrame | Iterable[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.store.spark.createDataFrame([tuple(r) for r in rows], self.schema)

        def work(c: Change) -> None:
            c.insert(self.name, self._numbered(c, df) if self.sequence else df)

        self.store.change(work)  # if another writer was faster, numbers are given anew

    def append_and_get(self, rows: DataFrame | Iterable[tuple]) -> list[Row]:
        """Appends and returns the rows as stored, with their numbers."""
        before = self.store.state().tables[self.name]["folders"]
        self.append(rows)
        state = self.store.state()
        new = [f for f in state.tables[self.name]["folders"] if f not in before]
        return self.store.spark.read.schema(state.schema(self.name)).parquet(*[f"{self.store.files.root}/{f}" for f in new]).orderBy(*self.order).collect()

    def _is(self, key: tuple) -> Column:
        return reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in zip(self.key, key, strict=True)])

    def get(self, *key: Any) -> Row | None:
        return next(iter(self.df().filter(self._is(key)).take(1)), None)

    def _changed(self, condition: Column, work: Callable[[Change], None]) -> int:
        def change(c: Change) -> int:
            n = c.read(self.name).filter(condition).count()
            if n:
                work(c)
            return n

        return self.store.change(change)

    def update(self, key: tuple, values: dict[str, Any]) -> bool:
        if set(values) & set(self.key):
            raise StoreError("keys don't change")
        hit = self._is(key)
        return self._changed(hit, lambda c: c.update_where(self.name, hit, values)) > 0

    def delete(self, *key: Any) -> bool:
        return self.delete_where(self._is(key)) > 0

    def delete_where(self, condition: Column) -> int:
        return self._changed(condition, lambda c: c.delete_where(self.name, condition))

    def count(self) -> int:
        return self.df().count()

    def pages(self, size: int, where: Column | None = None) -> Pages:
        return Pages(self.df() if where is None else self.df().filter(where), self.order, size)

    def search(self, text: str, limit: int = 20, where: Column | None = None) -> list[Hit]:
        """Newest records in which one searchable column has all words of the text, with the words' surroundings."""
        words = text.split()
        df = self.df() if where is None else self.df().filter(where)
        found = df.filter(all_words(self.searchable, text)).orderBy(*[F.col(c).desc() for c in self.order]).limit(limit).collect()
        hits = []
        for row in found:
            column = next(c for c in self.searchable if row[c] is not None and all(w.lower() in row[c].lower() for w in words))
            hits.append(Hit(row, column, snippet(row[column], words)))
        return hits
