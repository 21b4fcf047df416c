"""Results kept as tables: refreshed whole by a swap that readers don't notice, or folded forward by what is new."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import from_rollup
from tessera.store import Change, Store, StoreError


def _now() -> float:
    return dt.datetime.now(dt.timezone.utc).timestamp()


class Materialization:
    """A named result of a query (SQL, or a function that gives a DataFrame).

    A refresh writes the new rows first and then publishes them, so that a reader sees the old result or the new one and
    never none. Of an additive result (sums and counts), ``append_delta`` adds partial rows; readers add rows up again.
    """

    def __init__(self, store: Store, name: str, query: str | Callable[[], DataFrame]):
        self.store, self.name, self._query = store, name, query

    def _df(self) -> DataFrame:
        return self.store.spark.sql(self._query) if isinstance(self._query, str) else self._query()

    def create_if_absent(self) -> bool:
        if self.store.exists(self.name):
            return False
        self.refresh()
        return True

    def refresh(self) -> None:
        df = self._df()

        def work(c: Change) -> None:
            c.replace(self.name, df)
            c.note(self.name, refreshed_at=_now())

        self.store.change(work)

    def age(self) -> dt.timedelta:
        if not self.store.exists(self.name):
            raise StoreError(f"{self.name} was never built")
        return dt.timedelta(seconds=_now() - self.store.notes(self.name)["refreshed_at"])

    def is_older_than(self, age: dt.timedelta) -> bool:
        return not self.store.exists(self.name) or self.age() > age

    def refresh_if_older_than(self, age: dt.timedelta) -> bool:
        if not self.is_older_than(age):
            return False
        self.refresh()
        return True

    def append_delta(self, delta: str | DataFrame, args: dict[str, Any] | None = None, batch: str | None = None) -> bool:
        """Adds partial rows of an additive result. With a ``batch`` name they are added at most once."""
        df = self.store.spark.sql(delta, args=args) if isinstance(delta, str) else delta

        def work(c: Change) -> bool:
            done = c.tables[self.name]["notes"].get("batches", [])
            if batch is not None and batch in done:
                return False
            c.append(self.name, df)
            c.note(self.name, refreshed_at=_now(), **({"batches": [*done, batch]} if batch is not None else {}))
            return True

        return self.store.change(work)

    def fold(self, by: list[str], totals: list[str]) -> None:
        """Adds partial rows up in the table itself, so that it stays small."""
        self.store.change(lambda c: c.replace(self.name, c.read(self.name).groupBy(*by).agg(*[F.sum(t).alias(t) for t in totals])))

    def df(self) -> DataFrame:
        return self.store.read(self.name)

    def answer(self, by: list[str], totals: list[str]) -> DataFrame:
        """Coarser totals and means, from a roll-up with ``n`` and sums."""
        return from_rollup(self.df(), by, totals)

    def row_count(self) -> int:
        return self.df().count()

    def drop(self) -> None:
        self.store.change(lambda c: c.drop(self.name))
