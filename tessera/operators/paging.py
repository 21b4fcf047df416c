"""Keyset paging: pages by position in a total order, found by comparing keys and not by counting rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import numbered


@dataclass(frozen=True)
class Page:
    """Rows in order; whether more come before and after; keys to go on from."""

    rows: list[Row]
    has_before: bool
    has_after: bool
    order: tuple[str, ...]

    def _key(self, row: Row) -> tuple:
        return tuple(row[c] for c in self.order)

    @property
    def first_key(self) -> tuple | None:
        return self._key(self.rows[0]) if self.rows else None

    @property
    def last_key(self) -> tuple | None:
        return self._key(self.rows[-1]) if self.rows else None


@dataclass
class Pages:
    """Pages of ``size`` rows of ``df`` in the order of ``order``, columns that are never null and jointly unique.

    ``descending`` names the columns whose order is reversed. Every page is a filter on the key and a top-n, so its cost
    doesn't grow with its position.

    With ``bounded`` and a first column of numbers, dates or times the search for the rows after or before a key ends at
    ``REACH`` times the stretch that a page takes up on average, which lets a scan skip files on both sides. Where that
    stretch holds too few rows the search is made again without an end, so pages stay exact.
    """

    REACH = 4

    df: DataFrame
    order: list[str]
    size: int
    descending: frozenset[str] = frozenset()
    bounded: bool = False
    _count: int | None = field(default=None, init=False)
    _span: float | None = field(default=None, init=False)
    searches: int = field(default=0, init=False)

    def __post_init__(self):
        if not self.order:
            raise ValueError("pages need an order")
        if self.size < 1:
            raise ValueError("a page has one row at least")

    def sort(self, reverse: bool = False) -> list[Column]:
        return [F.col(c).desc() if (c in self.descending) != reverse else F.col(c).asc() for c in self.order]

    def condition(self, key: tuple, after: bool, inclusive: bool = False) -> Column:
        """Rows after (or before) the key: ``a > x OR (a = x AND b > y)``.

        The first column's plain comparison is repeated outside, where a scan can use it to skip row groups."""
        if len(key) != len(self.order):
            raise ValueError(f"a key has {len(self.order)} values")
        terms, equal = [], F.lit(True)
        for c, v in zip(self.order, key, strict=True):
            up = (c in self.descending) != after
            terms.append(equal & (F.col(c) > F.lit(v) if up else F.col(c) < F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        if inclusive:
            terms.append(equal)
        first, value = self.order[0], F.lit(key[0])
        bound = F.col(first) >= value if (first in self.descending) != after else F.col(first) <= value
        return bound & reduce(Column.__or__, terms)

    def after_df(self, key: tuple | None, n: int, inclusive: bool = False) -> DataFrame:
        df = self.df if key is None else self.df.filter(self.condition(key, True, inclusive))
        return df.orderBy(*self.sort()).limit(n)

    def before_df(self, key: tuple | None, n: int) -> DataFrame:
        df = self.df if key is None else self.df.filter(self.condition(key, False))
        return df.orderBy(*self.sort(reverse=True)).limit(n)

    def _fetch(self, key: tuple | None, n: int, after: bool) -> list[Row]:
        """The ``n`` rows after a key, or before it."""
        found = self.df if key is None else self.df.filter(self.condition(key, after))
        end = self._end(key, n, after) if self.bounded and key is not None else None
        for part in ([] if end is None else [found.filter(end)]) + [found]:
            self.searches += 1
            rows = part.orderBy(*self.sort(reverse=not after)).limit(n).collect()
            if len(rows) == n:
                break
        return rows

    def _end(self, key: tuple, n: int, after: bool) -> Column | None:
        """How far the search for ``n`` rows goes at first."""
        first, value = F.col(self.order[0]), key[0]
        kind = self.df.schema[self.order[0]].dataType
        if not isinstance(kind, (T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType)) or isinstance(kind, T.DecimalType):
            return None
        if self._span is None:
            low, high, self._count = self.df.agg(F.min(first), F.max(first), F.count("*")).first()
            wide = (high - low) if self._count else 0
            wide = wide.total_seconds() if isinstance(wide, dt.timedelta) else float(wide)
            self._span = wide / max(1, self._count)
        reach = self._span * n * self.REACH
        if isinstance(kind, T.DateType):
            reach = dt.timedelta(days=reach // 86_400 + 1)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            reach = dt.timedelta(seconds=reach)
        elif isinstance(kind, T.IntegralType):
            reach = int(reach) + 1
        up = (self.order[0] in self.descending) != after
        return first <= F.lit(value + reach) if up else first >= F.lit(value - reach)

    def _exists(self, condition: Column) -> bool:
        return bool(self.df.filter(condition).take(1))

    def first(self) -> Page:
        rows = self.after_df(None, self.size + 1).collect()
        return Page(rows[: self.size], False, len(rows) > self.size, tuple(self.order))

    def last(self) -> Page:
        rows = self.before_df(None, self.size + 1).collect()
        return Page(rows[: self.size][::-1], len(rows) > self.size, False, tuple(self.order))

    def after(self, key: tuple) -> Page:
        rows = self._fetch(key, self.size + 1, True)
        return Page(rows[: self.size], self._exists(self.condition(key, False, True)), len(rows) > self.size, tuple(self.order))

    def before(self, key: tuple) -> Page:
        rows = self._fetch(key, self.size + 1, False)
        return Page(rows[: self.size][::-1], len(rows) > self.size, self._exists(self.condition(key, True, True)), tuple(self.order))

    def around(self, key: tuple, each: int) -> Page:
        """Up to ``each`` rows before the key and after it, and the row of the key itself if there is one."""
        before = self.before_df(key, each + 1).collect()
        found = self.df.filter(self.condition(key, True, True) & ~self.condition(key, True)).take(1)
        after = self.after_df(key, each + 1).collect()
        return Page([*before[:each][::-1], *found, *after[:each]], len(before) > each, len(after) > each, tuple(self.order))

    def at(self, position: int) -> Page:
        """The page that begins at a position, from 0."""
        rows = self.df.orderBy(*self.sort()).offset(position).limit(self.size + 1).collect()
        return Page(rows[: self.size], position > 0 and self.count() > 0, len(rows) > self.size, tuple(self.order))

    def count(self) -> int:
        """Rows in all, counted once."""
        if self._count is None:
            self._count = self.df.count()
        return self._count

    def recount(self) -> int:
        self._count = None
        return self.count()

    def position(self, key: tuple) -> int:
        """How many rows come before the key."""
        return self.df.filter(self.condition(key, False)).count()


class ResultWindow:
    """A stored result that is read by position and can be sorted and unsorted without running its query again."""

    def __init__(self, df: DataFrame, order: list[Column] | None = None):
        from tessera.plans.lineage import cut

        base = df if order is None else df.orderBy(*order)
        # ids ascend with partitions, which keeps the order that the result came in
        self._stored = cut(base.withColumn("_id", F.monotonically_increasing_id()))
        self.columns = df.columns
        self._size = self._stored.count()
        self._place(["_id"])

    def _place(self, order: list) -> None:
        keys = [F.col(c) if isinstance(c, str) else c for c in order]
        self._view = numbered(self._stored, keys, "_position").persist()

    def __len__(self) -> int:
        return self._size

    def rows(self, first: int, n: int) -> list[Row]:
        picked = self._view.filter((F.col("_position") >= first) & (F.col("_position") < first + n))
        return picked.orderBy("_position").select(*self.columns).collect()

    def value(self, row: int, column: str) -> Any:
        return self.rows(row, 1)[0][column]

    def sort(self, column: str, descending: bool = False) -> None:
        """Nulls last; rows of equal value stay in the order of the result."""
        self._view.unpersist()
        key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
        self._place([key, "_id"])

    def unsort(self) -> None:
        self._view.unpersist()
        self._place(["_id"])

    def close(self) -> None:
        self._view.unpersist()
