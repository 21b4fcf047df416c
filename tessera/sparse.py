"""Sparse tables: thousands of possible attributes per record, stored long and shown wide."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import columns
from tessera.store import Change, Store, StoreError

POINTS = columns(record_id="long", attribute="string", value="double")


class SparseBatch:
    """Values of some records, each attribute once per record."""

    def __init__(self):
        self.rows: dict[tuple[int, str], float] = {}
        self.records: dict[int, None] = {}
        self._at: int | None = None

    def record(self, record_id: int) -> SparseBatch:
        self._at = record_id
        self.records[record_id] = None
        return self

    def put(self, attribute: str, value: float) -> SparseBatch:
        if self._at is None:
            raise StoreError("begin a record first")
        if (self._at, attribute) in self.rows:
            raise StoreError(f"record {self._at} has {attribute} twice")
        self.rows[(self._at, attribute)] = float(value)
        return self


def wide_view(points: DataFrame, names: list[str], record: str = "record_id", attribute: str = "attribute", value: str = "value") -> DataFrame:
    """One row per record that has any of the attributes, and a column for each; unknown ones are null.

    The attributes are conditional aggregates of one pass over the points that carry them."""
    wanted = points.filter(F.col(attribute).isin(*names)) if names else points.limit(0)
    cells = [F.max(F.when(F.col(attribute) == n, F.col(value))).alias(n) for n in names]
    return wanted.groupBy(record).agg(*cells) if cells else wanted.select(record)


class SparseTable:
    def __init__(self, store: Store, name: str):
        self.store, self.name, self.spark = store, name, store.spark

    def create(self) -> SparseTable:
        self.store.change(lambda c: None if c.exists(self.name) else c.create(self.name, POINTS))
        return self

    def points(self) -> DataFrame:
        return self.store.read(self.name)

    def append(self, batch: SparseBatch) -> None:
        df = self.spark.createDataFrame([(r, a, v) for (r, a), v in batch.rows.items()], POINTS)
        self.store.change(lambda c: c.append(self.name, df))

    def append_points(self, points: DataFrame) -> None:
        """Rows of record_id, attribute and value, each attribute once per record."""
        self.store.change(lambda c: c.append(self.name, points))

    def replace(self, batch: SparseBatch) -> None:
        """The batch's records have its values and no others."""
        df = self.spark.createDataFrame([(r, a, v) for (r, a), v in batch.rows.items()], POINTS)
        keys = self.spark.createDataFrame([(r,) for r in batch.records], "record_id long")

        def work(c: Change) -> None:
            c.delete_keys(self.name, keys)
            c.append(self.name, df)

        self.store.change(work)

    def delete(self, records: Iterable[int]) -> None:
        keys = self.spark.createDataFrame([(int(r),) for r in records], "record_id long")
        self.store.change(lambda c: c.delete_keys(self.name, keys))

    def read(self, record_id: int) -> dict[str, float]:
        rows = self.points().filter(F.col("record_id") == record_id).orderBy("attribute").collect()
        return {r["attribute"]: r["value"] for r in rows}

    def wide(self, *names: str) -> DataFrame:
        return wide_view(self.points(), list(names))

    def attributes(self) -> list[str]:
        return [r[0] for r in self.points().select("attribute").distinct().orderBy("attribute").collect()]

    def optimize(self, partitions: int | None = None) -> None:
        """Files sorted by attribute and record: a view of a few attributes skips most of them."""
        self.store.sorted_rewrite(self.name, ["attribute", "record_id"], partitions)
