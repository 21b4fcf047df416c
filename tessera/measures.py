"""Measures: numbers with several key fields, refreshed by writers and read as of any moment.

A measure holds values of records; a value has one setting of each key field, such as curve, point and unit. Values are
added up by any choice of fields as rows and one as columns. A refresh replaces values for all records (a full set), for
some (an increment) or takes records out; what it changes is kept as contributions, so that the state at a moment is the
sum of the contributions since the last full set before it.

Tables of a measure ``m`` in a store: ``m_value`` (the live state), ``m_contribution`` (changes not yet shipped), and for
all measures together ``measure_refresh`` (the ledger) and ``measure_watermark``. Key fields stand in the rows
themselves: Parquet's dictionaries make that cheap, and no read has to join.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.joins import broadcast_if_small, converted
from tessera.operators.ordering import declared
from tessera.plans.spread import spread, tasks_for, without
from tessera.schema import columns
from tessera.store import Change, FileSystem, Store, StoreError

LEDGER, WATERMARK, PRUNED = "measure_refresh", "measure_watermark", "measure_pruned"
FULL, INCREMENT, REMOVE = "full", "increment", "remove"
LEDGER_SCHEMA = columns(refresh_id="string", writer="string", refreshed_at="timestamp_ntz", seq="long", measure="string", kind="string", committed_at="timestamp_ntz")
WATERMARK_SCHEMA = columns(writer="string", measure="string", refreshed_at="timestamp_ntz")

#: Bytes that a compacted file takes, about.
FILE_BYTES = 32 << 20


class MeasureError(StoreError):
    """A refused question or write."""


@dataclass(frozen=True)
class Field:
    """A key field: its values' declared order, and the value that older data without the field has."""

    name: str
    order: tuple[str, ...] = ()
    default: str | None = None


@dataclass(frozen=True)
class Measure:
    """A measure's definition. ``unit`` names the key field that holds units, if there is one."""

    name: str
    fields: tuple[Field, ...]
    unit: str | None = None

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names) or not names:
            raise MeasureError("fields need different names, one at least")
        if self.unit is not None and self.unit not in names:
            raise MeasureError(f"no field {self.unit}")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise MeasureError(f"{self.name} has no field {name}")

    @property
    def key_schema(self) -> T.StructType:
        return T.StructType([T.StructField("record_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in self.names), T.StructField("value", T.DoubleType())])

    @property
    def value_schema(self) -> T.StructType:
        return T.StructType([*self.key_schema, *columns(part="string", written_by="string", written_at="timestamp_ntz")])

    @property
    def contribution_schema(self) -> T.StructType:
        return T.StructType([*columns(refresh_id="string", writer="string"), *self.key_schema])


class Batch:
    """Values of some records, each key once per record."""

    def __init__(self, measure: Measure):
        self.measure = measure
        self._rows: dict[tuple, float] = {}
        self._records: dict[int, None] = {}
        self._at: int | None = None

    def record(self, record_id: int) -> Batch:
        self._at = record_id
        self._records[record_id] = None
        return self

    def put(self, value: float, *key: str) -> Batch:
        if self._at is None:
            raise MeasureError("begin a record first")
        if len(key) != len(self.measure.fields):
            raise MeasureError(f"a key of {self.measure.name} has {len(self.measure.fields)} fields")
        if value is None:
            raise MeasureError("a value is a number")
        at = (self._at, *key)
        if at in self._rows:
            raise MeasureError(f"record {self._at} has {key} twice")
        self._rows[at] = float(value)
        return self

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*k, v) for k, v in self._rows.items()], self.measure.key_schema)

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r,) for r in self._records], "record_id long")


def as_rows(measure: Measure, values: Batch | DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(values, records touched) of a batch or of a DataFrame with record_id, the fields and value."""
    if isinstance(values, Batch):
        return values.df(spark), values.records(spark)
    rows = spread(values.select("record_id", *measure.names, F.col("value").cast("double").alias("value")), "record_id")
    per_key = rows.groupBy("record_id", *measure.names).agg(F.count("*").alias("n"), F.count("value").alias("given"))
    twice, record, missing = per_key.agg(F.max(F.col("n") > 1), F.min(F.when(F.col("n") > 1, F.col("record_id"))), F.max(F.col("given") < F.col("n"))).first()
    if twice:
        raise MeasureError(f"record {record} has a key twice")
    if missing:
        raise MeasureError("a value is null")
    return rows, rows.select("record_id").distinct()


class MeasureTable:
    """A measure in a store."""

    def __init__(self, store: Store, measure: Measure):
        self.store, self.measure, self.spark = store, measure, store.spark

    @property
    def values_table(self) -> str:
        return f"{self.measure.name}_value"

    @property
    def contributions_table(self) -> str:
        return f"{self.measure.name}_contribution"

    def create(self) -> MeasureTable:
        def work(c: Change) -> None:
            if not c.exists(self.values_table):
                c.create(self.values_table, self.measure.value_schema)
                c.create(self.contributions_table, self.measure.contribution_schema)
            for name, schema in ((LEDGER, LEDGER_SCHEMA), (WATERMARK, WATERMARK_SCHEMA)):
                if not c.exists(name):
                    c.create(name, schema)

        self.store.change(work)
        return self

    def migrate(self) -> MeasureTable:
        """Adds fields that the definition has and the stored rows lack, with their defaults. Fields can't be dropped."""

        def work(c: Change) -> None:
            for name, schema in ((self.values_table, self.measure.value_schema), (self.contributions_table, self.measure.contribution_schema)):
                old = c.read(name)
                if gone := set(old.columns) - set(schema.names):
                    raise MeasureError(f"fields can't be dropped: {', '.join(sorted(gone))}")
                new = [f for f in self.measure.fields if f.name not in old.columns]
                for f in new:
                    if f.default is None:
                        raise MeasureError(f"new field {f.name} needs a default")
                if new:
                    c.replace(name, old.withColumns({f.name: F.lit(f.default) for f in new}).select(*schema.names))

        self.store.change(work)
        return self

    # writing

    def _stamped(self, rows: DataFrame, part: str, by: str, at: dt.datetime | None) -> DataFrame:
        when = F.lit(at).cast("timestamp_ntz") if at else F.current_timestamp().cast("timestamp_ntz")
        return rows.withColumns({"part": F.lit(part), "written_by": F.lit(by), "written_at": when})

    def append(self, values: Batch | DataFrame, part: str = "", by: str = "", at: dt.datetime | None = None) -> None:
        rows, _ = as_rows(self.measure, values, self.spark)
        self.store.change(lambda c: c.append(self.values_table, self._stamped(rows, part, by, at)))

    def replace(self, values: Batch | DataFrame, part: str = "", by: str = "", at: dt.datetime | None = None) -> None:
        """The batch's records have its values and no others."""
        rows, records = as_rows(self.measure, values, self.spark)

        def work(c: Change) -> None:
            c.delete_keys(self.values_table, records)
            c.append(self.values_table, self._stamped(rows, part, by, at).select(*self.measure.value_schema.names))

        self.store.change(work)

    def append_changes(self, values: Batch | DataFrame, part: str = "", by: str = "", at: dt.datetime | None = None) -> int:
        """Appends the values that differ from the latest of their key, and returns how many."""
        rows, _ = as_rows(self.measure, values, self.spark)
        keys = ["record_id", *self.measure.names]

        def work(c: Change) -> int:
            last = spread(c.read(self.values_table), "record_id").groupBy(*keys).agg(F.max_by("value", F.struct("written_at", "part", "value")).alias("value"))
            new = without(rows, last, keys, same="value")
            n = new.count()
            if n:
                c.append(self.values_table, self._stamped(new, part, by, at))
            return n

        return self.store.change(work)

    def delete_records(self, records: Iterable[int]) -> None:
        keys = self.spark.createDataFrame([(int(r),) for r in records], "record_id long")
        self.store.change(lambda c: c.delete_keys(self.values_table, keys))

    # reading

    def query(self) -> MeasureQuery:
        return MeasureQuery(self)

    def parts(self) -> DataFrame:
        return spread(self.store.read(self.values_table), "record_id").groupBy("part").agg(F.count("*").alias("values"), F.countDistinct("record_id").alias("records")).orderBy("part")

    def value_count(self) -> int:
        return self.store.read(self.values_table).count()

    def record_count(self) -> int:
        return spread(self.store.read(self.values_table).select("record_id"), "record_id").distinct().count()

    def key_count(self) -> int:
        return self.store.read(self.values_table).select(*self.measure.names).distinct().count()

    # archives

    def archive(self, location: str, part: str) -> int:
        """Moves a part's values to Parquet files, sorted for reading, and returns how many there were."""
        rows = self.store.read(self.values_table).filter(F.col("part") == part)
        n = rows.count()
        if not n:
            return 0
        folder = f"{location.rstrip('/')}/measure={self.measure.name}/part={part}"
        # few settings of the fields are there, so the ranges go on by record
        rows.repartitionByRange(tasks_for(rows), *self.measure.names, "record_id").sortWithinPartitions(*self.measure.names, "record_id").write.option("compression", "zstd").mode("overwrite").parquet(folder)
        notes = json.dumps({"measure": self.measure.name, "fields": self.measure.names, "part": part})
        self.spark.createDataFrame([(notes,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}_notes")
        self.store.change(lambda c: c.delete_keys(self.values_table, self.spark.createDataFrame([(part,)], "part string")))
        return n

    def archive_notes(self, *locations: str) -> DataFrame:
        """What was noted beside archives: measure, part, fields."""
        lines = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text([f"{x.rstrip('/')}/measure={self.measure.name}/*_notes" for x in locations])
        return lines.select(F.from_json("value", "measure string, part string, fields array<string>").alias("n")).select("n.*")

    def archive_when_larger_than(self, location: str, most_bytes: int) -> list[str]:
        """Archives parts, those with the oldest writes first and never the last one, until the table is small enough."""
        gone = []
        while self.store.bytes_used(self.values_table) > most_bytes:
            parts = self.store.read(self.values_table).groupBy("part").agg(F.min("written_at").alias("since")).orderBy("since", "part").limit(2).collect()
            if len(parts) < 2:
                break
            self.archive(location, parts[0]["part"])
            gone.append(parts[0]["part"])
        return gone

    def archived(self, *locations: str) -> DataFrame:
        """Archived values, with defaults for fields that older files lack."""
        rows = self.spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*locations)
        return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(self._default(f.name)).cast(f.dataType).alias(f.name) for f in self.measure.value_schema])

    def _default(self, name: str) -> str | None:
        return next((f.default for f in self.measure.fields if f.name == name), None)

    def restore(self, *locations: str) -> int:
        """Puts archived parts back in place of what the table has of them."""
        rows = self.archived(*locations)

        def work(c: Change) -> int:
            c.delete_keys(self.values_table, rows.select("part").distinct())
            c.append(self.values_table, rows)
            return rows.count()

        return self.store.change(work)


@dataclass(frozen=True)
class MeasureQuery:
    """A question to a measure, built step by step; ``df()`` is its answer.

    Without ``columns`` the answer has one row per combination of row fields and ``value``; with it, one column per value
    of that field. Values of different units are never added up: the unit must be among the rows or columns, or narrowed
    to one, or converted.
    """

    table: MeasureTable
    row_fields: tuple[str, ...] = ()
    column_field: str | None = None
    wheres: tuple[tuple[str, tuple], ...] = ()
    record_ids: tuple | DataFrame | None = None
    of_parts: tuple | None = None
    of_writers: tuple | None = None
    conversion: tuple | None = None
    latest: bool = False
    moment: dt.datetime | None = None
    history: MeasureHistory | None = None
    files: tuple[str, ...] = ()
    zeros: bool = False

    def rows(self, *fields: str) -> MeasureQuery:
        for f in fields:
            self.table.measure.field(f) if f != "record_id" else None
        return replace(self, row_fields=fields)

    def columns(self, name: str) -> MeasureQuery:  # noqa: F811
        self.table.measure.field(name)
        return replace(self, column_field=name)

    def where(self, name: str, *values: str) -> MeasureQuery:
        self.table.measure.field(name)
        return replace(self, wheres=(*self.wheres, (name, values)))

    def records(self, ids: Iterable[int] | DataFrame) -> MeasureQuery:
        """Only these records: ids, or a DataFrame with ``record_id``. None at all: no rows."""
        return replace(self, record_ids=ids if isinstance(ids, DataFrame) else tuple(ids))

    def parts(self, *parts: str) -> MeasureQuery:
        return replace(self, of_parts=parts)

    def written_by(self, *writers: str) -> MeasureQuery:
        return replace(self, of_writers=writers)

    def convert_to(self, unit: str, rates: DataFrame, from_column: str = "unit", to_column: str = "to_unit", factor: str = "factor") -> MeasureQuery:
        if self.table.measure.unit is None:
            raise MeasureError("the measure has no unit")
        return replace(self, conversion=(unit, rates, from_column, to_column, factor))

    def latest_per_key(self) -> MeasureQuery:
        """Of several values of a record's key only the last written counts; of those written at once that of the last
        part by name, then the largest."""
        return replace(self, latest=True)

    def as_of(self, moment: dt.datetime, history: MeasureHistory | None = None) -> MeasureQuery:
        return replace(self, moment=moment, history=history)

    def from_files(self, *locations: str) -> MeasureQuery:
        """Archived values, or with ``as_of`` exported history, beside or instead of the table."""
        return replace(self, files=locations)

    def show_zeros(self) -> MeasureQuery:
        return replace(self, zeros=True)

    def _filtered(self, df: DataFrame) -> DataFrame:
        for name, values in self.wheres:
            df = df.filter(F.col(name).isin(*values) if values else F.lit(False))
        if isinstance(self.record_ids, DataFrame):
            df = df.join(self.record_ids.select("record_id").distinct(), "record_id", "left_semi")
        elif self.record_ids is not None:
            df = df.filter(F.col("record_id").isin(*self.record_ids) if self.record_ids else F.lit(False))
        return df

    def _source(self) -> DataFrame:
        if self.moment is not None:
            if self.of_parts is not None or self.of_writers is not None or self.latest:
                raise MeasureError("as_of reads all parts and writers")
            return self._filtered(state_at(self.table, self.moment, self.history, self.files))
        df = self.table.archived(*self.files) if self.files else self.table.store.read(self.table.values_table)
        df = self._filtered(df)
        if self.of_parts is not None:
            df = df.filter(F.col("part").isin(*self.of_parts) if self.of_parts else F.lit(False))
        if self.of_writers is not None:
            df = df.filter(F.col("written_by").isin(*self.of_writers) if self.of_writers else F.lit(False))
        if self.latest:
            keys = ["record_id", *self.table.measure.names]
            df = spread(df, "record_id").groupBy(*keys).agg(F.max_by("value", F.struct("written_at", "part", "value")).alias("value"))
        return df

    def _check_units(self) -> None:
        unit = self.table.measure.unit
        if unit is None or self.conversion or unit in self.row_fields or unit == self.column_field:
            return
        if not any(name == unit and len(values) == 1 for name, values in self.wheres):
            raise MeasureError(f"values of different units can't be added up: narrow {unit} to one, or show it, or convert")

    def column_values(self, df: DataFrame) -> list[str]:
        """Values of the column field in declared order, then by text."""
        order = list(self.table.measure.field(self.column_field).order)
        found = [r[0] for r in df.select(self.column_field).dropna().distinct().limit(10_001).collect()]
        if len(found) > 10_000:
            raise MeasureError("too many values for columns")
        return sorted(found, key=lambda v: (order.index(v) if v in order else len(order), v))

    def df(self) -> DataFrame:
        self._check_units()
        measure = self.table.measure
        shown = [f for f in (*self.row_fields, self.column_field) if f]
        needed = list(dict.fromkeys([*shown, *([measure.unit] if self.conversion else [])]))
        # sums over the fields that matter come first, so that conversion and pivot meet few rows
        source = spread(self._source(), "record_id") if "record_id" in needed else self._source()
        totals = source.groupBy(*needed).agg(F.sum("value").alias("value"))
        if self.conversion:
            unit, rates, a, b, factor = self.conversion
            totals = converted(totals, rates, measure.unit, unit, "value", a, b, factor)
            totals = totals.groupBy(*shown).agg(F.sum("value").alias("value"))
        if not self.zeros and self.moment is not None:
            totals = totals.filter("value <> 0")
        if self.column_field:
            values = self.column_values(totals)
            cells = [F.sum(F.when(F.col(self.column_field) == v, F.col("value"))).alias(v) for v in values]
            totals = totals.groupBy(*self.row_fields).agg(*(cells or [F.sum("value").alias("value")]))
        order: list[Column] = []
        for f in self.row_fields:
            order += declared(f, list(measure.field(f).order)) if f != "record_id" else [F.col(f)]
        return totals.orderBy(*order) if order else totals


# refreshes


@dataclass(frozen=True)
class MeasureRefresh:
    """New states of one or more measures at a moment, committed as one and at most once per id and writer."""

    store: Store
    moment: dt.datetime
    id: str
    writer: str = ""
    entries: tuple[tuple[MeasureTable, str, Any], ...] = ()

    def by(self, writer: str) -> MeasureRefresh:
        return replace(self, writer=writer)

    def _with(self, table: MeasureTable, kind: str, what: Any) -> MeasureRefresh:
        if any(t.measure.name == table.measure.name for t, _, _ in self.entries):
            raise MeasureError(f"the refresh has {table.measure.name} already")
        return replace(self, entries=(*self.entries, (table, kind, what)))

    def full(self, table: MeasureTable, values: Batch | DataFrame) -> MeasureRefresh:
        return self._with(table, FULL, values)

    def increment(self, table: MeasureTable, values: Batch | DataFrame) -> MeasureRefresh:
        return self._with(table, INCREMENT, values)

    def remove(self, table: MeasureTable, records: Iterable[int]) -> MeasureRefresh:
        return self._with(table, REMOVE, tuple(records))

    def commit(self, history: MeasureHistory | None = None) -> bool:
        """Applies the refresh; False if this id of this writer was committed before, here or in the history."""
        if not self.entries:
            raise MeasureError("an empty refresh")
        return self.store.change(lambda c: self._apply(c, history))

    def _apply(self, c: Change, history: MeasureHistory | None) -> bool:
        spark = self.store.spark
        ledger = c.read(LEDGER)
        if history is not None and history.store.exists(LEDGER):
            ledger = ledger.unionByName(history.store.read(LEDGER)).distinct()
        names = [t.measure.name for t, _, _ in self.entries]
        done = {r["measure"] for r in ledger.filter((F.col("refresh_id") == self.id) & (F.col("writer") == self.writer) & F.col("measure").isin(*names)).select("measure").distinct().collect()}
        if done:
            if done != set(names):
                raise MeasureError(f"refresh {self.id} was committed for {', '.join(sorted(done))} only")
            return False
        others = [r["measure"] for r in ledger.filter(F.col("measure").isin(*names) & (F.col("writer") != self.writer)).select("measure").distinct().collect()]
        if others:
            raise MeasureError(f"{', '.join(sorted(others))} has another writer")
        marks = {r["measure"]: r["refreshed_at"] for r in c.read(WATERMARK).filter(F.col("writer") == self.writer).collect()}
        for name in names:
            if name in marks and self.moment < marks[name]:
                raise MeasureError(f"{name} was refreshed at {marks[name]}, after {self.moment}")
        top = ledger.agg(F.max("seq")).first()[0] or 0
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        lines = []
        for i, (table, kind, what) in enumerate(self.entries):
            m = table.measure
            values = c.read(table.values_table)
            keys = ["record_id", *m.names]
            if kind == REMOVE:
                new, touched = spark.createDataFrame([], m.key_schema), spark.createDataFrame([(int(r),) for r in what], "record_id long")
            else:
                new, touched = as_rows(m, what, spark)
            if kind == FULL:
                changes = new
            else:
                # both sides in one stream, summed up per key: a null-safe join would deal them out anew
                old = spread(values.join(touched, "record_id", "left_semi"), "record_id")
                side = lambda df, a, b: df.select(*keys, F.col(a).alias("_new") if a else F.lit(0.0).alias("_new"), F.col(b).alias("_old") if b else F.lit(0.0).alias("_old"))
                both = spread(side(new, "value", None).unionAll(side(old, None, "value")), "record_id")
                changes = both.groupBy(*keys).agg((F.sum("_new") - F.sum("_old")).alias("value")).filter("value <> 0")
            c.append(table.contributions_table, changes.withColumns({"refresh_id": F.lit(self.id), "writer": F.lit(self.writer)}))
            stamped = new.withColumns({"part": F.lit(""), "written_by": F.lit(self.writer), "written_at": F.lit(self.moment).cast("timestamp_ntz")})
            stamped = stamped.select(*m.value_schema.names)
            if kind == FULL:
                c.replace(table.values_table, stamped)
            else:
                c.delete_keys(table.values_table, touched)
                c.append(table.values_table, stamped)
            lines.append((self.id, self.writer, self.moment, top + 1 + i, m.name, kind, now))
        c.append(LEDGER, spark.createDataFrame(lines, LEDGER_SCHEMA))
        kept = c.read(WATERMARK).filter(~((F.col("writer") == self.writer) & F.col("measure").isin(*names)))
        c.replace(WATERMARK, kept.unionByName(spark.createDataFrame([(self.writer, n, self.moment) for n in names], WATERMARK_SCHEMA)))
        return True


def state_at(table: MeasureTable, moment: dt.datetime, history: MeasureHistory | None = None, files: tuple[str, ...] = ()) -> DataFrame:
    """Values per record and key at a moment: all contributions from the last full set at or before it on.

    Contributions come from the live outbox, the history and exported files; one that several of them have counts once.
    """
    m = table.measure
    state = table.store.state()
    ledger = state.read(LEDGER).filter(F.col("measure") == m.name)
    contributions = state.read(table.contributions_table)
    sources = [contributions]
    if history is not None:
        past = history.store.state()
        if past.exists(PRUNED):
            mark = past.read(PRUNED).filter(F.col("measure") == m.name).agg(F.max("before")).first()[0]
            if mark is not None and moment < mark and not files:
                raise MeasureError(f"the history before {mark} was pruned")
        if past.exists(LEDGER):
            ledger = ledger.unionByName(past.read(LEDGER).filter(F.col("measure") == m.name))
        if past.exists(table.contributions_table):
            sources.append(past.read(table.contributions_table))
    if files:
        exported = table.spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*files).filter(F.col("measure") == m.name)
        ledger = ledger.unionByName(exported.select(*LEDGER_SCHEMA.names).distinct())
        # a day that is being compacted has its rows twice for a moment; a refresh has a record's key once
        given = spread(exported.filter("record_id IS NOT NULL"), "record_id").groupBy("refresh_id", "writer", "record_id", *m.names).agg(F.first("value").alias("value"))
        sources.append(given.select(*m.contribution_schema.names))
    ledger = ledger.filter(F.col("refreshed_at") <= F.lit(moment).cast("timestamp_ntz")).groupBy("writer", "refresh_id").agg(F.max("seq").alias("seq"), F.max("kind").alias("kind"))
    since = ledger.filter(F.col("kind") == FULL).agg(F.max("seq")).first()[0]
    if since is not None:
        ledger = ledger.filter(F.col("seq") >= since)
    merged = sources[0]
    id_of = ["refresh_id", "writer"]
    for more in sources[1:]:
        # a refresh's contributions move as a whole: a source adds the refreshes that those before it don't have
        # refreshes are few and each has many rows: a shuffle by refresh would put all of one into one task
        merged = merged.unionByName(more.join(broadcast_if_small(merged.select(*id_of).distinct()), id_of, "left_anti"))
    met = spread(merged.join(broadcast_if_small(ledger.select(*id_of)), id_of, "left_semi"), "record_id")
    return met.groupBy("record_id", *m.names).agg(F.sum("value").alias("value"))


class MeasureHistory:
    """Shipped refreshes of measures, in a store of their own."""

    def __init__(self, store: Store):
        self.store = store

    def ship(self, table: MeasureTable) -> tuple[int, int]:
        """Moves the live outbox to the history and returns (refreshes, contributions) newly shipped.

        The history takes ledger entries and contributions in one change; only then is the outbox cleared. A crash in
        between leaves both, and the next call ships nothing twice."""
        m, live = table.measure, table.store.state()
        waiting = live.read(LEDGER).filter(F.col("measure") == m.name)

        def work(c: Change) -> tuple[int, int]:
            for name, schema in ((LEDGER, LEDGER_SCHEMA), (table.contributions_table, m.contribution_schema)):
                if not c.exists(name):
                    c.create(name, schema)
            new = waiting.join(c.read(LEDGER).filter(F.col("measure") == m.name).select("writer", "refresh_id"), ["writer", "refresh_id"], "left_anti")
            rows = live.read(table.contributions_table).join(broadcast_if_small(new.select("writer", "refresh_id")), ["writer", "refresh_id"], "left_semi")
            shipped, n = new.count(), rows.count()
            if shipped:
                c.append(table.contributions_table, rows.select(*m.contribution_schema.names))
                c.append(LEDGER, new.select(*LEDGER_SCHEMA.names))
            return shipped, n

        result = self.store.change(work)
        done = waiting.select("writer", "refresh_id")
        table.store.change(lambda c: c.delete_keys(table.contributions_table, done))
        return result

    def forget_shipped(self, table: MeasureTable, older_than: dt.timedelta, now: dt.datetime | None = None) -> int:
        """Takes ledger entries out of the live store that the history has and that were committed long ago."""
        limit = (now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) - older_than
        shipped = self.store.read(LEDGER).select("writer", "refresh_id", "measure")

        def work(c: Change) -> int:
            ledger = c.read(LEDGER)
            gone = ledger.filter(F.col("committed_at") < F.lit(limit).cast("timestamp_ntz")).join(shipped, ["writer", "refresh_id", "measure"], "left_semi")
            n = gone.count()
            if n:
                c.delete_keys(LEDGER, gone.select("writer", "refresh_id", "measure"))
            return n

        return table.store.change(work)

    def rebuild(self, table: MeasureTable, at: dt.datetime | None = None) -> int:
        """Sets the live values to the history's state, now or at a moment. Refused while the outbox holds anything."""
        m = table.measure
        if table.store.read(table.contributions_table).take(1):
            raise MeasureError("ship first: contributions wait")
        state = state_at(table, at or dt.datetime(9999, 1, 1), self).filter("value <> 0")
        rows = state.withColumns({"part": F.lit(""), "written_by": F.lit("rebuild"), "written_at": F.current_timestamp().cast("timestamp_ntz")})
        table.store.change(lambda c: c.replace(table.values_table, rows.select(*m.value_schema.names)))
        return table.value_count()

    def export(self, table: MeasureTable, location: str) -> int:
        """Writes refreshes that were not exported yet, a folder per day, each once, and returns how many there were.

        An attempt writes to a folder of its own that readers don't see. Only that of the attempt which was published is
        moved to its days, file by file; what a crash leaves behind is moved by the next export."""
        m, mark = table.measure, f"{table.measure.name}_exported"
        exported_schema = columns(writer="string", refresh_id="string", attempt="string")
        place = self.store.files.__class__(table.spark, f"{location.rstrip('/')}/measure={m.name}")
        tries: list[str] = []

        def work(c: Change) -> int:
            if not c.exists(mark):
                c.create(mark, exported_schema)
            ledger = c.read(LEDGER).filter(F.col("measure") == m.name).join(c.read(mark), ["writer", "refresh_id"], "left_anti")
            n = ledger.count()
            if n:
                attempt = uuid.uuid4().hex
                tries.append(attempt)
                found = c.read(table.contributions_table)
                # a day may have nearly all rows: its files are as many as its rows call for, until they are compacted; the
                # ledger's columns come after the shuffle
                tasks = tasks_for(found)
                dealt = found.repartition(tasks, "record_id") if tasks > 1 else found
                # a row for each contribution, and one for a refresh that has none
                with_rows = dealt.join(broadcast_if_small(ledger), ["writer", "refresh_id"])
                bare = broadcast_if_small(found.select("writer", "refresh_id").distinct())
                bare = ledger.join(bare, ["writer", "refresh_id"], "left_anti")
                rows = with_rows.unionByName(bare, allowMissingColumns=True)
                day = F.to_date("refreshed_at").cast("string")
                rows = rows.select(*LEDGER_SCHEMA.names, "record_id", *m.names, "value", day.alias("day"))
                rows = rows.repartition("day") if tasks == 1 else rows
                rows.write.option("compression", "zstd").partitionBy("day").parquet(f"{place.root}/_{attempt}")
                c.append(mark, ledger.select("writer", "refresh_id", F.lit(attempt).alias("attempt")))
            return n

        n = self.store.change(work)
        for attempt in tries[:-1]:
            place.delete(f"_{attempt}")
        self._settle(place, mark)
        return n

    def _settle(self, place: FileSystem, mark: str) -> None:
        """Moves the files of published attempts to their days."""
        waiting = {n for n in place.names("") if n.startswith("_")}
        if not waiting:
            return
        published = {f"_{r['attempt']}" for r in self.store.read(mark).select("attempt").distinct().collect()}
        for folder in sorted(waiting & published):
            for day in place.names(folder):
                for file in place.names(f"{folder}/{day}") if day.startswith("day=") else []:
                    if file.endswith(".parquet"):
                        place.move(f"{folder}/{day}/{file}", f"{day}/{folder[1:]}-{file}")
            place.delete(folder)

    def compact(self, table: MeasureTable, location: str, day: dt.date) -> int:
        """One file in place of a day's files, or one for each ``FILE_BYTES`` of them; returns how many there were. Readers
        that meet both count rows once."""
        place = self.store.files.__class__(table.spark, f"{location.rstrip('/')}/measure={table.measure.name}")
        folder = f"day={day.isoformat()}"
        names = [n for n in place.names(folder) if n.endswith(".parquet")]
        size = sum(place.size(f"{folder}/{n}") for n in names)
        files = max(1, -(-size // FILE_BYTES))
        if len(names) > files:
            new = f"_{uuid.uuid4().hex}"
            rows = spread(table.spark.read.parquet(*[f"{place.root}/{folder}/{n}" for n in names]), "record_id").distinct()
            rows.repartition(files).write.option("compression", "zstd").parquet(f"{place.root}/{new}")
            for file in place.names(new):
                if file.endswith(".parquet"):
                    place.move(f"{new}/{file}", f"{folder}/{new[1:]}-{file}")
            place.delete(new)
            for n in names:
                place.delete(f"{folder}/{n}")
        return len(names)

    def prune(self, table: MeasureTable) -> int:
        """Takes out exported contributions from before the last full set, and returns how many there were."""
        m, mark = table.measure, f"{table.measure.name}_exported"
        pruned_schema = columns(measure="string", before="timestamp_ntz")

        def work(c: Change) -> int:
            ledger = c.read(LEDGER).filter(F.col("measure") == m.name)
            last = ledger.filter(F.col("kind") == FULL).orderBy(F.col("seq").desc()).first()
            if last is None or not c.exists(mark):
                return 0
            old = ledger.filter(F.col("seq") < last["seq"]).join(c.read(mark), ["writer", "refresh_id"], "left_semi").select("writer", "refresh_id")
            rows = c.read(table.contributions_table)
            n = rows.join(old, ["writer", "refresh_id"], "left_semi").count()
            if n:
                c.delete_keys(table.contributions_table, old)
                if not c.exists(PRUNED):
                    c.create(PRUNED, pruned_schema)
                c.append(PRUNED, table.spark.createDataFrame([(m.name, last["refreshed_at"])], pruned_schema))
            return n

        return self.store.change(work)


class Dictionary:
    """Small whole-number ids for combinations of fields, made as they are met."""

    def __init__(self, store: Store, name: str, fields: list[str]):
        self.store, self.name, self.fields = store, name, fields

    def create(self) -> Dictionary:
        schema = T.StructType([*columns(id="long"), *(T.StructField(f, T.StringType()) for f in self.fields)])
        self.store.change(lambda c: None if c.exists(self.name) else c.create(self.name, schema, ["id"]))
        return self

    def resolve(self, df: DataFrame) -> DataFrame:
        """``df`` with ``id``; combinations that have none get the next ones, in the order of their fields."""

        def work(c: Change) -> None:
            known = c.read(self.name)
            on = [F.col(f"n.{f}").eqNullSafe(F.col(f"k.{f}")) for f in self.fields]
            new = df.select(*self.fields).distinct().alias("n").join(known.alias("k"), on, "left_anti")
            if new.take(1):
                from tessera.operators.ordering import numbered

                top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
                c.append(self.name, numbered(new, [F.col(f).asc_nulls_last() for f in self.fields], "id").withColumn("id", F.col("id") + 1 + top).select("id", *self.fields))

        self.store.change(work)
        known = self.store.read(self.name)
        on = [F.col(f"n.{f}").eqNullSafe(F.col(f"k.{f}")) for f in self.fields]
        return df.alias("n").join(known.alias("k"), on).select("n.*", "k.id")
