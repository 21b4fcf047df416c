"""Tables as versioned Parquet folders, changed by publishing a manifest.

A store is a folder. Its manifests ``_manifests/<n>.json`` say for each table which folders of Parquet files make it up,
which keys were deleted from how many of the first of these, its schema, its key and notes. So an upsert, delete or update
by key writes what it changes and no more; readers leave deleted keys out by an anti-join, and once ``MOST_DELETES`` lists
of keys have gathered the table is written anew without them. A change writes new folders first and then creates manifest n + 1; creating it fails if
another writer was faster, and then the change is made again on the newer state. So a change of several tables shows at
once or not at all, readers keep the files of the manifest they began with, and a crash leaves only unused folders.

All files are reached through Hadoop's file system layer, so a store may be on any shared file system.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.spread import without

#: Lists of deleted keys that a table carries at most, and how many keys of theirs may go to every task.
MOST_DELETES, FEW_KEYS = 16, 500_000


class StoreError(Exception):
    """A refused change: a duplicate key, a missing table, a schema that differs."""


class Conflict(StoreError):
    """Another writer published first, as often as it was tried again."""


class FileSystem:
    """The few file operations that a store needs, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Creates a file whole; False if it is there already."""
        if self._fs.exists(self.path(name)):
            return False
        part = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            # FileContext's rename without overwrite is atomic and fails if the name is taken
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.getFileSystem(self._fs.getConf()).getUri(), self._fs.getConf())
            context.rename(part, self.path(name), self._options())
            return True
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def _options(self) -> Any:
        from pyspark import SparkContext

        return SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def move(self, name: str, to: str) -> None:
        """Moves a file to a place that is free; its folder is made."""
        self._fs.mkdirs(self.path(to).getParent())
        if not self._fs.rename(self.path(name), self.path(to)):
            raise StoreError(f"{name} can't be moved to {to}")

    def modified(self, name: str) -> float:
        return self._fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def size(self, name: str) -> int:
        path = self.path(name)
        return int(self._fs.getContentSummary(path).getLength()) if self._fs.exists(path) else 0


class Change:
    """A set of table changes that shows all at once. Reads see the state the change began with, and its own writes."""

    def __init__(self, store: Store, number: int, tables: dict[str, dict]):
        self.store, self.number, self.tables = store, number, tables
        self.touched = False

    def exists(self, name: str) -> bool:
        return name in self.tables

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise StoreError(f"no table {name}")
        entry = self.tables[name]
        schema = T.StructType.fromJson(entry["schema"])
        folders, deletes = entry["folders"], entry.get("deletes", [])
        ends = sorted({len(folders), *(x["before"] for x in deletes)} - {0})
        parts = [self._without(self._files(folders[a:b], schema), [x for x in deletes if x["before"] >= b]) for a, b in zip([0, *ends], ends)]
        return reduce(DataFrame.unionAll, parts) if parts else self.store.spark.createDataFrame([], schema)

    def _files(self, folders: list[str], schema: T.StructType | None = None) -> DataFrame:
        reader = self.store.spark.read.schema(schema) if schema is not None else self.store.spark.read
        return reader.parquet(*[f"{self.store.files.root}/{f}" for f in folders])

    def _without(self, df: DataFrame, deletes: list[dict]) -> DataFrame:
        """``df`` without the rows whose keys the lists hold."""
        for columns in dict.fromkeys(tuple(x["columns"]) for x in deletes):
            lists = [x for x in deletes if tuple(x["columns"]) == columns]
            keys = self._files([x["folder"] for x in lists])
            if sum(x["rows"] for x in lists) <= FEW_KEYS:
                keys = F.broadcast(keys.toDF(*[f"_{c}" for c in columns]))
                df = df.join(keys, [df[c].eqNullSafe(keys[f"_{c}"]) for c in columns], "left_anti")
            else:
                df = without(df, keys.toDF(*columns), list(columns))
        return df

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.tables[name]["schema"])

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.store.files.root}/{folder}")
        return folder

    def create(self, name: str, schema: T.StructType, key: list[str] | None = None, notes: dict | None = None) -> None:
        if name in self.tables:
            raise StoreError(f"table {name} is there already")
        self.tables[name] = {"folders": [], "deletes": [], "schema": _nullable(schema).jsonValue(), "key": key or [], "notes": notes or {}}
        self.touched = True

    def replace(self, name: str, df: DataFrame) -> None:
        """All rows anew; the schema may differ. ``df`` may read the table itself."""
        old = self.tables.get(name, {"key": [], "notes": {}})
        self.tables[name] = old | {"folders": [self._write(name, df)], "deletes": [], "schema": _nullable(df.schema).jsonValue()}
        self.touched = True

    def append(self, name: str, df: DataFrame) -> None:
        if name not in self.tables:
            raise StoreError(f"no table {name}")
        schema = self.schema(name)
        if [f.name for f in schema] != df.columns:
            missing = set(schema.names) ^ set(df.columns)
            if missing:
                raise StoreError(f"columns of {name} differ: {', '.join(sorted(missing))}")
        same = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        entry = self.tables[name]
        self.tables[name] = entry | {"folders": [*entry["folders"], self._write(name, same)]}
        self.touched = True

    def adopt(self, name: str, folders: list[str]) -> None:
        """Adds folders that were written beforehand, in the table's schema."""
        entry = self.tables[name]
        self.tables[name] = entry | {"folders": [*entry["folders"], *folders]}
        self.touched = True

    def drop(self, name: str) -> None:
        self.touched |= self.tables.pop(name, None) is not None

    def note(self, name: str, **notes: Any) -> None:
        self.tables[name] = self.tables[name] | {"notes": self.tables[name]["notes"] | notes}
        self.touched = True

    def upsert(self, name: str, rows: DataFrame, key: list[str] | None = None) -> None:
        """Rows with their keys new or in place of the old ones; of several rows of a key the last one counts, in the
        order of the partitions of ``rows`` (files don't keep one)."""
        key, schema = key or self.tables[name]["key"], self.schema(name)
        same = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]).withColumn("_given", F.monotonically_increasing_id())
        last = same.groupBy(*key).agg(F.max_by(F.struct(*schema.names), "_given").alias("_row")).select("_row.*")
        folder = self._write(name, last)
        self._forget(name, self._files([folder], schema).select(*key))
        self.adopt(name, [folder])

    def _forget(self, name: str, keys: DataFrame) -> None:
        """Deletes the keys from what the table has so far."""
        entry = self.tables[name]
        if not entry["folders"]:
            return
        folder = self._write(name, keys)
        n = self._files([folder]).count()
        if n:
            mark = {"folder": folder, "columns": keys.columns, "before": len(entry["folders"]), "rows": n}
            self.tables[name] = entry | {"deletes": [*entry.get("deletes", []), mark]}
            self.touched = True
        if len(self.tables[name].get("deletes", [])) > MOST_DELETES:
            self.replace(name, self.read(name))

    def insert(self, name: str, rows: DataFrame) -> None:
        """Rows whose keys must be new and not null, each once."""
        key = self.tables[name]["key"]
        if key:
            missing = " OR ".join(f"`{k}` IS NULL" for k in key)
            if rows.filter(missing).take(1):
                raise StoreError(f"a key of {name} is null")
            if rows.groupBy(*key).count().filter("count > 1").take(1) or rows.join(self.read(name).select(*key), key, "left_semi").take(1):
                raise StoreError(f"a key of {name} occurs twice")
        self.append(name, rows)

    def insert_missing(self, name: str, rows: DataFrame) -> None:
        """Rows whose keys are new; others are ignored."""
        key = self.tables[name]["key"]
        self.append(name, rows.dropDuplicates(key).join(self.read(name).select(*key), key, "left_anti"))

    def delete_keys(self, name: str, keys: DataFrame) -> None:
        """Rows whose key columns, those of ``keys``, are among its rows go."""
        schema = self.schema(name)
        self._forget(name, keys.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in keys.columns]).distinct())

    def delete_where(self, name: str, condition: str | Column) -> None:
        """Rows for which the condition is true go. Without a key the table is written anew."""
        hit = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        df, key = self.read(name), self.tables[name]["key"]
        if key:
            self._forget(name, df.filter(hit).select(*key))
        else:
            self.replace(name, df.filter(~hit))

    def update_where(self, name: str, condition: str | Column, values: dict[str, Any]) -> None:
        """Sets columns of the rows for which the condition is true. Without a key the table is written anew."""
        hit = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        old, key = self.read(name), self.tables[name]["key"]
        set_ = {c: (v if isinstance(v, Column) else F.lit(v)).cast(old.schema[c].dataType) for c, v in values.items()}
        if not key:
            self.replace(name, old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in set_.items()}))
            return
        found = old.filter(hit)
        before = [F.col(k).alias(f"_{k}") for k in key]
        folder = self._write(name, found.select(*before, *[set_.get(c, F.col(c)).alias(c) for c in old.columns]))
        changed = self._files([folder])
        self._forget(name, changed.select(*[F.col(f"_{k}").alias(k) for k in key]))
        self.append(name, changed.select(*old.columns))


def _used(entry: dict) -> list[str]:
    return [*entry["folders"], *(x["folder"] for x in entry.get("deletes", []))]


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])


class Store:
    """A folder of tables. ``with`` isn't needed: a store holds nothing open."""

    TRIES = 10

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, FileSystem(spark, root)
        self.metrics = None  # a ``Metrics`` that counts changes and lost races

    def _count(self, name: str) -> None:
        if self.metrics is not None:
            self.metrics.count(name)

    def _latest(self) -> tuple[int, dict[str, dict]]:
        numbers = [int(n[:-5]) for n in self.files.names("_manifests") if n.endswith(".json")]
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(self.files.read(f"_manifests/{max(numbers):012d}.json"))

    def state(self) -> Change:
        """The present state, for reading."""
        return Change(self, *self._latest())

    def change(self, work: Callable[[Change], Any]) -> Any:
        """Runs ``work`` on the present state and publishes what it changed; again if another writer was faster."""
        for _ in range(self.TRIES):
            number, tables = self._latest()
            change = Change(self, number, dict(tables))
            result = work(change)
            if not change.touched or self.files.create(f"_manifests/{number + 1:012d}.json", json.dumps(change.tables)):
                self._count("changes")
                return result
            self._count("lost_races")
        raise Conflict(f"other writers were faster {self.TRIES} times")

    def read(self, name: str) -> DataFrame:
        return self.state().read(name)

    def exists(self, name: str) -> bool:
        return self.state().exists(name)

    def names(self) -> list[str]:
        return sorted(self.state().tables)

    def notes(self, name: str) -> dict:
        return self.state().tables[name]["notes"]

    def bytes_used(self, name: str) -> int:
        return sum(self.files.size(f) for f in _used(self.state().tables[name]))

    def sorted_rewrite(self, name: str, order: list[str], partitions: int | None = None) -> None:
        """The table in files sorted by ``order``, so that scans with a range of it skip files and row groups."""

        def work(c: Change) -> None:
            df = c.read(name)
            ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
            c.replace(name, ranged.sortWithinPartitions(*order))

        self.change(work)

    def compact(self, name: str, target_bytes: int = 128 << 20) -> int:
        """The table in files of about ``target_bytes``; returns how many."""
        parts = max(1, -(-self.bytes_used(name) // target_bytes))
        self.change(lambda c: c.replace(name, c.read(name).repartition(parts)))
        return parts

    def clear(self, name: str) -> None:
        self.change(lambda c: c.replace(name, c.read(name).limit(0)))

    def drop(self, name: str) -> None:
        self.change(lambda c: c.drop(name))

    def analyze(self, name: str) -> dict[str, int]:
        """Counts rows and bytes and notes them with the table."""
        found = {"rows": self.read(name).count(), "bytes": self.bytes_used(name)}
        self.change(lambda c: c.note(name, **found))
        return found

    def describe(self, name: str) -> str:
        entry = self.state().tables[name]
        fields = ", ".join(f"{f['name']} {f['type'] if isinstance(f['type'], str) else f['type']['type']}" for f in entry["schema"]["fields"])
        return f"{name}({fields})" + (f" key {', '.join(entry['key'])}" if entry["key"] else "")

    def vacuum(self, keep: int = 1, idle: float = 86_400.0, table: str | None = None) -> list[str]:
        """Deletes all manifests but the last ``keep`` and the folders that none of these uses.

        A folder younger than ``idle`` seconds may belong to a change that isn't published yet, and stays. With a
        ``table``, only its folders go."""
        names = [n for n in self.files.names("_manifests") if n.endswith(".json")]
        kept = names[-keep:]
        used = {f for n in kept for entry in json.loads(self.files.read(f"_manifests/{n}")).values() for f in _used(entry)}
        limit, gone = time.time() - idle, []
        for name in [table] if table else self.files.names(""):
            if not name.startswith("_"):
                for folder in self.files.names(name):
                    if f"{name}/{folder}" not in used and self.files.modified(f"{name}/{folder}") <= limit:
                        self.files.delete(f"{name}/{folder}")
                        gone.append(f"{name}/{folder}")
        for n in [] if table else names[:-keep]:
            self.files.delete(f"_manifests/{n}")
        return gone


class BulkWriter:
    """Collects rows and writes them in chunks; ``with`` publishes them as one change when it ends.

    A chunk is written as it fills up and costs its own rows, whatever the table holds. ``new_keys`` refuses rows whose
    keys the table has; else rows replace those of the same key (the last of a key counts), or are just added if the
    table has no key. An error inside ``with`` publishes nothing."""

    def __init__(self, store: Store, table: str, chunk: int = 131_072, new_keys: bool = False):
        self.store, self.table, self.chunk, self.new_keys = store, table, chunk, new_keys
        state = store.state()
        self._schema, self._key = state.schema(table), state.tables[table]["key"]
        self._rows: list[tuple] = []
        self._chunks: list[str] = []
        self._given = 0  # rows so far: files don't keep the order of their rows
        self.written = 0

    def add(self, *row: Any) -> None:
        self._rows.append(row)
        if len(self._rows) >= self.chunk:
            self._spill()

    def add_all(self, rows: Any) -> None:
        for row in rows:
            self.add(*row)

    def _spill(self) -> None:
        if self._rows:
            rows = [(*row, self._given + i) for i, row in enumerate(self._rows)]
            self._given += len(rows)
            df = self.store.spark.createDataFrame(rows, T.StructType([*self._schema, T.StructField("_given", T.LongType())]))
            self._chunks.append(self.store.state()._write(self.table, df))
            self._rows = []

    def flush(self) -> None:
        """Publishes what was added so far."""
        self._spill()
        if not self._chunks:
            return
        chunks, self._chunks = self._chunks, []

        def work(c: Change) -> int:
            if not self._key:
                c.adopt(self.table, chunks)
                return c._files(chunks).count()
            rows = c._files(chunks)
            if self.new_keys:
                c.insert(self.table, rows.drop("_given"))
                return rows.count()
            last = rows.groupBy(*self._key).agg(F.max_by(F.struct(*self._schema.names), "_given").alias("_row")).select("_row.*")
            c.upsert(self.table, last)
            return last.count()

        self.written += self.store.change(work)

    def __enter__(self) -> BulkWriter:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is None:
            self.flush()
