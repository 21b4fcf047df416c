"""Big text files as typed tables: lines are parsed once to Parquet, and only what was added is parsed again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordering import numbered
from tessera.rows import CancelSignal, Cancelled
from tessera.store import FileSystem, Store

FINGERPRINT = 64 << 10
#: Bytes that were added to a file and are read from where the last update ended; for more the file is read in parallel.
DELTA = 16 << 20


@dataclass(frozen=True)
class LineSource:
    """Lines of a text file. The last one counts only once its line end is written (``whole_last``: always)."""

    path: str
    encoding: str = "UTF-8"
    skip: int = 0
    line_end: str = "\n"
    whole_last: bool = False

    def lines(self, spark: SparkSession) -> DataFrame:
        """``line`` (number from 0) and ``raw``. Numbers are counted in parallel, in the file's order."""
        text = spark.read.option("lineSep", self.line_end).option("encoding", self.encoding).text(self.path)
        place = text.select(F.col("value").alias("raw"), F.monotonically_increasing_id().alias("_id"))
        out = numbered(place, [F.col("_id")], "line").select("line", F.regexp_replace("raw", "\r$", "").alias("raw"))
        if self.skip:
            out = out.filter(F.col("line") >= self.skip).withColumn("line", F.col("line") - self.skip)
        return out


@dataclass
class RowParser:
    """``parse`` makes a tuple of a raw line (None: no row); ``is_row`` says beforehand which lines are rows."""

    schema: T.StructType
    parse: Callable[[str], tuple | None]
    is_row: Callable[[Any], Any] | None = None  # a Column of the raw line to a boolean Column


@dataclass(frozen=True)
class Updated:
    rows_added: int
    rebuilt: bool
    rows: int


@dataclass
class FileTable:
    """A text file parsed into a table of a store, kept up with the file as it grows.

    ``update`` reads the bytes after the last line known, so keeping up costs what was added. If the file was replaced (it is shorter, or its first 64 KB that
    were there before are others), the table is built anew. Columns computed from the raw line may be added; a column's
    version is part of its identity, and a new version builds the table anew too.
    """

    store: Store
    name: str
    source: LineSource
    parser: RowParser
    columns: dict[str, tuple[str, Callable[[Any], Any], str]] = field(default_factory=dict)

    def column(self, name: str, kind: str, from_raw: Callable[[Any], Any], version: str = "1") -> FileTable:
        """Adds a column computed from the raw line: ``from_raw`` makes a Column from a Column."""
        self.columns[name] = (kind, from_raw, version)
        return self

    def function(self, name: str, kind: str, fn: Callable) -> None:
        """Registers (or replaces) a SQL function for queries on the table; null arguments give null."""
        from tessera.functions.udf import register

        register(self.store.spark, name, kind, fn)

    def _bytes(self, first: int, end: int) -> bytes:
        """Bytes of the file."""
        folder, _, file = self.source.path.rpartition("/")
        fs = FileSystem(self.store.spark, folder)
        stream = fs._fs.open(fs.path(file))
        try:
            stream.seek(first)
            return bytes(self.store.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - first)) if end > first else b""
        finally:
            stream.close()

    def _identity(self) -> dict[str, Any]:
        folder, _, file = self.source.path.rpartition("/")
        size = FileSystem(self.store.spark, folder).size(file)
        head = self._bytes(0, min(size, FINGERPRINT))
        return {"size": size, "head_size": len(head), "head": hashlib.sha256(head).hexdigest(), "head_bytes": head}

    def _line_end(self) -> bytes | None:
        """The bytes that end a line, if lines can be told apart by them from any byte on."""
        try:
            plain = self.source.line_end.encode(self.source.encoding)
        except LookupError:  # an encoding that only the JVM knows
            return None
        return plain if len(plain) == len(self.source.line_end) and not self.source.whole_last else None

    def _whole(self, size: int) -> int:
        """Where the last line that has an end ends."""
        end = self._line_end()
        at = size
        while at > 0:
            first = max(0, at - FINGERPRINT)
            found = self._bytes(first, min(size, at + len(end) - 1)).rfind(end)
            if found >= 0:
                return first + found + len(end)
            at = first
        return 0

    def _added(self, offset: int, end: int, known: int) -> DataFrame:
        """Lines of a part of the file, numbered from ``known`` on."""
        parts = self._bytes(offset, end).split(self._line_end())[:-1]
        lines = [(known + i, p.decode(self.source.encoding, "replace").removesuffix("\r")) for i, p in enumerate(parts)]
        return self.store.spark.createDataFrame(lines, "line long, raw string")

    def _rows(self, lines: DataFrame) -> DataFrame:
        kept = lines.filter(self.parser.is_row(F.col("raw"))) if self.parser.is_row else lines
        schema = T.StructType([T.StructField("line", T.LongType()), *self.parser.schema, T.StructField("_raw", T.StringType())])
        parse, names = self.parser.parse, schema.names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                parsed = [(i, r, parse(r)) for i, r in zip(b["line"], b["raw"], strict=True)]
                yield pd.DataFrame([(i, *p, r) for i, r, p in parsed if p is not None], columns=names)

        rows = kept.mapInPandas(run, schema)
        for name, (kind, from_raw, _) in self.columns.items():
            rows = rows.withColumn(name, from_raw(F.col("_raw")).cast(kind))
        return rows.drop("_raw")

    def _all(self, size: int) -> DataFrame:
        """All lines of the file that have an end."""
        lines = self.source.lines(self.store.spark)
        end = self.source.line_end.encode("UTF-8")[-1:]
        if size and not self.source.whole_last and self._bytes(size - 1, size) != end:
            last = lines.agg(F.max("line")).first()[0]
            if last is not None:
                lines = lines.filter(F.col("line") < last)
        return lines

    def update(self, signal: CancelSignal | None = None) -> Updated:
        """Takes in what the file has more than before; whole, or not at all if the signal stops it."""
        now = self._identity()
        version = json.dumps({n: (k, v) for n, (k, _, v) in sorted(self.columns.items())})
        end = self._whole(now["size"]) if self._line_end() else None

        def work(c) -> Updated:
            notes = c.tables[self.name]["notes"] if c.exists(self.name) else None
            same = notes is not None and notes["version"] == version and now["size"] >= notes["size"] and hashlib.sha256(now["head_bytes"][: notes["head_size"]]).hexdigest() == notes["head"]
            if same and now["size"] == notes["size"]:
                return Updated(0, False, notes["rows"])
            known, before = (notes["lines"], notes["rows"]) if same else (0, 0)
            if signal and signal.cancelled:
                raise Cancelled("the update was stopped")
            offset = notes.get("offset") if same else None
            if known and offset is not None and end is not None and end - offset <= DELTA:
                lines = self._added(offset, end, known)
            else:
                lines = self._all(now["size"]).filter(F.col("line") >= known)
            total = lines.agg(F.coalesce(F.max("line") + 1, F.lit(known))).first()[0]
            folders = len(c.tables[self.name]["folders"]) if same else 0
            rows = self._rows(lines)
            if same:
                c.append(self.name, rows)
            else:
                c.replace(self.name, rows)
            added = c._files(c.tables[self.name]["folders"][folders:]).count()
            c.note(self.name, version=version, size=now["size"], head=now["head"], head_size=now["head_size"], lines=total, offset=end, rows=before + added)
            if signal and signal.cancelled:
                raise Cancelled("the update was stopped")
            return Updated(added, notes is not None and not same, before + added)

        return self.store.change(work)

    def df(self, *columns: str) -> DataFrame:
        """The table; Parquet reads only the columns that a query needs, so none have to be loaded beforehand."""
        df = self.store.read(self.name)
        return df.select(*columns) if columns else df

    def register(self) -> DataFrame:
        df = self.df()
        df.createOrReplaceTempView(self.name)
        return df


class FileTables:
    """The room that cached file tables take, and clearing it."""

    def __init__(self, store: Store):
        self.store, self._used = store, {}

    def touch(self, name: str) -> None:
        self._used[name] = len(self._used) + max(self._used.values(), default=0) + 1

    def size(self) -> int:
        return sum(self.store.bytes_used(n) for n in self.store.names())

    def clear(self, name: str) -> None:
        self.store.change(lambda c: c.drop(name))
        self.store.vacuum(idle=0, table=name)

    def trim(self, most_bytes: int, in_use: frozenset[str] = frozenset()) -> list[str]:
        """Drops tables, those used longest ago first and never those in use, until the room suffices."""
        gone = []
        for name in sorted(self.store.names(), key=lambda n: self._used.get(n, 0)):
            if self.size() <= most_bytes:
                break
            if name not in in_use:
                self.clear(name)
                gone.append(name)
        return gone
