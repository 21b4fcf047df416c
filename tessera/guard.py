"""Read-only SQL for callers that aren't trusted: checked by the parser before anything is planned, and capped."""

from __future__ import annotations

import datetime as dt
import decimal
import posixpath
import re
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T

from tessera.plans import parse
from tessera.rows import CancelSignal, Rows


#: Rows that are asked for at once; where the caps allow more, rows are read until one of the caps is met.
AT_ONCE = 100_000

#: Types whose values may take no byte.
EMPTY = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)


class Rejected(Exception):
    """A statement that the guard doesn't run, or a result over its caps."""


class WhenOver(Enum):
    REFUSE = "refuse"
    TRUNCATE = "truncate"


@dataclass(frozen=True)
class QueryPolicy:
    """What guarded queries may read and how much they may return.

    ``tables``: names that may be read (None: all registered ones). Files by path are refused but for those below
    ``folders``, and so are table functions other than ``functions``, whatever is registered.
    """

    max_rows: int = 10_000
    max_bytes: int = 64 << 20
    timeout: float | None = 30.0
    when_over: WhenOver = WhenOver.REFUSE
    tables: frozenset[str] | None = None
    functions: frozenset[str] = frozenset({"range", "explode", "explode_outer", "posexplode", "inline", "stack", "json_tuple"})
    allow_pivot: bool = True
    folders: tuple[str, ...] = ()


@dataclass(frozen=True)
class Result:
    columns: list[str]
    rows: list[Row]
    truncated: bool = False
    notes: list[str] = field(default_factory=list)


def size_of(value: Any) -> int:
    """Bytes that a value takes, about; nested ones with all they hold."""
    if value is None or isinstance(value, bool):
        return 1
    if isinstance(value, str):
        return len(value.encode())
    if isinstance(value, (bytes, bytearray)):
        return len(value)
    if isinstance(value, (int, float, dt.date, dt.timedelta)):
        return 8
    if isinstance(value, decimal.Decimal):
        return 16
    if isinstance(value, dict):
        return sum(size_of(k) + size_of(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return sum(size_of(v) for v in value)
    return 32


class GuardedQuery:
    """Runs single statements that only read."""

    def __init__(self, spark: SparkSession, policy: QueryPolicy = QueryPolicy()):
        self.spark, self.policy = spark, policy

    def why_rejected(self, sql: str) -> str | None:
        """Why the guard won't run a statement; None if it will."""
        if parse.statements(sql) != 1:
            return "one statement is allowed" if parse.statements(sql) else "there is no statement"
        body = sql.strip().rstrip(";")
        words = body.split(None, 2)
        if words and words[0].upper() == "EXPLAIN":
            rest = body[len(words[0]) :].strip()
            for kind in ("EXTENDED", "FORMATTED", "COST", "CODEGEN"):
                if rest.upper().startswith(kind):
                    rest = rest[len(kind) :].strip()
            body = rest
        if (why := parse.is_sql(self.spark, body)) is not None:
            return f"not SQL that can be read: {why}"
        names = parse.node_names(self.spark, body)
        if not self.policy.allow_pivot and any("Pivot" in n for n in names):
            return "PIVOT isn't allowed"
        if other := sorted(n for n in names if n not in parse.READ_NODES):
            return f"only queries are allowed, not {', '.join(other)}"
        local = {n.lower() for n in self._local_names(body)}
        for parts in parse.relations(self.spark, body):
            name = ".".join(parts)
            if len(parts) > 1 and (parts[0].lower() in ("parquet", "csv", "json", "orc", "text", "avro", "binaryfile", "delta", "xml") or "/" in parts[-1]):
                if not self._below(parts[-1]):
                    return f"files can't be read by path: {name}"
                continue
            if self.policy.tables is not None and name.lower() not in {t.lower() for t in self.policy.tables} | local:
                return f"table {name} isn't allowed"
        if other := sorted(f for f in parse.table_functions(self.spark, body) if f not in self.policy.functions):
            return f"table functions aren't allowed: {', '.join(other)}"
        return None

    def _below(self, path: str) -> bool:
        """Whether a path lies in one of the folders that may be read; ways up and patterns are none."""
        plain = posixpath.normpath(path)
        return plain == path.rstrip("/") and not re.search(r"[*?{}\[\]\\]", path) and any(plain.startswith(f"{f.rstrip('/')}/") for f in self.policy.folders)

    def _local_names(self, sql: str) -> list[str]:
        """Names of a statement's own common table expressions."""
        out = []
        for n in parse.nodes(parse.parsed(self.spark, sql)):
            if n.nodeName() in ("UnresolvedWith", "With"):
                out += [r._1() for r in parse._items(n.cteRelations())]
        return out

    def check(self, sql: str) -> None:
        if why := self.why_rejected(sql):
            raise Rejected(why)

    def run(self, sql: str, signal: CancelSignal | None = None, args: dict[str, Any] | None = None) -> Result:
        """The rows, within the caps: one row more is asked for, so that a cut shows. A row has a byte at least for each
        value that isn't a text or a collection, which bounds the rows of the cap of bytes."""
        self.check(sql)
        df = self.spark.sql(sql.strip().rstrip(";"), args=args)
        filled = sum(not isinstance(f.dataType, EMPTY) for f in df.schema)
        most = 1 + (min(self.policy.max_rows, self.policy.max_bytes // filled) if filled else self.policy.max_rows)
        if most <= AT_ONCE:
            rows = Rows(df.limit(most), self.policy.timeout, signal).collect()
        else:
            taken = [0, 0]

            def full(row: Row) -> bool:
                taken[0], taken[1] = taken[0] + 1, taken[1] + size_of(row)
                return taken[0] >= most or taken[1] > self.policy.max_bytes

            rows = Rows(df, self.policy.timeout, signal).until(full)
        over = len(rows) > self.policy.max_rows
        if over and self.policy.when_over is WhenOver.REFUSE:
            raise Rejected(f"more than {self.policy.max_rows} rows")
        rows, kept, total = rows[: self.policy.max_rows], [], 0
        for r in rows:
            total += size_of(r)
            if total > self.policy.max_bytes:
                if self.policy.when_over is WhenOver.REFUSE:
                    raise Rejected(f"more than {self.policy.max_bytes} bytes")
                over = True
                break
            kept.append(r)
        return Result(df.columns, kept, over, ["the result is cut"] if over else [])

    def store(self, sql: str, store, table: str) -> int:
        """Writes a query's whole result to a table of a store, without the caps, and returns its rows."""
        self.check(sql)
        df = self.spark.sql(sql.strip().rstrip(";"))
        store.change(lambda c: c.replace(table, df))
        return store.read(table).count()


def relaxed(policy: QueryPolicy, **changes: Any) -> QueryPolicy:
    return replace(policy, **changes)


class Hardening:
    """Session settings that keep queries off files and settings, as far as a session can say that.

    This is a policy, not a sandbox: code that runs in the session can do what its process can."""

    SETTINGS = {
        "spark.sql.runSQLOnFiles": "false",
        "spark.sql.legacy.allowNonEmptyLocationInCTAS": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.redaction.options.regex": "(?i)url|password|secret|token|key",
    }

    @classmethod
    def apply(cls, spark: SparkSession, shuffle_partitions: int | None = None) -> dict[str, str]:
        wanted = dict(cls.SETTINGS)
        if shuffle_partitions:
            wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return wanted
