"""What tables there are, what is in them, and queries to begin with."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.aggregates import summarize


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    description: str = ""
    unit: str = ""


@dataclass(frozen=True)
class Profile:
    """A table's columns measured, its rows counted, and some of them."""

    columns: list[dict]
    count: int
    sample: list[dict]


class Catalog:
    """The views and tables of a session, with descriptions and units of their columns."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, str] = {}
        self._columns: dict[tuple[str, str], tuple[str, str]] = {}

    def table_names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def describe_table(self, table: str, description: str) -> None:
        self._tables[table] = description

    def describe_column(self, table: str, column: str, description: str = "", unit: str = "") -> None:
        if column not in self.spark.table(table).columns:
            raise LookupError(f"{table} has no column {column}")
        self._columns[(table, column)] = (description, unit)

    def apply(self, table: str, layout) -> None:
        """Takes descriptions and units from a layout."""
        for c in layout.columns:
            if c.description or c.unit:
                self.describe_column(table, c.name, c.description, c.unit)

    def columns(self, table: str) -> list[ColumnInfo]:
        out = []
        for f in self.spark.table(table).schema:
            description, unit = self._columns.get((table, f.name), (f.metadata.get("description", ""), f.metadata.get("unit", "")))
            out.append(ColumnInfo(f.name, f.dataType.simpleString(), description, unit))
        return out

    def tables(self) -> dict[str, list[ColumnInfo]]:
        return {t: self.columns(t) for t in self.table_names()}

    def describe(self, *tables: str) -> str:
        """A text of tables and columns, for readers."""
        lines = []
        for t in tables or self.table_names():
            note = self._tables.get(t, "")
            lines.append(f"{t}: {note}" if note else t)
            for c in self.columns(t):
                extra = "; ".join(x for x in (c.description, f"in {c.unit}" if c.unit else "") if x)
                lines.append(f"  {c.name} {c.type}" + (f" ({extra})" if extra else ""))
        return "\n".join(lines)

    def profile(self, table: str, sample: int = 5) -> Profile:
        df = self.spark.table(table)
        measured = [r.asDict() for r in summarize(df).collect()]
        n = measured[0]["count"] if measured else df.count()
        return Profile(measured, n, [r.asDict() for r in df.limit(sample).collect()])

    def distinct_values(self, table: str, column: str, most: int = 100) -> list | None:
        """The values of a column in order, or None if there are more than ``most``."""
        rows = self.spark.table(table).select(column).dropna().distinct().limit(most + 1).collect()
        return sorted(r[0] for r in rows) if len(rows) <= most else None


@dataclass(frozen=True)
class Example:
    title: str
    sql: str


def quoted(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) else "`" + name.replace("`", "``") + "`"


def families(columns: list[str], least: int = 3) -> dict[str, list[str]]:
    """Columns that differ by a number only, such as cpu_1 to cpu_64, by their common stem."""
    found: dict[str, list[str]] = {}
    for c in columns:
        if m := re.fullmatch(r"(.*?[A-Za-z_])_?(\d+)", c):
            found.setdefault(m[1].rstrip("_"), []).append(c)
    return {k: v for k, v in found.items() if len(v) >= least}


class QueryExamples:
    """Queries that fit a table, made from its schema and a few facts about its data. All of them run."""

    def __init__(self, spark: SparkSession, groups: int = 20, sample: int = 10_000):
        self.spark, self.groups, self.sample = spark, groups, sample

    def _kinds(self, df: DataFrame) -> dict[str, list[str]]:
        kinds: dict[str, list[str]] = {"number": [], "text": [], "time": [], "group": []}
        grouped = families(df.columns)
        members = {c for cs in grouped.values() for c in cs}
        for f in df.schema:
            if isinstance(f.dataType, T.NumericType) and f.name not in members:
                kinds["number"].append(f.name)
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                kinds["time"].append(f.name)
            elif isinstance(f.dataType, T.StringType):
                kinds["text"].append(f.name)
        if kinds["text"]:
            head = df.limit(self.sample)
            counts = head.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(kinds["text"])], F.count("*").alias("n")).first()
            kinds["group"] = [c for i, c in enumerate(kinds["text"]) if 1 < counts[f"d{i}"] <= self.groups and counts["n"] > counts[f"d{i}"]]
        return kinds

    def of(self, table: str) -> list[Example]:
        df, t = self.spark.table(table), quoted(table)
        kinds, out = self._kinds(df), []
        add = lambda title, sql: out.append(Example(title, sql))
        add("How many rows", f"SELECT count(*) AS n FROM {t}")
        add("First rows", f"SELECT * FROM {t} LIMIT 10")
        numbers = [c for c in kinds["number"] if not re.search(r"(^|_)(id|key)$|key$", c.lower())] or kinds["number"]
        group = kinds["group"][0] if kinds["group"] else None
        if numbers:
            n = quoted(numbers[0])
            add(f"Summary of {numbers[0]}", f"SELECT count({n}) AS n, min({n}) AS low, avg({n}) AS mean, max({n}) AS high FROM {t}")
            add(f"Percentiles of {numbers[0]}", f"SELECT percentile({n}, 0.5) AS p50, percentile({n}, 0.9) AS p90, percentile({n}, 0.99) AS p99 FROM {t}")
            add(f"Rows with the largest {numbers[0]}", f"SELECT * FROM {t} ORDER BY {n} DESC NULLS LAST LIMIT 10")
        if group:
            g = quoted(group)
            add(f"Rows per {group}", f"SELECT {g}, count(*) AS n FROM {t} GROUP BY {g} ORDER BY n DESC, {g}")
            if numbers:
                add(f"{numbers[0]} per {group}", f"SELECT {g}, avg({quoted(numbers[0])}) AS mean, count(*) AS n FROM {t} GROUP BY {g} ORDER BY {g}")
        for c in kinds["time"][:1]:
            time = quoted(c)
            add(f"Range of {c}", f"SELECT min({time}) AS first, max({time}) AS last FROM {t}")
            add(f"Rows per hour of {c}", f"SELECT date_trunc('hour', {time}) AS hour, count(*) AS n FROM {t} GROUP BY 1 ORDER BY 1")
            add(f"Rows per month of {c}", f"SELECT date_trunc('month', {time}) AS month, count(*) AS n FROM {t} GROUP BY 1 ORDER BY 1")
            if group:
                add(f"Latest row per {group}", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {quoted(group)} ORDER BY {time} DESC) AS place FROM {t}) WHERE place = 1")
        free = [c for c in kinds["text"] if c not in kinds["group"]]
        if free:
            words = self._word(df, free[0])
            add(f"Search in {free[0]}", f"SELECT * FROM {t} WHERE {quoted(free[0])} ILIKE '%{words}%' LIMIT 10")
        level = next((c for c in kinds["group"] if c.lower() in ("level", "severity")), None)
        if level and kinds["time"]:
            add("Errors per hour", f"SELECT date_trunc('hour', {quoted(kinds['time'][0])}) AS hour, count(*) AS n FROM {t} WHERE upper({quoted(level)}) = 'ERROR' GROUP BY 1 ORDER BY 1")
        for stem, members in list(families(df.columns).items())[:3]:
            if all(isinstance(df.schema[c].dataType, T.NumericType) for c in members):
                shown = members[:50]
                add(f"Mean of the {stem} family", "SELECT " + ", ".join(f"avg({quoted(c)}) AS {quoted(c)}" for c in shown) + f" FROM {t}")
                if len(shown) > 1:
                    add(f"Largest of the {stem} family per row", f"SELECT greatest({', '.join(map(quoted, shown))}) AS top FROM {t} LIMIT 10")
        return out

    def _word(self, df: DataFrame, column: str) -> str:
        row = df.select(F.substring(F.col(f"`{column}`"), 1, 200)).dropna().first()
        found = re.findall(r"[A-Za-z]{3,}", row[0]) if row else []
        return found[0] if found else "the"

    def joins(self, left: str, right: str) -> list[Example]:
        """Joins on columns that both tables have, or whose names end alike in a key."""
        a, b = self.spark.table(left), self.spark.table(right)
        out = []
        for x in a.schema:
            for y in b.schema:
                same = x.name == y.name or x.name.split("_")[-1] == y.name.split("_")[-1] and re.search(r"(id|key)$", x.name.lower())
                if same and x.dataType == y.dataType:
                    out.append(Example(f"{left} with {right} by {x.name}", f"SELECT * FROM {quoted(left)} l JOIN {quoted(right)} r ON l.{quoted(x.name)} = r.{quoted(y.name)} LIMIT 10"))
        return out
