"""Aggregations, pivots and roll-ups with the null rules that Spark's own forms lack."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.lineage import cut


def latest(df: DataFrame, keys: list[str], order: str | list[str], value: str) -> DataFrame:
    """``value`` of each key's last row by ``order`` among those whose value is not null."""
    order = [order] if isinstance(order, str) else order
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_per_key(df: DataFrame, keys: list[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (what QUALIFY and DISTINCT ON are used for)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def pivot(df: DataFrame, by: list[str], on: Column | str, aggregates: dict[str, Column], values: list[Any] | None = None, most: int = 1000) -> DataFrame:
    """One row per ``by`` and a column ``<value>_<name>`` per value of ``on`` and aggregate (just ``<value>`` if there is
    one aggregate).

    Values are found in the data if not given, in text order, and more than ``most`` are refused. Each column is a
    conditional aggregate, so one pass over the data does it and counts of empty cells are 0 while sums are null.
    ``aggregates`` are made of columns; a count is ``F.count(...)``.
    """
    on = F.col(on) if isinstance(on, str) else on
    if values is None:
        found = df.select(on.cast("string").alias("v")).dropna().distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} values to pivot on")
        values = sorted(r["v"] for r in found)
        on = on.cast("string")
    groups = df.withColumn("_on", on)
    cells = groups.groupBy(*by, "_on").agg(*[c.alias(f"_{i}") for i, c in enumerate(aggregates.values())])
    counts = {i for i, c in enumerate(aggregates.values()) if re.match(r"Column<'count\(", str(c))}
    columns = []
    for v in values:
        for i, name in enumerate(aggregates):
            cell = F.max(F.when(F.col("_on") == F.lit(v), F.col(f"_{i}")))
            label = str(v) if len(aggregates) == 1 else f"{v}_{name}"
            columns.append((F.coalesce(cell, F.lit(0)) if i in counts else cell).alias(label))
    return cells.groupBy(*by).agg(*columns)


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per row and named column; cells that are null give none."""
    return df.unpivot(ids, columns, name, value).filter(F.col(value).isNotNull())


def family(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose whole name matches, in order."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def row_total(columns: list[str]) -> Column:
    """Sum of a row's values that are not null; null if all are."""
    present = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x))


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: type, smallest, largest, approximate distinct values, mean, deviation, quartiles, share of
    nulls. All columns are measured in one pass over the table."""
    measures: list[Column] = [F.count("*").alias("n")]
    for i, f in enumerate(df.schema.fields):
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        plain = not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        text = c.cast("string") if plain else F.to_json(F.struct(c))
        wide = c.cast("double") if number else F.lit(None).cast("double")
        shown = F.min(c).cast("string") if plain else F.min(text), F.max(c).cast("string") if plain else F.max(text)
        measures += [shown[0].alias(f"lo{i}"), shown[1].alias(f"hi{i}"), F.approx_count_distinct(text).alias(f"d{i}"), F.avg(wide).alias(f"a{i}"), F.stddev_samp(wide).alias(f"s{i}"), F.percentile_approx(wide, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}"), F.count(c).alias(f"c{i}")]
    row = df.agg(*measures)
    out = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
            F.col(f"d{i}").alias("approx_unique"),
            F.col(f"a{i}").alias("avg"),
            F.col(f"s{i}").alias("std"),
            *[F.get(f"q{i}", F.lit(k)).alias(f"q{25 * (k + 1)}") for k in range(3)],
            F.col("n").alias("count"),
            F.when(F.col("n") > 0, F.round(100.0 * (F.col("n") - F.col(f"c{i}")) / F.col("n"), 2)).alias("null_percentage"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return row.select(F.inline(F.array(*out)))


#: Ranges that values are counted by to find a quantile's, and rows up to which a group's values are kept in one task.
RANGES, KEPT_ROWS = 4096, 5_000_000
#: A table that Catalyst guesses to be no larger isn't counted.
SURE_BYTES = 32 << 20
_MOST = 8.9e307


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], kept: int = KEPT_ROWS) -> DataFrame:
    """Quantiles of a number per group, with linear interpolation between neighbouring values, one column per name.

    Null and NaN values don't count; a group without others has nulls, and null keys are a group. Infinite values count as
    plus or minus 8.9e307. Of tables of more than ``kept`` rows no task holds a group's values: see ``_ranked``.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    number = F.col(value).cast("double")
    rows = df.select(group.alias("_g"), F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.least(number, F.lit(_MOST)), F.lit(-_MOST))).alias("_v"))
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if kept and guess <= SURE_BYTES or rows.count() <= kept:
        out = rows.groupBy("_g").agg(F.percentile("_v", F.array(*map(F.lit, shares.values()))).alias("_p")).select("_g", *[F.col("_p")[i].alias(n) for i, n in enumerate(shares)])
    else:
        out = _ranked(rows, shares)
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in by], *shares)


def _ranked(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Quantiles of ``_v`` per ``_g`` by ranges: values are counted per group and range (``RANGES`` that cut the span from
    the smallest to the largest value evenly), running counts tell which range holds a wanted rank, and the values of
    that range are counted by ranges of their own, until the rank is that of a range's smallest or largest value."""
    spans = cut(rows.groupBy("_g").agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("at")) for name, q in shares.items()]))
    asked = spans.filter("_n > 0").select("_g", "_lo", "_hi", wanted.alias("_q"))
    below, weight = F.floor("_q.at"), F.col("_q.at") - F.floor("_q.at")
    ends = F.explode(F.array(F.struct(below.alias("r"), (1 - weight).alias("w")), F.struct((below + 1).alias("r"), weight.alias("w"))))
    ranks = cut(asked.select("_g", "_lo", "_hi", F.col("_q.name").alias("_name"), ends.alias("_e")).select("_g", "_lo", "_hi", "_name", F.col("_e.r").alias("_rank"), F.col("_e.w").alias("_w")).filter("_w > 0"))
    window = ["_g", "_lo", "_hi", "_skip"]  # values from _lo to _hi, of which _skip come before in the group
    open_ = ranks.select("_g", "_lo", "_hi", F.lit(0).cast("long").alias("_skip"), "_rank").distinct()
    known = None
    while True:
        windows = cut(open_.select(*window).distinct())
        width = (F.col("_hi") / RANGES) - (F.col("_lo") / RANGES)
        cell = F.when(width > 0, F.least(F.floor(F.col("_v") / width - F.col("_lo") / width), F.lit(RANGES - 1))).otherwise(F.lit(0)).cast("int")
        near = F.broadcast(windows) if windows.limit(100_001).count() <= 100_000 else windows
        cells = rows.join(near, "_g").filter("_v >= _lo AND _v <= _hi").groupBy(*window, cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        ahead = Window.partitionBy(*window).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("_before", F.col("_skip") + F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
        met = cut(open_.join(placed, window).filter("_rank >= _before AND _rank < _before + _c").select("_g", "_rank", "_before", "_c", "_from", "_to"))
        first, last = F.col("_rank") == F.col("_before"), (F.col("_rank") == F.col("_before") + F.col("_c") - 1) | (F.col("_from") == F.col("_to"))
        found = met.filter(first | last).select("_g", "_rank", F.when(first, F.col("_from")).otherwise(F.col("_to")).alias("_v"))
        known = found if known is None else known.unionAll(found)
        open_ = met.filter(~(first | last)).select("_g", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), F.col("_before").alias("_skip"), "_rank")
        if not open_.take(1):
            break
    values = ranks.join(known, ["_g", "_rank"]).groupBy("_g").agg(*[F.sum(F.when(F.col("_name") == n, F.col("_v") * F.col("_w"))).alias(n) for n in shares])
    return spans.select("_g").join(values, "_g", "left")


def rollup_of(df: DataFrame, dimensions: list[str], totals: dict[str, str]) -> DataFrame:
    """An additive roll-up: per combination of dimensions the rows ``n`` and a sum per name of ``totals``."""
    return df.groupBy(*dimensions).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in totals.items()])


def from_rollup(rollup: DataFrame, by: list[str], totals: list[str]) -> DataFrame:
    """Coarser totals from a roll-up: sums of sums, and means as the sum of totals over the sum of rows."""
    sums = [F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in totals]]
    out = rollup.groupBy(*by).agg(*sums) if by else rollup.agg(*sums)
    return out.withColumns({f"avg_{t}": F.try_divide(F.col(t), F.col("n")) for t in totals})


def conditional_sums(by: list[str], on: str, value: str, values: list[Any]) -> list[Column]:
    """A sum of ``value`` per value of ``on``, named after it."""
    return [F.sum(F.when(F.col(on) == F.lit(v), F.col(value))).alias(str(v)) for v in values]


def time_bucket(time: Column | str, width: str) -> Column:
    """Start of the bucket of ``width`` (``"1 hour"``, ``"15 seconds"``) that a time lies in, counted from the epoch."""
    return F.window(time, width)["start"]


def last_window(df: DataFrame, keys: list[str], time: str, value: str, width: str) -> DataFrame:
    """Mean of ``value`` per key over the last ``width`` of the whole table's time. That time is asked first (Parquet's
    statistics can tell it), so that its bound reaches the scan as a plain value."""
    since = df.agg((F.max(time) - F.expr(f"INTERVAL {width}")).cast("string")).first()[0]
    recent = df.filter(F.col(time) > F.lit(since).cast(df.schema[time].dataType))
    return recent.groupBy(*keys).agg(F.avg(value).alias(f"avg_{value}"), F.count("*").alias("n"))
