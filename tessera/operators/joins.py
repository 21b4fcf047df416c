"""Joins: pairs of matching rows, as-of lookups, differences of states, unit conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.predicates import Predicate, select

#: Bytes, and rows, that a lookup table may have to be sent to every task.
SMALL_BYTES, SMALL_ROWS = 32 << 20, 500_000


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes: fixed ones by type, texts by their length, nested values by their text."""
    total = F.lit(8)
    for f in schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            total += 16 if isinstance(kind, T.DecimalType) else 8
    return total


def broadcast_if_small(df: DataFrame, most: int = SMALL_BYTES, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its rows take ``most`` bytes or fewer; else as it is, and the join shuffles it.

    A plan that Catalyst guesses to be tiny (a 256th, as it knows no texts' lengths) isn't measured; measuring stops after
    ``rows`` rows, and more are not small."""
    guess = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(guess)) <= most // 256:
        return F.broadcast(df)
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def _exploded(df: DataFrame, attribute: str) -> DataFrame:
    """Rows with ``_on``: the attribute, one row per element if it is an array."""
    if isinstance(df.schema[attribute].dataType, T.ArrayType):
        return df.withColumn("_on", F.explode(F.array_distinct(attribute)))
    return df.withColumn("_on", F.col(attribute))


def pairs(left: DataFrame, right: DataFrame, on_left: str, on_right: str, where_left: Predicate | None = None, where_right: Predicate | None = None) -> DataFrame:
    """Matching rows side by side in the structs ``left`` and ``right``. An array attribute matches by each element."""
    left = select(left, where_left) if where_left else left
    right = select(right, where_right) if where_right else right
    l = _exploded(left, on_left).select("_on", F.struct(*left.columns).alias("left"))  # noqa: E741
    r = _exploded(right, on_right).select("_on", F.struct(*right.columns).alias("right"))
    return l.join(r, "_on").select("left", "right")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], how: str = "inner", prefix: str = "", tie: list[str] | None = None) -> DataFrame:
    """Each left row with ``columns`` of the last right row of its keys at or before its time.

    One sort instead of a join on a range: both sides go into one stream per key, in order of time, right rows first
    where times are equal, and each left row takes the last right row before it. Rows without a key or a time match
    nothing; ``how="left"`` keeps such left rows with nulls. Right rows of equal time are told apart by ``tie`` (the last
    counts). A column of ``columns`` comes out under its name with ``prefix``.

    A key with very many rows is one sorted run, which Spark spills; ``asof_salted`` splits such keys by time, and
    ``asof_any`` counts keys and chooses.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    payload = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    order_tie = F.struct(*[F.col(c) for c in tie]) if tie else F.struct(F.lit(0))
    usable = F.col(right_time).isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    tie_type = right.select(order_tie.alias("t")).schema["t"].dataType
    pay_type = right.select(payload.alias("p")).schema["p"].dataType
    row_type = left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    r = right.filter(usable).select(*named, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), order_tie.alias("_tie"), payload.alias("_p"), F.lit(None).cast(row_type).alias("_row"))
    l = left.select(*named, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), F.lit(None).cast(pay_type).alias("_p"), F.struct(*left.columns).alias("_row"))  # noqa: E741
    timed = F.col("_t").isNotNull()
    for i in range(len(keys)):
        timed &= F.col(f"_k{i}").isNotNull()
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = r.unionByName(l.filter(timed)).withColumn("_m", F.last("_p", ignorenulls=True).over(order)).filter("_side = 1").select("_row", "_m")
    if how == "left":
        met = met.unionByName(l.filter(~timed).select("_row", F.col("_p").alias("_m")))
    else:
        met = met.filter("_m IS NOT NULL")
    return met.select("_row.*", *[F.col(f"_m.c{i}").alias(prefix + c) for i, c in enumerate(columns)])


def asof_salted(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], width: str, how: str = "inner", prefix: str = "", tie: list[str] | None = None) -> DataFrame:
    """``asof`` for keys with very many rows: time is cut into buckets of ``width`` (an interval such as ``"1 day"``).

    The last right row of each (key, bucket) is carried into the later buckets that have none before it, over a table
    of one row per key and bucket; within its bucket every left row is matched as usual, so no task holds a whole key.
    """
    bucket = lambda c: F.window(F.col(c), width)["start"]
    order = F.struct(F.col(right_time), *[F.col(c) for c in tie or []])
    payload = F.struct(F.col(right_time), *[F.col(c) for c in dict.fromkeys([*(tie or []), *columns]) if c != right_time])
    lasts = right.dropna(subset=[*keys, right_time]).groupBy(*keys, bucket(right_time).alias("_bucket")).agg(F.max_by(payload, order).alias("_last"))
    spots = left.dropna(subset=[*keys, left_time]).select(*keys, bucket(left_time).alias("_bucket")).distinct()
    line = lasts.select(*keys, "_bucket", "_last").unionByName(spots.withColumn("_last", F.lit(None).cast(lasts.schema["_last"].dataType)))
    line = line.groupBy(*keys, "_bucket").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.withColumn("_seed", F.last("_last", ignorenulls=True).over(before)).filter("_seed IS NOT NULL").select(*keys, "_bucket", "_seed")
    needed = list(dict.fromkeys([*keys, right_time, *(tie or []), *columns]))
    seeds = carried.select(*keys, "_bucket", *[F.col("_seed").getField(c).alias(c) for c in needed if c not in keys])
    rights = right.select(*needed).withColumn("_bucket", bucket(right_time)).unionByName(seeds.select(*needed, "_bucket"))
    lefts = left.withColumn("_bucket", bucket(left_time))
    return asof(lefts, rights, [*keys, "_bucket"], left_time, right_time, columns, how, prefix, tie).drop("_bucket")


def asof_any(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], how: str = "inner", prefix: str = "", tie: list[str] | None = None, most: int = 5_000_000) -> DataFrame:
    """``asof``, or ``asof_salted`` if some key has more than ``most`` rows: with buckets of time so wide that the largest
    key has about ``most`` rows in each."""
    sides = [df.dropna(subset=[*keys, t]).groupBy(*keys).agg(F.count("*").alias("n"), F.unix_seconds(F.min(t).cast("timestamp")).alias("a"), F.unix_seconds(F.max(t).cast("timestamp")).alias("b")) for df, t in ((left, left_time), (right, right_time))]
    largest = sides[0].unionAll(sides[1]).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).orderBy(F.col("n").desc()).first()
    if largest is None or largest["n"] <= most:
        return asof(left, right, keys, left_time, right_time, columns, how, prefix, tie)
    width = max(1, (largest["b"] - largest["a"]) * most // largest["n"])
    return asof_salted(left, right, keys, left_time, right_time, columns, f"{width} seconds", how, prefix, tie)


def differences(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two states, with ``old`` and ``new``; null where a state lacks the key.

    Values compare null-safe: a key that both have with a null is no difference.
    """
    a = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full")
    changed = ~F.col("old").eqNullSafe(F.col("new")) | F.col("_in_old").isNull() | F.col("_in_new").isNull()
    return both.filter(changed).select(*keys, "old", "new")


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of ``new`` that ``old`` doesn't have with the same value."""
    on = [new[k].eqNullSafe(old[k]) for k in keys] + [new[value].eqNullSafe(old[value])]
    return new.join(old, on, "left_anti")


def converted(values: DataFrame, rates: DataFrame, unit: str, to: str, value: str = "value", from_column: str = "unit", to_column: str = "to_unit", factor: str = "factor") -> DataFrame:
    """``values`` with ``value`` in the unit ``to``. Rows whose unit has no rate to it go."""
    wanted = rates.filter(F.col(to_column) == to).select(F.col(from_column).alias("_unit"), F.col(factor).alias("_factor"))
    met = values.join(broadcast_if_small(wanted), values[unit] == F.col("_unit"))
    return met.withColumns({value: F.col(value) * F.col("_factor"), unit: F.lit(to)}).drop("_unit", "_factor")


def aggregate_then_join(facts: DataFrame, key: str, total: str, dictionary: DataFrame, id: str) -> DataFrame:
    """Totals per key with the key's dictionary columns: sums first, so that the join meets one row per key."""
    sums = facts.groupBy(key).agg(F.sum(total).alias(total))
    return sums.join(broadcast_if_small(dictionary), sums[key] == dictionary[id])
