"""Working on a table whose columns may have any names, and on rows that repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut

#: Narrow rows (a few numbers each) that may go to every task, and the bytes that their texts, such as names, may have.
FEW, FEW_BYTES = 1_000_000, 64 << 20


def anonymous(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` under names that clash with no operator's own (these begin with an underscore), the new name of each
    column, and a function that gives a result its old columns back."""
    names = docs.columns
    new = [f"c{i}" for i in range(len(names))]
    return docs.toDF(*new), dict(zip(names, new, strict=True)), lambda df: df.select(*new).toDF(*names)


def beside(docs: DataFrame, *added: str) -> DataFrame:
    """``docs`` with its columns that are named like ``added`` ones under the same name and as many underscores more as
    make it new."""
    taken = {c.lower() for c in docs.columns} | {a.lower() for a in added}
    clash = {a.lower() for a in added}
    names = []
    for c in docs.columns:
        if c.lower() in clash:
            while c.lower() in taken:
                c += "_"
            taken.add(c.lower())
        names.append(c)
    return docs.toDF(*names) if names != docs.columns else docs


def few(df: DataFrame, most: int = FEW, most_bytes: int = FEW_BYTES) -> bool:
    """Whether ``df``, which was cut, has so few narrow rows, with so short names, that they may go to every task."""
    if df.limit(most + 1).count() > most:
        return False
    names = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    return not names or (df.agg(F.sum(sum(names[1:], names[0]).cast("long"))).first()[0] or 0) <= most_bytes


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    return F.broadcast(df) if few(df, most) else df


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """``df`` as if nothing were known of how its rows are dealt by ``key``, a whole number. A join then shuffles both
    sides plainly, and adaptive execution can split the partitions of the other side's hot keys."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that can be hashed.

    For aggregates only: of a projection Catalyst would note that the hash equals this expression, and rename each of its
    columns in that note or not, which is two to the power of the columns."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def place(key: str = "_key", row: str = "_id") -> Column:
    """The order of rows: by key, null keys last, then by the text's hash."""
    return F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col(row).alias("i"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return (left["_id"] == right["_id"]) & left["_key"].eqNullSafe(right["_key"])


def keeping(named: DataFrame, rows: DataFrame, stay: DataFrame) -> DataFrame:
    """``named`` (``_key``, ``_id`` and anything else) without the rows that don't stay, and once what stays repeatedly: of
    rows that share key and text the one with the smallest hash of all columns.

    ``rows``: ``_key, _id`` and ``_fp`` of each row; ``stay``: for each ``_fp`` the ``place`` of the row that stays. Where
    few rows go and none repeat, only keys and hashes are shuffled; else rows move once to meet them, and are written."""
    each = rows.groupBy("_key", "_id", "_fp").agg(F.count("*").alias("_n")).join(stay, "_fp")
    odd = cut(each.select("_key", "_id", "_n", place().eqNullSafe(F.col("_stay")).alias("_stays")).filter("NOT _stays OR _n > 1"))
    gone, twice = odd.filter("NOT _stays"), odd.filter("_stays")
    small = few(odd)
    if small:
        gone, twice = F.broadcast(gone), F.broadcast(twice)
    kept = named.join(gone, same_row(named, gone), "left_anti")
    if not odd.filter("_stays").take(1):
        return kept if small else cut(kept)
    once = kept.join(twice, same_row(kept, twice), "left_semi")
    once = once.groupBy("_key", "_id").agg(F.min_by(F.struct(*named.columns), row_hash(named)).alias("_row")).select("_row.*")
    return cut(kept.join(twice, same_row(kept, twice), "left_anti")).unionAll(cut(once))
