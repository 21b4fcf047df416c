"""Sharding by extendible hashing, in DataFrame operations only.

Every document hashes to ``BITS`` bits of its key's MD5. A bucket is all documents that share a prefix of some depth; it
splits on its next bit only while it holds more bytes than a shard may, so shards differ in depth and the directory is
the list of final prefixes. Which prefixes are final depends on sums of bytes alone: the smallest depth at which a
document's prefix fits. So buckets are not split one at a time; one aggregation counts all prefixes down to a depth
chosen from the input's size, and only prefixes that still hold too much are looked at a few bits deeper, round by round.

Documents are never split: one that exceeds the limit by itself ends alone in its shard. Rows that share a key share its
hash; where all its bits are used up, a bucket goes on splitting on a second hash, that of the text. What is still left
then repeats both key and text, and is dealt to overflow pages of equal size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered
from tessera.plans.lineage import cut

BITS = 60
#: Bytes of text that a shard holds at most, in the registered query.
LIMIT = 1 << 20
#: Bits that a further round looks deeper.
STEP = 8


def _hash(key: Column) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: str, depth: Column | int) -> Column:
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.call_function("shiftright", F.col(h), (F.lit(BITS) - depth).cast("int"))


def _split(rest: DataFrame, by: list[str], h: str, limit: int, bottom: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Splits buckets, given by ``by``, on bits of ``h``; the rows with the prefix each comes to rest at (depth ``_d``,
    prefix ``_q``, bytes ``_sb``, rows ``_sn``), and the rows that all bits don't suffice for."""
    top, done, columns = 0, [], rest.columns
    while True:
        fine = rest.groupBy(*by, _prefix(h, bottom).alias("_p")).agg(F.sum("_bytes").alias("_b"), F.count("*").alias("_n"))
        levels = fine.withColumn("_d", F.explode(F.sequence(F.lit(top), F.lit(bottom)))).withColumn("_q", F.expr(f"shiftright(_p, {bottom} - _d)"))
        sums = levels.groupBy(*by, "_d", "_q").agg(F.sum("_b").alias("_sb"), F.sum("_n").alias("_sn"))
        fits = levels.select(*by, "_p", "_d", "_q").join(sums.filter(f"_sb <= {int(limit)} OR _sn = 1"), [*by, "_d", "_q"])
        found = fits.groupBy(*by, "_p").agg(F.min_by(F.struct("_d", "_q", "_sb", "_sn"), "_d").alias("_at"))
        found = cut(found.select(*by, "_p", "_at.*"))
        placed = rest.withColumn("_p", _prefix(h, bottom)).join(found, [*by, "_p"], "left").drop("_p")
        done.append(placed.filter("_d IS NOT NULL"))
        if not fine.join(found, [*by, "_p"], "left_anti").take(1):
            return done, None
        rest = cut(placed.filter("_d IS NULL").select(*columns))
        if bottom == BITS:
            return done, rest
        top, bottom = bottom + 1, min(BITS, bottom + STEP)


def _paged(rest: DataFrame, limit: int) -> DataFrame:
    """Rows that repeat key and text, so many to a page as fit; numbered without gathering a group in one task."""
    rest = cut(rest.withColumn("_row", F.monotonically_increasing_id()))
    placed = numbered(rest, [F.col("_h"), F.col("_h2"), F.col("_row")], "_place")
    first = placed.groupBy("_h", "_h2").agg(F.min("_place").alias("_first"), F.max("_bytes").alias("_most"), F.count("*").alias("_all"))
    fit = F.greatest(F.lit(1), F.expr(f"{int(limit)} div greatest(_most, 1)"))
    out = placed.join(first, ["_h", "_h2"]).withColumn("_fit", fit).withColumn("_page", F.expr("(_place - _first) div _fit"))
    rows = F.least(F.col("_fit"), F.col("_all") - F.col("_page") * F.col("_fit"))
    return out.withColumns({"_sn": rows, "_sb": rows * F.col("_most")})


def _binary(prefix: str, depth: str) -> Column:
    return F.when(F.col(depth) == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), F.col(depth), F.lit("0")))


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``shard`` (its prefix in binary after an ``s``; with ``.page`` if it overflows),
    ``depth``, ``n_bytes`` (UTF-8 bytes of the text; null: 0), ``shard_bytes`` and ``shard_docs`` of its shard.

    A null key hashes as the empty text. An empty table has no shards.
    """
    second = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - BITS)
    sized = cut(docs.select(F.col(key).alias("_key"), _hash(F.col(key)).alias("_h"), second.alias("_h2"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes")))
    total = sized.agg(F.sum("_bytes")).first()[0] or 0
    bottom = min(BITS, max(1, -(-total // limit)).bit_length() + 3)
    whole = F.lit("")
    done, rest = _split(sized, [], "_h", limit, bottom)
    parts = [df.select("_key", "_bytes", F.col("_d").alias("_depth"), "_sb", "_sn", _binary("_q", "_d").alias("_bits"), whole.alias("_over")) for df in done]
    if rest is not None:
        prefix = F.lpad(F.bin("_h"), BITS, F.lit("0"))
        done, rest = _split(rest, ["_h"], "_h2", limit, STEP)
        parts += [df.select("_key", "_bytes", (F.col("_d") + BITS).alias("_depth"), "_sb", "_sn", F.concat(prefix, _binary("_q", "_d")).alias("_bits"), whole.alias("_over")) for df in done]
        if rest is not None:
            bits = F.concat(prefix, F.lpad(F.bin("_h2"), BITS, F.lit("0")))
            parts.append(_paged(rest, limit).select("_key", "_bytes", F.lit(2 * BITS).alias("_depth"), "_sb", "_sn", bits.alias("_bits"), F.concat(F.lit("."), F.col("_page").cast("string")).alias("_over")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(F.col("_key").alias(key), F.concat(F.lit("s"), "_bits", "_over").alias("shard"), F.col("_depth").cast("int").alias("depth"), F.col("_bytes").alias("n_bytes"), F.col("_sb").alias("shard_bytes"), F.col("_sn").alias("shard_docs"))


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard: its prefix, depth, bytes, documents, and the run of directory slots that point to it.

    The directory has two to the power of the largest depth slots; a shard of less depth owns several in a row. It is
    meant for tables with unique keys, whose depths stay far below ``BITS``.
    """
    shards = assigned.groupBy("shard", "depth").agg(F.max("shard_bytes").alias("shard_bytes"), F.max("shard_docs").alias("shard_docs"))
    deepest = shards.agg(F.max("depth").alias("_g"))
    slots = F.pow(F.lit(2.0), F.col("_g") - F.col("depth")).cast("long")
    bits = F.regexp_extract("shard", "^s([01]{0,60})", 1)
    first = F.coalesce(F.conv(F.when(bits != "", bits), 2, 10).cast("long"), F.lit(0)) * slots
    return shards.join(F.broadcast(deepest)).select("shard", "depth", "shard_bytes", "shard_docs", first.alias("first_slot"), slots.alias("slots"))


def write(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Writes ``docs`` to ``path`` with one folder per shard. Keys must be unique and not null."""
    placed = assign(docs, limit, key, text).select(key, "shard")
    docs.drop("shard").join(placed, key).repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the shard of every document."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
     at_depth AS (SELECT doc_id, n_bytes, k.d::INTEGER AS depth, h >> ({BITS} - k.d)::INTEGER AS p
                  FROM d, (SELECT unnest(generate_series(0, {BITS})) AS d) k),
     sums AS (SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs FROM at_depth GROUP BY depth, p),
     fits AS (SELECT a.doc_id, a.n_bytes, a.depth, a.p, s.shard_bytes, s.shard_docs,
                     row_number() OVER (PARTITION BY a.doc_id ORDER BY a.depth) AS r
              FROM at_depth a JOIN sums s ON a.depth = s.depth AND a.p = s.p
              WHERE s.shard_bytes <= {LIMIT} OR s.shard_docs = 1)
SELECT doc_id, 's' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard, depth, n_bytes, shard_bytes, shard_docs
FROM fits WHERE r = 1
"""
