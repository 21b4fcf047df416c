"""Removal of repeated passages by content-defined chunks of lines.

Lines are hashed, and a rolling hash over ``WINDOW`` neighbouring line hashes decides after which lines a chunk ends: a
boundary depends on these lines alone, so a passage is cut alike wherever it stands and whatever precedes it. Only where
none falls among ``MOST`` lines is a chunk cut by their number. A chunk of several lines that occurs in more than one place stays where it comes first, by key and then by line, and goes elsewhere, after
its bytes were compared with those of the place that stays.

A passage between differing neighbours shares its edges' chunks with them, and a short one holds no chunk of its own. So
``whole`` makes every pair of neighbouring lines, and every line of over ``LONG`` words, a unit beside the chunks: they
extend a repeated chunk line by line to the passage's edges and find passages that hold no chunk. Every line that goes
still stands where the order by key and line has it first; a unit that overlaps its own first place stays.

Only hashes and places of chunks are shuffled by hash. Texts of chunks move for those whose hash may repeat: a bit table
of fixed size picks them in a second pass. Every occurrence is compared with one representative by a join on the hash,
so no group is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import FEW, anonymous, beside, same_row
from tessera.plans.lineage import cut

WINDOW, MOST = 2, 64
#: One line in so many ends a chunk.
EVERY = 4
#: A line of more words is a passage by itself.
LONG = 50
_TABLE_BITS = 25


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of all lines in order; an empty text is one empty line."""
    rows = len(offsets) - 1
    newline = np.flatnonzero(raw == 0x0A)
    per = np.bincount(np.searchsorted(offsets, newline, "right") - 1, minlength=rows) + 1
    row = np.repeat(np.arange(rows), per)
    first = np.cumsum(per) - per
    start, end = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    start[first] = offsets[:-1]
    end[first + per - 1] = offsets[1:]
    inner = np.ones(len(row), bool)
    inner[first] = False
    start[inner] = newline + 1
    inner = np.ones(len(row), bool)
    inner[first + per - 1] = False
    end[inner] = newline
    return start, end, row


def chunks(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, first line, lines, start byte, end byte, hash) of all chunks, in order, over the batch's text bytes."""
    raw, offsets = K.text_bytes(texts)
    start, end, row = _lines(raw, offsets)
    h = K.slice_hashes(raw, start, end)
    roll = h.copy()
    for i in range(1, WINDOW):
        roll[i:] += K.mix64(h[:-i] + np.uint64(i))  # a window that reaches into the text before is no boundary below
    candidate = (K.mix64(roll) >> np.uint64(32)) % np.uint64(EVERY) == 0
    line_start = np.searchsorted(row, np.arange(len(offsets)))
    number = np.arange(len(row)) - line_start[row]
    candidate &= number >= WINDOW - 1
    begins = []
    for a, b in zip(line_start[:-1].tolist(), line_start[1:].tolist(), strict=True):
        at = a
        for c in [*(np.flatnonzero(candidate[a:b]) + a + 1).tolist(), b]:
            while c - at > MOST:
                begins.append(at)
                at += MOST
            if c > at:
                begins.append(at)
                at = c
    begin = np.array(begins, np.int64)
    stop = np.append(begin[1:], len(row))
    first, last = start[begin], end[stop - 1]
    return row[begin], number[begin], stop - begin, first, last, K.slice_hashes(raw, first, last)


def _units(texts: pa.Array, whole: bool) -> tuple[np.ndarray, ...]:
    """Like ``chunks``, what can be taken out: chunks of several lines; with ``whole`` also long lines, and the pairs of
    neighbouring lines that aren't chunks themselves. Nothing but newlines is no passage."""
    found = chunks(texts)
    many = found[2] >= 2
    parts = [tuple(x[many] for x in found)]
    if whole:
        raw, offsets = K.text_bytes(texts)
        start, end, row = _lines(raw, offsets)
        number = np.arange(len(row)) - np.searchsorted(row, row)
        words = K.words(raw, offsets).start
        long = np.flatnonzero(np.searchsorted(words, end) - np.searchsorted(words, start) > LONG)
        line = np.searchsorted(row, found[0]) + found[1]
        pair = np.setdiff1d(np.flatnonzero(row[1:] == row[:-1]), line[found[2] == 2], assume_unique=True)
        for at, lines in ((long, 1), (pair, 2)):
            first, last = start[at], end[at + lines - 1]
            parts.append((row[at], number[at], np.full(len(at), lines), first, last, K.slice_hashes(raw, first, last)))
    units = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    full = units[4] - units[3] >= units[2]
    return tuple(x[full] for x in units)


def _table(seen: DataFrame) -> np.ndarray:
    """A bit table of the hashes that occur more than once, eight to a byte."""
    bits = np.zeros(1 << _TABLE_BITS, bool)
    slot = F.shiftrightunsigned("_hash", 64 - _TABLE_BITS).cast("int")
    bits[seen.select(slot.alias("_slot")).distinct().toArrow()["_slot"].to_numpy()] = True  # at most as many as the table has
    return np.packbits(bits, bitorder="little")


def _listed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - _TABLE_BITS)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """``_key, _id`` (hash of key and text), ``_first, _lines``: the units to remove."""
    spark = docs.sparkSession
    K.bound_batches(spark)
    picked = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), F.col(text)).alias("_id"), F.col(text).alias("_text"))
    place = ["_first", "_lines", "_hash"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, "_text"):
            row, first, lines, _, _, h = _units(batch.column(2), whole)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(lines.astype(np.int32)), pa.array(h.view(np.int64))], names=["_key", "_id", *place])

    schema = picked.select("_key", "_id").schema.add("_first", "integer").add("_lines", "integer").add("_hash", "long")
    found = picked.mapInArrow(hashed, schema)
    where = F.struct(F.col("_key").isNull().alias("z"), F.col("_key").alias("k"), F.col("_id").alias("i"), F.col("_first").alias("f"))
    twice = cut(found.groupBy("_hash").agg(F.count("*").alias("_n"), F.min(where).alias("_at")).filter("_n > 1").select("_hash", "_at"))
    shared = spark.sparkContext.broadcast(_table(twice))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in K.batches_of(batches, "_text"):
            raw, _ = K.text_bytes(batch.column(2))
            row, first, lines, a, b, h = _units(batch.column(2), whole)
            many = _listed(bits, h)
            text = pa.array([raw[x:y].tobytes() for x, y in zip(a[many], b[many], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[many])), batch.column(1).take(pa.array(row[many])), pa.array(first[many].astype(np.int32)), pa.array(lines[many].astype(np.int32)), pa.array(h[many].view(np.int64)), text], names=["_key", "_id", *place, "_bytes"])

    texts = picked.mapInArrow(cut_out, schema.add("_bytes", "binary"))
    same = F.col("_key").eqNullSafe(F.col("_at.k")) & (F.col("_id") == F.col("_at.i"))
    met = texts.join(twice, "_hash").filter(~(same & (F.col("_first") > F.col("_at.f")) & (F.col("_first") < F.col("_at.f") + F.col("_lines"))))
    met = cut(met.withColumn("_stays", where.eqNullSafe(F.col("_at"))).drop("_at"))
    stays = met.filter("_stays").select("_hash", F.col("_bytes").alias("_kept")).groupBy("_hash").agg(F.min("_kept").alias("_kept"))
    return met.filter("NOT _stays").join(stays, "_hash").filter("_bytes = _kept").select("_key", "_id", "_first", "_lines")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and ``_lines`` and ``_removed`` (lines before; taken out).

    Null texts stay null and have no lines; an empty one has one, and texts without repeats stay byte for byte. A text
    that loses all lines becomes empty. Rows that repeat a key and text are one document: they lose the same lines. Of
    places of one key the first line stays, null keys come last. Input columns of the added names go on with an underscore
    more. ``whole`` takes out repeated passages up to their edges, not only the chunks that lie in them.
    """
    lost = repeated(docs, key, text, whole).select("_key", "_id", F.explode(F.sequence("_first", F.col("_first") + F.col("_lines") - 1)).alias("_line")).distinct()
    runs = lost.withColumn("_run", F.col("_line") - F.row_number().over(Window.partitionBy("_key", "_id").orderBy("_line")))
    runs = runs.groupBy("_key", "_id", "_run").agg(F.min("_line").alias("_first"), F.count("*").cast("int").alias("_lines"))
    gone = cut(runs.groupBy("_key", "_id").agg(F.collect_list(F.struct("_first", "_lines")).alias("_gone")))
    if (gone.agg(F.sum(F.size("_gone"))).first()[0] or 0) <= FEW:
        gone = F.broadcast(gone)
    docs = beside(docs, "_lines", "_removed")
    plain, of, _ = anonymous(docs)
    key, text = of[key], of[text]
    keyed = plain.withColumns({"_key": F.col(key), "_id": F.xxhash64(F.col(key), F.col(text))})
    joined = keyed.join(gone, same_row(keyed, gone), "left")
    lines = F.split(F.col(text), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.exists("_gone", lambda g: (i >= g["_first"]) & (i < g["_first"] + g["_lines"])))
    removed = F.coalesce(F.aggregate("_gone", F.lit(0), lambda n, g: n + g["_lines"]), F.lit(0)).cast("long")
    out = joined.withColumns({"_all": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "_removed": removed, "_left": F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))})
    columns = [(F.col("_left") if c == text else F.col(c)).alias(name) for name, c in of.items()]
    return out.select(*columns, F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("_all")).cast("long").alias("_lines"), "_removed")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: lines before, lines taken out, and the text that is left of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_repeats(docs, whole=True)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
