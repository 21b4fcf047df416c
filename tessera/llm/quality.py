"""Quality by a hashed n-gram likelihood ratio between trusted documents and the raw corpus.

Two multinomials over hashed n-grams of ``ORDER`` bytes are counted: one over trusted documents, one over all documents.
A text's score is the sum of its n-grams' log-likelihood ratios divided by their number. Every document is held against
the same threshold; nothing is drawn by lot. The threshold lies below nearly all trusted documents: as far under their
``LOW`` quantile as ``WIDTH`` times the way from there to their median. Beside that, plain counts of words, symbols and repetitions set apart texts that are too short or repeat themselves.

Trusted documents are all those that a labels table marks; counts, threshold and verdicts cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import FEW, beside, if_few
from tessera.operators.aggregates import quantiles
from tessera.plans.lineage import cut

ORDER, SLOT_BITS = 4, 17
LOW, WIDTH = 0.01, 1.5
#: Counts are smoothed by this many n-grams of the raw corpus.
PRIOR = 20_000.0
LEAST_WORDS, MOST_REPEATED = 50, 0.5

_SLOTS = 1 << SLOT_BITS
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CHUNK = 1 << 20


def _grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of all n-grams, some at a time; a shorter text has none."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = raw.astype(np.uint32)
    first = K.runs(offsets, ORDER)
    for lo in range(0, len(first), _CHUNK):
        at = first[lo : lo + _CHUNK]
        gram = wide[at]
        for i in range(1, ORDER):
            gram = gram << np.uint32(8) | wide[at + i]
        slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
        yield rows[at], slot.astype(np.int64)


def trusted(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``_key`` of all documents that ``labels`` marks as good and never as bad, each once."""
    marked = labels.select(F.col(key).alias("_key"), F.col(label).alias("_good")).dropna().groupBy("_key").agg(F.min("_good").alias("_good"))
    return marked.filter("_good > 0").select("_key")


def ratios(docs: DataFrame, good: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each slot: trusted over raw. All 0 if no document is trusted.

    ``good`` (``_key``, each once) goes to every task if it says so; else texts are shuffled once to meet it."""
    flagged = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(good.withColumn("_in", F.lit(1)), "_key", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, _SLOTS), np.int64)
        for batch in K.batches_of(batches, "_text"):
            of = batch.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = K.text_bytes(batch.column(0))
            for row, slot in _grams(raw, offsets):
                seen[0] += np.bincount(slot, minlength=_SLOTS)
                if (hit := of[row] > 0).any():
                    seen[1] += np.bincount(slot[hit], minlength=_SLOTS)
        at = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["_slot", "_raw", "_good"])

    K.bound_batches(docs.sparkSession)
    counted = flagged.select("_text", F.coalesce("_in", F.lit(0)).alias("_in")).mapInArrow(count, "_slot int, _raw long, _good long")
    table = counted.groupBy("_slot").agg(F.sum("_raw").alias("_raw"), F.sum("_good").alias("_good")).toPandas()
    seen = np.zeros((2, _SLOTS))
    seen[:, table["_slot"]] = table[["_raw", "_good"]].to_numpy().T
    if not seen[1].sum():
        return np.zeros(_SLOTS, np.float32)
    raw = (seen[0] + 1) / (seen[0] + 1).sum()
    good = (seen[1] + PRIOR * raw) / (seen[1].sum() + PRIOR)
    return np.log(good / raw).astype(np.float32)


def _repeats(hashes: np.ndarray, w: K.Words) -> np.ndarray:
    """For each row, its words that lie in a window of three words found twice or more in it."""
    first = K.runs(w.row_start, 3)
    if not len(first):
        return np.zeros(len(w.row_start) - 1, np.int64)
    key = hashes[first] * K.U64(3) + K.mix64(hashes[first + 1] + K.U64(0x51ED27)) + K.mix64(hashes[first + 2] * K.U64(5) + w.row[first].astype(K.U64))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(first), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[first[again] + i] = True
    return np.bincount(w.row[covered], minlength=len(w.row_start) - 1)


def _repeated_lines(raw: np.ndarray, offsets: np.ndarray, w: K.Words) -> np.ndarray:
    """For each row, its lines that hold a word and equal an earlier one."""
    rows = len(offsets) - 1
    ends = np.flatnonzero(raw == 0x0A)
    start = np.union1d(offsets[:-1], ends + 1)
    row = np.searchsorted(offsets, start, "right") - 1
    start, row = start[row < rows], row[row < rows]
    newline = np.append(ends, len(raw))[np.searchsorted(ends, start)]
    end = np.minimum(newline, offsets[row + 1])
    holds = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[holds], end[holds], row[holds]
    key = K.slice_hashes(raw, start, end) + K.mix64(row.astype(K.U64) + K.U64(1))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)


def features(texts: pa.Array, odds: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and length-normalised score of each text; texts without an n-gram score 0."""
    raw, offsets = K.text_bytes(texts)
    w = K.words(raw, offsets)
    rows = len(texts)
    byte_row = np.repeat(np.arange(rows), np.diff(offsets))
    points = (raw & 0xC0) != 0x80
    in_word = points & ~K.SEPARATOR[raw]
    total, n = np.zeros(rows), np.zeros(rows)
    for row, slot in _grams(raw, offsets):
        total += np.bincount(row, odds[slot], rows)
        n += np.bincount(row, minlength=rows)
    return {
        "n_words": w.counts,
        "word_chars": np.bincount(byte_row[in_word], minlength=rows),
        "n_symbols": np.bincount(byte_row[_SYMBOL[raw]], minlength=rows),
        "n_dup_lines": _repeated_lines(raw, offsets, w),
        "n_repeat_words": _repeats(w.hashes(), w),
        "score": total / np.maximum(n, 1),
    }


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``docs`` without its text and with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long), ``score``, ``base_failed`` and ``kept``.

    Null texts count as empty: they have no words and fail. Without trusted documents only the plain counts decide. Rows
    that repeat are judged alike; a score equal to the threshold is kept. Input columns of the added names go on with an
    underscore more.

    Texts are read twice: for counts, and for scores, which are cut, so that the threshold is found from the scores of all
    trusted documents.
    """
    spark = docs.sparkSession
    docs = beside(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")
    good = if_few(cut(trusted(labels, key, label)))
    odds = ratios(docs, good, key, text)
    shared = spark.sparkContext.broadcast(odds)
    keep = [c for c in docs.columns if c != text]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, text):
            f = features(batch.column(batch.num_columns - 1), shared.value)
            columns = [*(pa.array(f[c].astype(np.int64)) for c in counts), pa.array(f["score"])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *counts, "score"])

    schema = docs.select(*keep).schema
    for c in counts:
        schema = schema.add(c, "long")
    scored = cut(docs.select(*keep, text).mapInArrow(run, schema.add("score", "double")))
    marked = cut(scored.select(F.col(key).alias("_key"), "score").join(good, "_key").select("score"))
    at = quantiles(marked, [], "score", {"low": LOW, "median": 0.5}, FEW).first()
    least = float("-inf") if at is None or at.low is None else at.low - WIDTH * (at.median - at.low)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
