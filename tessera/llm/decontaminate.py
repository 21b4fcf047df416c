"""Benchmark decontamination with spaced seeds.

A spaced seed is a fixed mask over some tokens that reads only part of them, so a hit survives substituted tokens at
the positions it ignores. ``MASKS`` miss no stretch that counts: n tokens of which s <= n / 5 differ have n - s agreeing
ones in s + 1 runs at most, and one run has four tokens or more whenever n > 4 s + 3. That holds for all n >= 12 but for
s = 3 at n = 15, where four runs of three with single gaps are left: the second mask.

The windows of all benchmark items are hashed under each mask; a document's windows that meet one of these hashes name
an item and an alignment, and the alignment is then compared token by token: the longest stretch around it, of at least
``SPAN`` tokens, in which ``SIMILARITY`` of the tokens agree is the overlap. Where both texts repeat one token, the pairs
of equal windows along an alignment name it once.

Tokens are lower-cased runs of letters and digits, so case, punctuation and line breaks don't hide a passage. Items with
fewer than ``SPAN`` tokens count when all of their tokens occur in a row; items under ``LEAST`` tokens are too short to
tell from ordinary prose and match nothing.

The benchmark is read in blocks of about ``BLOCK_BYTES`` of text. A block goes to every task, without a shuffle. Of
several blocks each has a pass of its own over the numbered documents, which gives numbers and items of those that hold
one; so any size of benchmark works in the memory of one block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import kernels as K
from tessera.llm.frames import anonymous, beside, if_few
from tessera.plans.lineage import cut

SPAN, SIMILARITY, LEAST = 12, 0.8, 5
#: Positions that each mask reads.
MASKS = ("1111", "111011101110111")
BLOCK_BYTES = 8 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[b for b in range(128) if not chr(b).isalnum()]] = True
_FILTER_BITS = 22
#: Pairs of equal windows that are looked at at a time.
_PAIRS = 1 << 19


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = K.words(*K.text_bytes(pc.utf8_lower(texts)), _SEPARATOR)
    return w.hashes(), w.row_start


def _seeds() -> list[tuple[int, tuple[int, ...]]]:
    """(number, positions) of each mask, then of the whole windows that short items need."""
    masks = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]
    return [*enumerate(masks), *((len(masks) + n, tuple(range(n))) for n in range(LEAST, SPAN))]


def _windows(tokens: np.ndarray, first: np.ndarray, number: int, positions: tuple[int, ...]) -> np.ndarray:
    total = np.full(len(first), (number * 0xA24BAED4963EE407) % (1 << 64), np.uint64)
    factor = 0x9FB21C651E98DF25
    for p in positions:
        total = (total ^ tokens[first + p]) * np.uint64(factor)
        factor = (factor * 0xD1B54A32D192ED03) % (1 << 64)
    return total ^ (total >> np.uint64(29))


class Block:
    """A part of the benchmark, ready to be looked up: hashes of its windows and where they stand."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids = ids
        self.tokens, self.row_start = _tokens(texts)
        counts = np.diff(self.row_start)
        self.seeds, hashes, at = [], [], []
        for number, positions in _seeds():
            span = positions[-1] + 1
            first = K.runs(self.row_start, span)
            item = np.searchsorted(self.row_start, first, "right") - 1
            first = first[counts[item] >= SPAN] if number < len(MASKS) else first[counts[item] == span]
            if len(first):
                self.seeds.append((number, positions, span))
                hashes.append(_windows(self.tokens, first, number, positions))
                at.append(first)
        hashes, at = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *at])
        again = np.zeros(len(at), bool)  # the window before, in the same item and of the same mask, is equal
        if len(at):
            item = np.searchsorted(self.row_start, at, "right") - 1
            again[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1] + 1) & (item[1:] == item[:-1])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], at[order]
        first = ~again[order]
        self.first_hashes, self.first_at = self.hashes[first], self.at[first]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, tokens: np.ndarray, row_start: np.ndarray) -> np.ndarray:
        """Distinct (row, item, shift) that some seed names: document token minus shift is the benchmark token."""
        found = [np.zeros((0, 3), np.int64)]
        for number, positions, span in self.seeds:
            first = K.runs(row_start, span)
            h = _windows(tokens, first, number, positions)
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (first[1:] == first[:-1] + 1)
            maybe = self.filter[h >> np.uint64(64 - _FILTER_BITS)]
            # where both windows are equal to those before them, the pair before has named the alignment
            for which, hashes, at in ((maybe & ~again, self.hashes, self.at), (maybe & again, self.first_hashes, self.first_at)):
                doc, wanted = first[which], h[which]
                lo, n = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
                n -= lo
                ends, i = np.cumsum(n), 0
                while i < len(doc):
                    j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + _PAIRS, "right")))
                    m = n[i:j]
                    where = np.repeat(doc[i:j], m)
                    own = at[np.repeat(lo[i:j] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                    row, item = np.searchsorted(row_start, where, "right") - 1, np.searchsorted(self.row_start, own, "right") - 1
                    found.append(np.unique(np.stack([row, item, where - own], axis=1), axis=0))
                    i = j
        return np.unique(np.concatenate(found), axis=0)

    def likely(self, tokens: np.ndarray, row_start: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """The hits whose alignments agree in as many tokens, anywhere, as the shortest stretch that counts needs."""
        row, item, shift = hits.T
        lo = np.maximum(self.row_start[item], row_start[row] - shift)
        n = np.minimum(self.row_start[item + 1], row_start[row + 1] - shift) - lo
        least = np.minimum(SPAN, np.diff(self.row_start)[item])
        keep, ends, i = np.zeros(len(hits), bool), np.cumsum(n), 0
        while i < len(hits):  # about a million compared tokens at a time
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + (1 << 20), "right")))
            first = np.cumsum(n[i:j]) - n[i:j]
            own = np.arange(n[i:j].sum()) + np.repeat(lo[i:j] - first, n[i:j])
            same = self.tokens[own] == tokens[own + np.repeat(shift[i:j], n[i:j])]
            keep[i:j] = np.add.reduceat(same.astype(np.int64), first) >= SIMILARITY * least[i:j]
            i = j
        return hits[keep]

    def overlap(self, tokens: np.ndarray, row_start: np.ndarray, row: int, item: int, shift: int) -> int:
        """Tokens of the longest stretch of this alignment that starts and ends with agreeing tokens and agrees in
        ``SIMILARITY`` of them; 0 if it is too short."""
        lo = max(self.row_start[item], row_start[row] - shift)
        hi = min(self.row_start[item + 1], row_start[row + 1] - shift)
        same = self.tokens[lo:hi] == tokens[lo + shift : hi + shift]
        least = min(SPAN, int(self.row_start[item + 1] - self.row_start[item]))
        at = np.flatnonzero(same)
        if len(at) < SIMILARITY * least:
            return 0
        # stretch i..j agrees enough if j's excess of agreement is no less than i's before it
        excess = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - SIMILARITY, -SIMILARITY))))
        begin, end = excess[at], excess[at + 1]
        lowest, highest = np.minimum.accumulate(begin), np.maximum.accumulate(end[::-1])[::-1]
        best, i, j = 0, 0, 0
        while i < len(at) and j < len(at):  # the longest pair of a start on the way down and an end as high
            if highest[j] >= lowest[i] - 1e-9:
                best = max(best, int(at[j] - at[i] + 1))
                j += 1
            else:
                i += 1
        return best if best >= least else 0

    def found(self, texts: pa.Array) -> list[list[tuple]]:
        """(item, overlap) of each text, at most one per item."""
        tokens, row_start = _tokens(texts)
        out: list[dict] = [{} for _ in range(len(texts))]
        for row, item, shift in self.likely(tokens, row_start, self.hits(tokens, row_start)).tolist():
            if n := self.overlap(tokens, row_start, row, item, shift):
                key = self.ids[item]
                out[row][key] = max(n, out[row].get(key, 0))
        return [sorted(x.items()) for x in out]


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark's parts, one after the other. Items without a key or text match nothing."""
    items = benchmark.select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropna()
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = -(-total // most)
    for part in range(parts):
        chosen = items if parts == 1 else items.filter(F.pmod(F.xxhash64("_key", "_text"), F.lit(parts)) == part)
        table = chosen.toArrow().sort_by([("_key", "ascending"), ("_text", "ascending")])
        if table.num_rows:
            yield Block(table["_key"].to_pylist(), table["_text"].combine_chunks())


def _found(docs: DataFrame, block: Block, kind: T.DataType) -> DataFrame:
    """``docs``, whose last column is ``_text``, with ``_items`` and ``_overlap`` in its place."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    keep, arrow = docs.columns[:-1], pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, "_text"):
            found = shared.value.found(batch.column(len(keep)))
            items = pa.array([[i for i, _ in f] for f in found], arrow)
            longest = pa.array([max((n for _, n in f), default=0) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], items, longest], names=[*keep, "_items", "_overlap"])

    return docs.mapInArrow(run, docs.select(*keep).schema.add("_items", T.ArrayType(kind)).add("_overlap", "long"))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", most: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``_items`` (ids of the benchmark items found, ascending, of whatever type they are) and ``_overlap``
    (tokens of the longest overlap, 0 if none).

    Null and empty texts, and an empty benchmark, have no items. An item found in several places counts once, as do items
    that share an id. Rows that repeat have the same items. Input columns of the added names go on with an underscore
    more."""
    K.bound_batches(docs.sparkSession)
    docs = beside(docs, "_items", "_overlap")
    plain, of, _ = anonymous(docs)
    kind, text = benchmark.schema[item].dataType, of[text]
    parts = blocks(benchmark, item, most=most)
    first, second = next(parts, None), next(parts, None)
    added = [F.col("_items"), F.col("_overlap")]
    shown = [F.col(c).alias(name) for name, c in of.items()]
    if first is None:
        return plain.select(*shown, F.array().cast(T.ArrayType(kind)).alias("_items"), F.lit(0).cast("long").alias("_overlap"))
    if second is None:
        return _found(plain.withColumn("_text", F.col(text)), first, kind).select(*shown, *added)
    numbered = cut(plain.withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for block in itertools.chain((first, second), parts):
        hit = cut(_found(numbered.select("_row", F.col(text).alias("_text")), block, kind).filter(F.size("_items") > 0))
        found = hit if found is None else found.unionAll(hit)
    found = found.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"), F.max("_overlap").alias("_overlap"))
    met = numbered.join(if_few(cut(found)), "_row", "left")
    return met.select(*shown, F.coalesce("_items", F.array().cast(T.ArrayType(kind))).alias("_items"), F.coalesce("_overlap", F.lit(0)).cast("long").alias("_overlap"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; columns stay as they are. Null and empty texts stay."""
    plain, of, back = anonymous(docs)
    return back(scan(plain, benchmark, of[text]).filter(F.size("_items") == 0))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: benchmark items in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_items").alias("items"), F.size("_items").alias("n_items"), F.col("_overlap").alias("overlap_tokens"))
