"""Near copies by the exact Jaccard similarity of word shingles, as the corpus pipeline removes them.

Two texts are near copies if their sets of ``SHINGLE``-word shingles have a similarity of ``SIMILARITY`` or more. Their
fingerprints differ in too many bits for a covering search (2**(radius+1) - 1 masks), so candidates come from MinHash:
``BANDS`` keys of ``ROWS`` minima each, of which a pair of similarity s shares one with probability 1 - (1 - s**ROWS)**BANDS:
0.9998 at 0.8, more above. Every candidate is then decided by its whole sets, so no text goes that is less alike.

Texts of the same words are one node. Sets move for nodes that share a key with another one, and a bucket of nodes gives
the edges of a spanning forest of its near copies; one over ``BLOCK`` nodes or ``ROOM`` shingles is split into pairs of
blocks, so that neither many nor very long texts fill a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tessera.llm import kernels as K
from tessera.llm.frames import anonymous, if_few, keeping, place, same_row
from tessera.llm.simhash import names
from tessera.plans.lineage import cut

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 30, 6, 42
#: Nodes of a bucket that one unit of work holds at most, twice.
BLOCK = 2048
#: Shingles of a bucket that one unit of work holds, about, twice: nodes are dealt by a hash, and a longer text isn't cut.
ROOM = 1 << 22


def _shingles(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's distinct lower-cased shingles, ascending, their row starts, and a hash of all its words.

    A text of fewer words is one shingle; one without words has none and hash 0."""
    raw, offsets = K.text_bytes(texts)
    w = K.joined(K.words(K.LOWER[raw], offsets))
    n = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    first = w.row_start[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    h = K.slice_hashes(w.buf, w.start[first], w.end[first + np.minimum(w.counts, shingle)[row] - 1])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    all_words = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    all_words[some] = K.slice_hashes(w.buf, w.start[w.row_start[some]], w.end[w.row_start[some + 1] - 1])
    return h[new], np.searchsorted(row[new], np.arange(len(n) + 1)), all_words


def _keys(hashes: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of every row that has shingles."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
    begin = row_start[:-1][np.diff(row_start) > 0]
    keys = np.zeros((len(begin), BANDS), np.uint64)
    for i, factor in enumerate(factors if len(begin) else []):
        band = i // ROWS
        keys[:, band] = K.mix64(keys[:, band] ^ np.minimum.reduceat(hashes * factor, begin)) + np.uint64(band)
    return keys


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that joins sets (ascending, not empty) of ``similarity`` or more."""
    edges, size = [], np.array([len(s) for s in sets])
    rest = np.arange(len(sets))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            alike = rest[np.minimum(size[rest], size[p]) >= similarity * np.maximum(size[rest], size[p]) - 1e-9]
            if not len(alike):
                continue
            flat = np.concatenate([sets[i] for i in alike])
            at = np.minimum(np.searchsorted(sets[p], flat), size[p] - 1)
            both = np.add.reduceat((sets[p][at] == flat).astype(np.int64), np.cumsum(size[alike]) - size[alike])
            near = alike[both >= similarity * (size[alike] + size[p] - both) - 1e-9]
            edges += [(p, i) for i in near.tolist()]
            queue += near.tolist()
            rest = np.setdiff1d(rest, near, assume_unique=True)
    return edges


def _forests(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, sets = None, [], []

        def emit() -> pa.RecordBatch:
            pairs = [(nodes[a], nodes[b]) for a, b in forest(sets, similarity)]
            return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], names=["_u", "_v"])

        for batch in batches:
            for k, p, fp, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != (k, p):
                    if len(nodes) > 1:
                        yield emit()
                    unit, nodes, sets = (k, p), [], []
                nodes.append(fp)
                sets.append(np.frombuffer(shingles, np.uint64))
        if len(nodes) > 1:
            yield emit()

    return run


def link(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK, room: int = ROOM) -> DataFrame:
    """Edges ``(_u, _v)``, _u > _v, that join near copies among ``nodes`` (``_fp``, ``_key`` and ``_id`` of a row of ``docs``
    with these words, ``_keys``, and ``_size``, its distinct shingles) into the right components. ``docs`` has ``_key``,
    ``_id`` and ``_text``."""
    rows = nodes.select("_fp", "_size", F.explode("_keys").alias("_k"))
    crowded = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.sum("_size").alias("_m")).filter("_n > 1")
    blocks = F.least(F.col("_n"), F.ceil(F.greatest(F.col("_n") / block, F.col("_m") / room))).cast("int")
    met = cut(rows.join(crowded, "_k").select("_k", "_fp", blocks.alias("_g")))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, "_text"):
            h, row_start, _ = _shingles(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(row_start[:-1], row_start[1:], strict=True)], pa.binary())], names=["_fp", "_set"])

    wanted = if_few(cut(nodes.join(met.select("_fp").distinct(), "_fp", "left_semi").select("_fp", "_key", "_id")))
    texts = docs.join(wanted, same_row(docs, wanted)).select("_fp", "_text")
    sets = texts.mapInArrow(take, "_fp long, _set binary").dropDuplicates(["_fp"])
    own = F.pmod(F.xxhash64("_fp"), F.col("_g")).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda o: F.least(o, own) * F.col("_g") + F.greatest(o, own))
    units = met.join(sets, "_fp").select("_k", F.explode(other).alias("_p"), "_fp", "_set")
    spread = units.repartition("_k", "_p").sortWithinPartitions("_k", "_p")
    return spread.mapInArrow(K.lean(_forests(similarity)), "_u long, _v long").distinct()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK, room: int = ROOM) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they were: that of the smallest key (null keys
    last), of several with it that of the smallest hash of the text, and of several of that the one with the smallest hash
    of all columns.

    Groups are connected by pairs of ``similarity`` or more. Texts without words, null ones too, are copies of each other.
    Rows that repeat all columns are one, and rows that share a key only are told apart.
    """
    K.bound_batches(docs.sparkSession)
    plain, of, back = anonymous(docs)
    key, text = of[key], of[text]
    named = plain.withColumns({"_key": F.col(key), "_id": F.xxhash64(F.col(text))})
    picked = named.select("_key", "_id", F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, "_text"):
            h, row_start, words = _shingles(batch.column(2), shingle)
            keys = _keys(h, row_start).view(np.int64)
            size = np.diff(row_start)
            each = np.where(size > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.view(np.int64)), pa.array(size.astype(np.int64)), lists], names=["_key", "_id", "_fp", "_size", "_keys"])

    schema = picked.select("_key", "_id").schema.add("_fp", "long").add("_size", "long").add("_keys", ArrayType(LongType()))
    hashed = cut(picked.mapInArrow(K.lean(run), schema))
    nodes = cut(hashed.groupBy("_fp").agg(F.min(place()).alias("_least"), F.max("_size").alias("_size"), F.first("_keys").alias("_keys")))
    edges = link(picked, nodes.select("_fp", F.col("_least.k").alias("_key"), F.col("_least.i").alias("_id"), "_size", "_keys"), similarity, shingle, block, room)
    stay = names(nodes.select("_fp", "_least"), edges).withColumnRenamed("_name", "_stay")
    return back(keeping(named, hashed.select("_key", "_id", "_fp"), stay))
