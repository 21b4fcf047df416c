"""Near duplicates by SimHash, searched with covering locality-sensitive hashing.

``fingerprints`` gives every text its 64-bit SimHash. ``link`` finds all fingerprints within ``radius`` differing bits:
each bit position gets a vector of ``radius + 1`` random bits, and for each of the ``2**(radius+1) - 1`` non-zero vectors
v the table of v hashes the positions whose vector is not orthogonal to v. For any ``radius`` positions there is a v
orthogonal to all of their vectors, so a pair that differs only there agrees on that whole mask: every pair within the
radius meets in some table, with no chance involved. Two fingerprints that meet are compared in full.

Copies cost one row: only distinct fingerprints are hashed. A table's bucket isn't expanded into its pairs either; it
gives the edges of a spanning forest of its links, which keeps all components. A bucket over ``BLOCK`` fingerprints is
split into blocks, and each pair of blocks is a unit of work of its own, so the result stays exact at any bucket size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import anonymous, dealt_anew, keeping, place
from tessera.plans.lineage import cut

SHINGLE, RADIUS, BITS, SEED = 4, 4, 64, 42
#: Fingerprints of a bucket that one unit of work holds at most, twice.
BLOCK = 2048

_SPREAD = np.array([sum(((i >> b) & 1) << (8 * b) for b in range(8)) for i in range(256)], np.uint64)


def _majority(hashes: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """For each row, the bits that are set in over half of its hashes.

    A byte of a hash is spread over eight 8-bit lanes, so one addition counts eight bits; lanes are emptied after 255.
    """
    counts = np.diff(row_start)
    pieces = -(-counts // 255)
    piece_row = np.repeat(np.arange(len(counts)), pieces)
    first = np.cumsum(pieces) - pieces
    begin = row_start[piece_row] + 255 * (np.arange(len(piece_row)) - first[piece_row])
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    for byte, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):  # little-endian: byte 0 holds bits 0 to 7
        lanes = np.add.reduceat(_SPREAD[column], begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(lanes, first[full], axis=0)
        bits = (2 * ones > counts[full, None]).astype(np.uint64)
        for b in range(8):
            out[full] |= bits[:, b] << np.uint64(8 * byte + b)
    return out


def simhash(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text's lower-cased word shingles, repeats included; a shorter text is one shingle; none: 0."""
    raw, offsets = K.text_bytes(texts)
    w = K.joined(K.words(K.LOWER[raw], offsets))
    width = np.minimum(w.counts, shingle)
    n = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    row_start = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(n)), n)
    first = w.row_start[row] + np.arange(len(row)) - row_start[row]
    begin, end = w.start[first], w.end[first + width[row] - 1]
    view, digest = memoryview(np.ascontiguousarray(w.buf)), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(row))
    return _majority(h, row_start)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The other columns that ``docs`` has, without the text, and ``_fp`` (the fingerprint as a signed long).

    A null or empty text has fingerprint 0. Needs one pass and no shuffle.
    """
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, text):
            fp = simhash(batch.column(len(keep)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*keep, "_fp"])

    K.bound_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("_fp", "long")
    return docs.select(*keep, text).mapInArrow(run, schema)


def masks(radius: int = RADIUS, bits: int = BITS, seed: int = SEED) -> list[int]:
    """The bit masks of a covering family: for any ``radius`` positions, some mask has none of them.

    Each position draws a non-zero vector; vectors are dealt in shuffled rounds, so that masks have like sizes.
    """
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.permutation(np.arange(1, 1 << (radius + 1))) for _ in range(-(-bits // ((1 << (radius + 1)) - 1)))])
    vector = [int(x) for x in values[:bits]]
    return [sum(1 << i for i, m in enumerate(vector) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that joins points within ``radius`` differing bits."""
    left, new = [], []
    rest = points
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for p in (reached := queue.pop()):
                near = np.bitwise_count(rest ^ p) <= radius
                if near.any():
                    found, rest = rest[near], rest[~near]
                    left.append(np.full(len(found), p))
                    new.append(found)
                    queue.append(found)
                    if not len(rest):
                        break
            del reached
    empty = np.zeros(0, points.dtype)
    return np.concatenate([empty, *left]), np.concatenate([empty, *new])


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(groups: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
            cuts = np.concatenate(([0], np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1, [len(points)]))
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            a, b = points[two], points[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            left, right = [a[near]], [b[near]]
            for i in np.flatnonzero(size > 2):
                x, y = forest(points[cuts[i] : cuts[i + 1]], radius)
                left.append(x)
                right.append(y)
            left, right = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(left, right)), pa.array(np.minimum(left, right))], names=["_u", "_v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            g = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            held.append((g, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)))
            size += len(g)
            if size >= 65536:  # whole groups go on their way, the last one may not be whole yet
                g, p = (np.concatenate(x) for x in zip(*held, strict=True))
                done = np.flatnonzero((g != g[-1]).any(axis=1))
                last = done[-1] + 1 if len(done) else 0
                held, size = [(g[last:], p[last:])], len(p) - last
                if last:
                    yield emit(g[:last], p[:last])
        if size:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def link(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges ``(_u, _v)``, _u > _v, that join all distinct ``_fp`` within ``radius`` bits into the right components."""
    table = F.array(*[F.struct(F.lit(i).cast("short").alias("t"), F.col("_fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks(radius))])
    rows = distinct.select("_fp", F.explode(table).alias("_b")).select("_fp", F.col("_b.t").alias("_t"), F.col("_b.k").alias("_k"))
    crowded = rows.groupBy("_t", "_k").agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    met = rows.join(crowded, ["_t", "_k"]).select("_t", "_k", "_fp", blocks.alias("_g"))
    own = F.pmod(F.xxhash64("_fp"), F.col("_g")).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda o: F.least(o, own) * F.col("_g") + F.greatest(o, own))
    units = met.select("_t", "_k", F.explode(other).alias("_p"), "_fp")
    spread = units.repartition("_t", "_k", "_p").sortWithinPartitions("_t", "_k", "_p")
    return spread.mapInArrow(_forests(radius), "_u long, _v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(_u, _v)``: for every node of ``edges`` but the smallest of a component, that smallest node.

    Large-star and small-star steps in turn: each is a minimum per node and a join, so that no node's neighbours are
    ever gathered in one place. Each round's edges are cut to the checkpoint folder; rounds end when edges stay the same.
    """
    edges = cut(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
        large = both.filter("_v > _u").join(dealt_anew(least, "_u"), "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct()
        large = cut(large)
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        down = large.join(dealt_anew(least, "_u"), "_u").filter("_v <> _m").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        edges = cut(down.unionByName(least.select("_u", F.col("_m").alias("_v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges
        before = now


def names(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``_fp`` and ``_name`` of all ``distinct`` rows (``_fp``, ``_least``): the least ``_least`` of each component."""
    stars = components(edges)
    rooted = cut(distinct.join(stars, distinct["_fp"] == stars["_u"], "left").select("_fp", "_least", F.coalesce("_v", "_fp").alias("_root")))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("_name"))
    return rooted.join(dealt_anew(least, "_root"), "_root").select("_fp", "_name")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``key``, ``_fp`` and ``_component`` (the smallest key reachable over links) of every row of ``docs``.

    Links: fingerprints that differ in ``radius`` bits or fewer. Null and empty texts have fingerprint 0 and link like
    any other. Repeated rows stay repeated. Null keys count as larger than all others; a component that has only null
    keys has a null name.
    """
    fp = cut(fingerprints(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", shingle))
    distinct = cut(fp.groupBy("_fp").agg(F.min("_key").alias("_least")))
    of = names(distinct, link(distinct.select("_fp"), radius)).withColumnRenamed("_name", "_component")
    return fp.join(dealt_anew(of, "_fp"), "_fp").select(F.col("_key").alias(key), "_fp", "_component")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns as they were: that of the smallest key (null
    keys last), of several with it that of the smallest hash of the text, and of several of that the one with the smallest
    hash of all columns.

    Texts without words, null ones too, are duplicates of each other. Rows that repeat all columns are one, and rows that
    share a key only are told apart.
    """
    plain, of, back = anonymous(docs)
    key, text = of[key], of[text]
    named = plain.withColumns({"_key": F.col(key), "_id": F.xxhash64(F.col(text))})
    rows = cut(fingerprints(named.select("_key", "_id", F.col(text).alias("_text")), "_text", shingle))
    distinct = cut(rows.groupBy("_fp").agg(F.min(place()).alias("_least")))
    stay = names(distinct, link(distinct.select("_fp"), radius)).withColumnRenamed("_name", "_stay")
    return back(keeping(named, rows, stay))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = groups(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_component").alias("component_id"))
