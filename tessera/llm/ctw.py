"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each told apart by the bits before it; a decision's context is the last 0 to ``DEPTH``
bytes. Every context keeps a Krichevsky-Trofimov estimate of its decision, and a node of the tree mixes its own estimate
with that of its longer contexts. The mixing weights are those of context-tree weighting after the training text: half
the block probability of the node's own estimator over the weighted probability of the node. The product over all bytes
of a text and an end mark gives its probability; its negative logarithm per byte is the code length.

The tree has all contexts of the training text and grows with it. It is cut by the last ``GROUP`` bytes of the context:
below that each part is weighted in a task of its own. Only the nodes of ``GROUP`` bytes meet on the driver, to be mixed
with the shorter contexts; there are as many as the alphabet makes, not the corpus. A second pass over the parts then
gives every event (a byte after its ``DEPTH`` bytes) that a text has, seen in training or not, its probability.

Events with a share of 1 / ``OFTEN`` or more of the training go to every task, as do words with a share of 1 / ``HEAD``:
no more than ``OFTEN`` and ``HEAD`` can have it. All others meet their probabilities and counts in a join, one row for
each that is distinct in a text. The word model beside the tree is made of add-one estimates over all training words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.split import held_out
from tessera.plans.lineage import cut

DEPTH = 5
#: Bytes of context by which the tree is dealt to tasks.
GROUP = 3
OFTEN = 1 << 22
HEAD = 1 << 19
FOLDS = 7
#: The key that counts ends of texts among the words.
END = -0x5E3D0F0E7D5A1C33
_FLUSH = 1 << 21
#: Bytes of text that are scored or counted at a time; each takes some ten words of memory.
_SLICE = 1 << 20
#: Events of a part of the tree that are weighted at a time, in whole groups.
_CHUNK = 1 << 17
_MEMO_BITS = 21
_HALF = math.log(0.5)

#: Of a depth's nodes, ascending: keys (context, then bits so far behind a leading 1), how often the decision was 0, and 1.
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def events(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each byte and the end mark (0) of every text, in order. A code holds the byte in its lowest place
    and the bytes before it above; before a text stand zeros."""
    rows = len(offsets) - 1
    pad = depth + 1
    counts = np.diff(offsets)
    wide = np.zeros(len(raw) + pad * (rows + 1), np.uint64)
    row = np.repeat(np.arange(rows), counts)
    wide[np.arange(len(raw)) + pad * (row + 1)] = raw
    code = wide.copy()
    for i in range(1, depth + 1):
        code[i:] |= wide[:-i] << np.uint64(8 * i)
    first = offsets[:-1] + pad * np.arange(1, rows + 1)
    row = np.repeat(np.arange(rows), counts + 1)
    at = np.arange(len(row)) + (first - (offsets[:-1] + np.arange(rows)))[row]
    return row, code[at]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _mask(d: int) -> np.uint64:
    return np.uint64((1 << (8 * d + 8)) - 1)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending distinct keys with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def levels(codes: np.ndarray, n: np.ndarray, low: int, depth: int) -> list[Level]:
    """The nodes with contexts of ``low`` to ``depth`` bytes of events and how often they occurred."""
    out: list[Level] = []
    n = n.astype(float)
    for d in range(depth, low - 1, -1):
        codes, n = _summed(codes & _mask(d), n)
        byte, context = codes & np.uint64(255), codes & ~np.uint64(255)
        parts = []
        for k in range(8):  # keys of one length ascend as codes do
            bit = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            parts.append(_summed(context | np.uint64(1 << k) | byte >> np.uint64(8 - k), np.where(bit, 0, n), np.where(bit, n, 0)))
        out.append(_summed(*(np.concatenate(x) for x in zip(*parts, strict=True))))
    return out[::-1]


def _block(level: Level) -> np.ndarray:
    _, a, b = level
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - math.log(math.pi) - _lgamma(a + b + 1)


class Mixture:
    """Levels ``low`` and up, weighted. ``last``: logs of the weighted probabilities of the deepest level, if it has
    longer contexts that are not here."""

    def __init__(self, levels: list[Level], low: int, last: np.ndarray | None = None):
        self.levels, self.parent, self.stop = levels, [None] * len(levels), [None] * len(levels)
        self.weighted = _block(levels[-1]) if last is None else last
        for i in range(len(levels) - 1, 0, -1):
            above = levels[i - 1]
            self.parent[i] = np.searchsorted(above[0], levels[i][0] & _mask(low + i - 1))
            below = _HALF + np.bincount(self.parent[i], self.weighted, len(above[0]))
            own = _HALF + _block(above)
            self.weighted = np.logaddexp(own, below)
            self.stop[i - 1] = np.exp(own - self.weighted)

    def ones(self, a: np.ndarray | float = 0.0, b: np.ndarray | float = 1.0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each level the mixed probability that a node's decision is 1 where no longer context is known, if that of
        the first level's nodes is ``a + b * x`` with x their own; and the last level's a and b."""
        out = []
        for i, (_, zero, one) in enumerate(self.levels):
            if i:
                a, b = a[self.parent[i]], b[self.parent[i]]
            kt = (one + 0.5) / (zero + one + 1)
            out.append(a + b * kt)
            if self.stop[i] is not None:
                a, b = a + b * self.stop[i] * kt, b * (1 - self.stop[i])
        return out, np.broadcast_to(a, kt.shape), np.broadcast_to(b, kt.shape)


def log10(nodes: list[np.ndarray], one: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """log10 of each event's probability, decision by decision from the longest context that has it. ``nodes[d]``: keys of
    contexts of d bytes; an event met nowhere has even decisions."""
    total = np.zeros(len(codes))
    byte, context = codes & np.uint64(255), codes & ~np.uint64(255)
    for k in range(8):
        key = context | np.uint64(1 << k) | byte >> np.uint64(8 - k)
        p, open_ = np.full(len(codes), 0.5), np.arange(len(codes))
        for d in range(len(nodes) - 1, -1, -1):
            if not len(nodes[d]) or not len(open_):
                continue
            wanted = key[open_] & _mask(d)
            at = np.minimum(np.searchsorted(nodes[d], wanted), len(nodes[d]) - 1)
            hit = nodes[d][at] == wanted
            p[open_[hit]] = one[d][at[hit]]
            open_ = open_[~hit]
        total += np.log10(np.where(byte >> np.uint64(7 - k) & np.uint64(1), p, 1 - p))
    return total


class Top:
    """The tree down to contexts of ``group`` bytes: what the parts below need of it."""

    def __init__(self, level: Level, last: np.ndarray, group: int):
        every = [level]
        for d in range(group - 1, -1, -1):
            key, zero, one = every[0]
            every.insert(0, _summed(key & _mask(d), zero, one))
        one, self.a, self.b = Mixture(every, 0, last).ones()
        self.nodes, self.one, self.keys = [x[0] for x in every[:group]], one[:group], level[0]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Events and their counts, in whole groups."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()))
        size += batch.num_rows
        if size >= _CHUNK:
            g, k, n = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(g, g[-1]))
            held, size = [(g[last:], k[last:], n[last:])], len(g) - last
            if last:
                yield k[:last], n[:last]
    if size:
        _, k, n = (np.concatenate(x) for x in zip(*held, strict=True))
        yield k, n


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.astype(np.uint64).view(np.int64))


def _summaries(group: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _parts(batches):
            if len(k := k[n > 0]):
                m = Mixture(levels(k, n[n > 0], group, depth), group)
                key, zero, one = m.levels[0]
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(zero), pa.array(one), pa.array(m.weighted)], names=["_k", "_zero", "_one", "_last"])

    return run


def _probabilities(shared, group: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for k, n in _parts(batches):
            nodes, one = list(top.nodes), list(top.one)
            if (n > 0).any():
                m = Mixture(levels(k[n > 0], n[n > 0], group, depth), group)
                at = np.searchsorted(top.keys, m.levels[0][0])
                one += m.ones(top.a[at], top.b[at])[0]
                nodes += [x[0] for x in m.levels]
            p = log10(nodes, one, k)
            for i in range(0, len(k), 1 << 16):
                to = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([_signed(k[to]), pa.array(n[to]), pa.array(p[to])], names=["_k", "_n", "_p"])

    return run


def probabilities(seen: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``_k`` (code), ``_n`` (times in training) and ``_p`` (log10 of its probability) of all counted events."""
    group = min(GROUP, depth)
    spark = seen.sparkSession
    context = F.shiftright("_k", 8).bitwiseAND(F.lit((1 << (8 * group)) - 1))
    dealt = seen.filter("_kind = 1").select(context.alias("_g"), "_k", "_n").repartition("_g").sortWithinPartitions("_g")
    found = dealt.mapInArrow(K.lean(_summaries(group, depth)), "_k long, _zero double, _one double, _last double").toArrow()
    key, zero, one, last = (found[c].to_numpy() for c in ("_k", "_zero", "_one", "_last"))
    order = np.argsort(key)  # contexts are short: no key is negative
    top = Top((key[order].astype(np.uint64), zero[order], one[order]), last[order], group)
    return dealt.mapInArrow(K.lean(_probabilities(spark.sparkContext.broadcast(top), group, depth)), "_k long, _n long, _p double")


class _Memo:
    """Values of sorted keys, NaN for others, through a table of fixed size of keys that were asked before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.asked, self.known = np.full(1 << _MEMO_BITS, ~np.uint64(0)), np.zeros(1 << _MEMO_BITS)

    def get(self, codes: np.ndarray) -> np.ndarray:
        slot = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO_BITS)
        out = self.known[slot]
        miss = np.flatnonzero(self.asked[slot] != codes)
        if len(miss):
            new, inverse = np.unique(codes[miss], return_inverse=True)
            p = np.full(len(new), np.nan)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, new), len(self.keys) - 1)
                p = np.where(self.keys[at] == new, self.values[at], np.nan)
            out[miss] = p[inverse]
            to = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MEMO_BITS)
            self.asked[to], self.known[to] = new, p
        return out


def _each(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) and how often each occurs."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])))) if len(rows) else np.zeros(0, np.int64)
    return rows[first], keys[first], np.diff(np.append(first, len(rows)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        size = [0, 0]

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = _merge(held[kind])
            held[kind], size[kind] = [], 0
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), _signed(part), pa.array(n[i : i + (1 << 16)])], names=["_kind", "_k", "_n"])

        for batch in K.batches_of(batches, "_text", _SLICE):
            raw, offsets = K.text_bytes(batch.column(0))
            raw = K.LOWER[raw]
            learn = np.array(batch.column(1).to_pylist(), bool)
            w = K.words(raw, offsets)
            ends = np.full(int(learn.sum()), END, np.int64).view(np.uint64)
            row, codes = events(raw, offsets, depth)
            counted = learn[row]
            for kind, found, times in ((0, np.concatenate([w.hashes()[learn[w.row]], ends]), 1), (1, codes[counted], 1), (1, codes[~counted], 0)):
                if not len(found):
                    continue
                keys, n = np.unique(found, return_counts=True)
                held[kind].append((keys, n * times))
                size[kind] += len(keys)
                if size[kind] > _FLUSH:
                    held[kind] = [_merge(held[kind])]
                    size[kind] = len(held[kind][0][0])
                    if size[kind] > _FLUSH // 2:
                        yield from flush(kind)
        for kind in (0, 1):
            if held[kind]:
                yield from flush(kind)

    return run


def counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Counts over the rows of ``texts`` (``_text, _learn``) that are learned from: ``_kind`` 0 for words (``_k``: hash, or
    ``END``), 1 for events (``_k``: code). Events of the other rows are there too, counted 0 times."""
    K.bound_batches(texts.sparkSession)
    seen = texts.select("_text", "_learn").mapInArrow(K.lean(_count(depth)), "_kind byte, _k long, _n long")
    return seen.groupBy("_kind", "_k").agg(F.sum("_n").alias("_n"))


def _frequent(table: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    found = table.select("_k", value).toArrow()
    keys = found["_k"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found[value].to_numpy()[order].astype(float)


def score(docs: DataFrame, training: DataFrame | Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH, head: int = HEAD, often: int = OFTEN) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_tokens`` (words and the end), ``n_known`` (of them in training),
    ``train_tokens``, ``base_score`` (word model), ``score`` (log10 probability of the text), ``n_bytes`` and
    ``bits_per_byte`` (code length, the end mark's included, over the text's bytes and the mark).

    ``training``: the texts to learn from, or a condition on rows of ``docs`` that are. Null texts count as empty ones,
    which still have their end; a null condition is false. With nothing to train on, every decision is even. Repeated rows
    are learned from and scored as often as they stand.
    """
    spark = docs.sparkSession
    if isinstance(training, Column):
        pool = docs.select(F.col(text).alias("_text"), F.coalesce(training, F.lit(False)).alias("_learn"))
    else:
        pool = training.select(F.col(text).alias("_text"), F.lit(True).alias("_learn")).unionAll(docs.select(text, F.lit(False)))
    seen = cut(counts(pool, depth))
    words = seen.filter("_kind = 0").select("_k", "_n")
    tokens, distinct = words.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    known = words.withColumn("_v", F.log10(F.col("_n").cast("double") + 1))
    met_events = cut(probabilities(seen, depth))
    total = met_events.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    often_word, often_event = F.col("_n") >= F.lit(tokens / head), (F.col("_n") > 0) & (F.col("_n") >= F.lit(total / often))
    shared = spark.sparkContext.broadcast((_frequent(known.filter(often_word), "_v"), _frequent(met_events.filter(often_event), "_p")))
    end = np.array([END], np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_events = (_Memo(*x) for x in shared.value)
        for batch in K.batches_of(batches, "_text", _SLICE):
            rows = batch.num_rows
            raw, offsets = K.text_bytes(batch.column(2))
            raw = K.LOWER[raw]
            row, code = events(raw, offsets, depth)
            p = of_events.get(code)
            far = np.isnan(p)
            score = np.bincount(row, np.where(far, 0, p), rows)
            w = K.words(raw, offsets)
            word, word_row = np.concatenate([w.hashes(), np.repeat(end, rows)]), np.concatenate([w.row, np.arange(rows)])
            v = of_words.get(word)
            near = ~np.isnan(v)
            base, n_known = np.bincount(word_row[near], v[near], rows), np.bincount(word_row[near], minlength=rows)
            # what is not frequent: one row for each of a text's distinct words and events
            far_words, far_events = _each(word_row[~near], word[~near]), _each(row[far], code[far])
            kinds = [np.full(rows, 2, np.int8), np.zeros(len(far_words[0]), np.int8), np.ones(len(far_events[0]), np.int8)]
            at = pa.array(np.concatenate([np.arange(rows), far_words[0], far_events[0]]))
            nothing = np.zeros(len(at) - rows)
            own = [np.concatenate([x, nothing.astype(x.dtype)]) for x in (w.counts + 1, n_known, np.diff(offsets), base.astype(float), score.astype(float))]
            columns = [
                batch.column(0).take(at),
                batch.column(1).take(at),
                pa.array(np.concatenate(kinds)),
                pa.concat_arrays([batch.column(1), _signed(far_words[1]), _signed(far_events[1])]),
                pa.array(np.concatenate([np.zeros(rows, np.int64), far_words[2], far_events[2]])),
                *map(pa.array, own),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_id", "_kind", "_k", "_times", *_OWN])

    K.bound_batches(spark)
    picked = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), F.col(text)).alias("_id"), F.col(text).alias("_text"))
    schema = picked.select("_key", "_id").schema.add("_kind", "byte").add("_k", "long").add("_times", "long")
    for name in _OWN:
        schema = schema.add(name, "double" if name in ("_base", "_score") else "long")
    parts = picked.mapInArrow(K.lean(run), schema)
    rare = known.filter(~often_word).select(F.lit(0).cast("byte").alias("_kind"), "_k", "_v")
    rare = rare.unionAll(met_events.filter(~often_event).select(F.lit(1).cast("byte"), "_k", "_p"))
    # a text's own row (kind 2) is dealt by its id and meets nothing
    met = parts.join(rare, ["_kind", "_k"], "left")
    worth = F.col("_times") * F.coalesce("_v", F.lit(0.0))
    met = met.withColumns(
        {
            "_known": F.col("_known") + F.when((F.col("_kind") == 0) & F.col("_v").isNotNull(), F.col("_times")).otherwise(F.lit(0)),
            "_base": F.col("_base") + F.when(F.col("_kind") == 0, worth).otherwise(F.lit(0.0)),
            "_score": F.col("_score") + F.when(F.col("_kind") == 1, worth).otherwise(F.lit(0.0)),
        }
    )
    # rows that repeat a key and text are scored alike: their sums are shared out again
    per = met.groupBy("_key", "_id").agg(F.sum((F.col("_kind") == 2).cast("int")).alias("_rows"), *(F.sum(c).alias(c) for c in _OWN))
    one = per.withColumns({c: (F.col(c) / F.col("_rows") if c in ("_base", "_score") else F.expr(f"{c} div _rows")) for c in _OWN})
    one = one.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))))
    each = math.log10(tokens + distinct + 1)
    return one.select(
        F.col("_key").alias(key),
        F.col("_tokens").alias("n_tokens"),
        F.col("_known").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("_base") - F.col("_tokens") * F.lit(each)).alias("base_score"),
        F.col("_score").alias("score"),
        F.col("_bytes").alias("n_bytes"),
        (-F.col("_score") / math.log10(2) / (F.col("_bytes") + 1)).alias("bits_per_byte"),
    )


_OWN = ("_tokens", "_known", "_bytes", "_base", "_score")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: scores of every document under models of the documents of all folds but one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, ~held_out(F.col("doc_id"), FOLDS))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
