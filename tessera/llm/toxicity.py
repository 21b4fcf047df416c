"""Toxicity by multiple-instance learning: labels mark documents, the model scores sentences.

A document is a bag of sentences. A sentence's chance to be toxic is a logistic function of the words and word
beginnings in it that were selected as evidence; a document is toxic if any sentence is (noisy-or) or for a reason that no sentence shows (the
leak): ``1 - (1 - leak) * prod(1 - p_s)``. Maximum likelihood on document labels thus learns which sentences offend, and
``locate`` returns them. Sentences without evidence have p = 0, so length alone never makes a document toxic.

Learning reads a sample of labelled documents of at most ``SAMPLE`` rows (a parameter); scoring is one pass over whole
texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.frames import anonymous, beside
from tessera.llm.split import df_of, held_out, sampled, smallest
from tessera.plans.lineage import cut

#: Labelled documents that learning reads at most.
SAMPLE = 24_000
#: Words are told apart by this many bits of their hash, so tables of words have a fixed size.
SLOT_BITS = 20
#: Beginnings of a word, in bytes, that are features beside the word itself: stems outlive endings and compounds.
STEMS = (4, 5, 6, 7, 8)
#: Words that may become evidence, at most, and the G-test statistic each needs.
EVIDENCE, G_LEAST = 2048, 30.0
THRESHOLD = 0.3

_SLOTS = 1 << SLOT_BITS
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[b for b in range(128) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Model:
    """``weight[slot]`` is NaN where the word is no evidence."""

    weight: np.ndarray
    bias: float
    leak: float


@dataclass
class _Found:
    """Evidence of a batch: one entry per sentence that has any."""

    row: np.ndarray
    sentence: np.ndarray
    entry: np.ndarray
    slot: np.ndarray
    stops: np.ndarray


def _slots(texts: pa.Array) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """The words, the slots of each one's features (a row of the word and its longer beginnings, -1 where it is no
    longer than one), and the texts' offsets."""
    raw, offsets = K.text_bytes(pc.utf8_lower(texts))
    w = K.words(raw, offsets, _SEPARATOR)
    ends = np.stack([w.end, *(np.minimum(w.end, w.start + n) for n in STEMS)])
    slots = (K.slice_hashes(w.buf, w.start, ends) >> K.U64(64 - SLOT_BITS)).astype(np.int64).T
    slots[:, 1:][ends[1:].T == w.end[:, None]] = -1
    return w, slots, offsets


def _evidence(texts: pa.Array, wanted: np.ndarray) -> _Found:
    w, slot, offsets = _slots(texts)
    hit, kind = np.nonzero(wanted[slot] & (slot >= 0))
    stops = np.concatenate(([0], np.cumsum(_STOP[w.buf])))
    row = w.row[hit]
    sentence = stops[w.start[hit]] - stops[offsets[row]]
    first = np.ones(len(hit), bool)
    first[1:] = (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])
    return _Found(row[first], sentence[first], np.cumsum(first) - 1, slot[hit, kind], stops)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, _SLOTS), np.int32)
    for batch in K.batches_of(batches, "_text"):
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        w, slot, _ = _slots(batch.column(0))
        word, kind = np.nonzero(slot >= 0)
        pair = np.unique(w.row[word] * _SLOTS + slot[word, kind])
        np.add.at(seen, (toxic[pair // _SLOTS], pair % _SLOTS), 1)
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["_slot", "_no", "_yes"])


def _g(no: np.ndarray, yes: np.ndarray, all_no: int, all_yes: int) -> np.ndarray:
    """G statistic of word presence against the label; negative where the word speaks against toxicity."""
    total, n = no + yes, all_no + all_yes
    out = np.zeros(len(no))
    for seen, of in ((no, all_no), (yes, all_yes)):
        for a, b in ((seen, total), (of - seen, n - total)):
            a, b = a.astype(float), b.astype(float)
            out += np.where(a > 0, a * np.log(np.maximum(a, 1e-300) * n / (np.maximum(b, 1e-300) * max(of, 1))), 0)
    return 2 * out * np.sign(yes * all_no - no * all_yes)


def _fit(bag: np.ndarray, entry: np.ndarray, feature: np.ndarray, label: np.ndarray, features: int, steps: int = 600, ridge: float = 0.02):
    """Adam on the mean negative log-likelihood of the noisy-or. ``bag[s]`` is the document of sentence s; documents are
    numbered like ``label``; ``feature[i]`` is in sentence ``entry[i]``."""
    theta = np.concatenate([np.zeros(features), [-1.0], [-4.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-2] + np.bincount(entry, theta[feature], len(bag))
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + np.exp(-theta[-1]))
        clean = np.bincount(bag, -np.logaddexp(0, z), len(label)) + np.log1p(-leak)  # log of the chance of no toxic sentence
        toxic = -np.expm1(clean)
        # d(-LL)/d(clean): clean documents want it high, toxic ones low
        slope = np.where(label > 0, np.exp(clean) / np.maximum(toxic, 1e-12), -1.0) / len(label)
        dz = slope[bag] * -p
        grad = np.concatenate([np.bincount(feature, dz[entry], features) + ridge * theta[:features] / len(label), [dz.sum()], [(slope * -leak).sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:features], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1])))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents of all folds but one.

    Rows whose label or key is null don't count; a document with several labels counts by its largest. Rows that repeat a
    key and text are one document. At most ``sample`` of them are read. Without any labelled documents the model has no
    evidence and a leak of one half.
    """
    spark = docs.sparkSession
    K.bound_batches(spark)
    marked = labels.select(F.col(key).alias("_key"), (F.col(label) > 0).cast("int").alias("_label")).dropna()
    marked = marked.filter(~held_out(F.col("_key"), folds)).groupBy("_key").agg(F.max("_label").alias("_label"))
    chosen = df_of(smallest(marked, "_key", sample))  # at most ``sample`` pairs
    texts = sampled(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), chosen.select("_key"), sample).join(F.broadcast(chosen), "_key")
    texts = cut(texts.select("_text", "_label", F.xxhash64("_key", "_t").alias("_bag")))
    counted = texts.select("_text", "_label").mapInArrow(_document_frequencies, "_slot int, _no int, _yes int")
    counted = counted.groupBy("_slot").agg(F.sum("_no").alias("_no"), F.sum("_yes").alias("_yes")).filter("_no + _yes >= 3").toPandas()
    totals = {r["_label"]: r["n"] for r in texts.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    all_no, all_yes = totals.get(0, 0), totals.get(1, 0)
    weight = np.full(_SLOTS, np.nan, np.float32)
    prior = (all_yes + 0.5) / (all_no + all_yes + 1)
    if not all_no or not all_yes:
        return Model(weight, 0.0, prior)
    counted = counted.sort_values("_slot")
    g = _g(counted["_no"].to_numpy(), counted["_yes"].to_numpy(), all_no, all_yes)
    best = np.argsort(-g, kind="stable")[:EVIDENCE]
    slots = np.sort(counted["_slot"].to_numpy()[best[g[best] >= G_LEAST]])
    wanted = np.zeros(_SLOTS, bool)
    wanted[slots] = True

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, "_text"):
            f = _evidence(batch.column(0), wanted)
            row = f.row[f.entry]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(f.sentence[f.entry]), pa.array(f.slot)], names=["_bag", "_label", "_sentence", "_slot"])

    pairs = texts.select("_text", "_label", "_bag").mapInArrow(bags, "_bag long, _label int, _sentence long, _slot long").distinct()
    pairs = pairs.toPandas().sort_values(["_bag", "_sentence", "_slot"])
    documents, doc = np.unique(pairs["_bag"].to_numpy(), return_inverse=True)
    change = np.ones(len(pairs), bool)
    change[1:] = (doc[1:] != doc[:-1]) | (pairs["_sentence"].to_numpy()[1:] != pairs["_sentence"].to_numpy()[:-1])
    bag = doc[change]
    with_evidence = np.zeros(len(documents), np.int64)
    with_evidence[doc] = pairs["_label"].to_numpy()
    yes, no = all_yes - int(with_evidence.sum()), all_no - int((1 - with_evidence).sum())
    label_of = np.concatenate([with_evidence, np.ones(max(yes, 0), np.int64), np.zeros(max(no, 0), np.int64)])
    w, bias, leak = _fit(bag, np.cumsum(change) - 1, np.searchsorted(slots, pairs["_slot"].to_numpy()), label_of, len(slots))
    weight[slots] = w
    return Model(weight, bias, leak)


def _apply(model, spark):
    shared = spark.sparkContext.broadcast((model.weight, model.bias, model.leak))

    def found(texts: pa.Array) -> tuple[_Found, np.ndarray, float]:
        weight, bias, leak = shared.value
        f = _evidence(texts, ~np.isnan(weight))
        z = bias + np.bincount(f.entry, weight[f.slot], len(f.row))
        return f, z, leak

    return found


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text and with ``_score`` (0 to 1), ``_sentence`` (the number of the most offending
    sentence, from 0, the earliest of several; null if none has evidence) and ``_sentence_score``. Null and empty texts
    score the leak. Input columns of the added names go on with an underscore more."""
    docs = beside(docs, "_score", "_sentence", "_sentence_score")
    keep = [c for c in docs.columns if c != text]
    found = _apply(model, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, text):
            n = batch.num_rows
            f, z, leak = found(batch.column(len(keep)))
            total = 1 - (1 - leak) * np.exp(np.bincount(f.row, -np.logaddexp(0, z), n))
            worst = np.full(n, -1, np.int64)
            top = np.zeros(n)
            order = np.lexsort((-f.sentence, z))  # the last written wins: the highest, then the earliest
            worst[f.row[order]] = f.sentence[order]
            top[f.row[order]] = 1 / (1 + np.exp(-z[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(total, 0, 1)), pa.array(worst, mask=worst < 0), pa.array(top)], names=[*keep, "_score", "_sentence", "_sentence_score"])

    K.bound_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("_score", "double").add("_sentence", "long").add("_sentence_score", "double")
    return docs.select(*keep, text).mapInArrow(run, schema)


def locate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per sentence that scores ``least`` or more: key, number of the sentence, its score and its text."""
    found = _apply(model, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, "_text"):
            raw, offsets = K.text_bytes(batch.column(1))
            f, z, _ = found(batch.column(1))
            p = 1 / (1 + np.exp(-z))
            at = np.flatnonzero(p >= least)
            begin = np.searchsorted(f.stops, f.stops[offsets[f.row[at]]] + f.sentence[at])
            begin = np.maximum(begin, offsets[f.row[at]])
            end = np.minimum(np.searchsorted(f.stops, f.stops[begin] + 1), offsets[f.row[at] + 1])
            spans = [bytes(raw[a:b]).decode("utf-8", "replace").strip() for a, b in zip(begin, end, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(f.row[at])), pa.array(f.sentence[at]), pa.array(p[at]), pa.array(spans, pa.string())], names=[key, "sentence", "score", "text"])

    K.bound_batches(docs.sparkSession)
    schema = docs.select(key).schema.add("sentence", "long").add("score", "double").add("text", "string")
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay as they are. Where nothing could be learned
    nothing is rejected."""
    model = train(docs, labels, key, text)
    if np.isnan(model.weight).all():
        return docs
    plain, of, back = anonymous(docs)
    scored = score(plain.withColumn("_of", F.col(of[text])), model, "_of")
    return back(scored.filter(F.col("_score") < threshold))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_sentence").alias("sentence"), F.col("_sentence_score").alias("sentence_score"))
