"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit of the code a binary classifier tells the languages whose codeword has the
bit from the others: its margin is the mean log-odds of a text's byte n-grams, scaled by a logistic fit. Decoding is
loss-weighted: a codeword's distance adds up the logistic loss of each margin, weighted by how well that bit's classifier
does on that language, so that weak classifiers have little say. The nearest codeword wins; where the runner-up is almost
as near the answer is flagged as ambiguous.

N-grams of 1 to 3 bytes come from the lower-cased text with everything but letters read as one space. Learning sees at
most ``SAMPLE`` documents (a parameter); predicting is one pass over whole texts without a shuffle.
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
from tessera.llm.frames import beside
from tessera.llm.split import df_of, held_out, sampled, smallest

#: Labelled documents that learning reads at most.
SAMPLE = 12_000
#: Languages that are learned at most.
LANGUAGES = 64
#: Up to this many languages the code has all splits of the languages in two; beyond, random ones.
EXHAUSTIVE = 6
UNKNOWN = "und"
#: A lead over the runner-up, in probability, below which an answer is ambiguous.
LEAD = 0.2

ORDERS = (1, 2, 3)
_SIZES = (1 << 8, 1 << 16, 1 << 16)
_BASES = (0, 1 << 8, (1 << 8) + (1 << 16))
SLOTS = sum(_SIZES)
_CHUNK = 1 << 19

_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def code(languages: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 per language; no column is constant, and rows are far apart."""
    if languages <= 2:
        return np.array([[1], [-1]])[:languages]
    if languages <= EXHAUSTIVE:
        columns = [[1, *(1 if c >> i & 1 else -1 for i in range(languages - 1))] for c in range((1 << (languages - 1)) - 1)]
        return np.array(columns).T
    bits = max(15, int(np.ceil(10 * np.log2(languages))))
    rng = np.random.default_rng(seed)
    draws = (rng.choice([-1, 1], size=(languages, bits)) for _ in range(200))
    usable = [m for m in draws if (abs(m.sum(axis=0)) < languages).all()]
    apart = lambda m: min((m[i] != m[j]).sum() for i in range(languages) for j in range(i))
    return max(usable, key=apart)


def _windows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, row, slot) of all n-grams, some at a time."""
    raw, offsets = K.text_bytes(pc.utf8_lower(texts))
    raw = _SPACE[raw]
    blank = raw == 0x20
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    places = np.concatenate(([0], np.cumsum(keep)))
    offsets, raw = places[offsets], raw[keep].astype(np.uint32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n, base in zip(ORDERS, _BASES, strict=True):
        first = K.runs(offsets, n)
        for lo in range(0, len(first), _CHUNK):
            at = first[lo : lo + _CHUNK]
            gram = raw[at]
            for i in range(1, n):
                gram = gram << 8 | raw[at + i]
            if n == 1:
                seen = gram != 0x20
                at, gram = at[seen], gram[seen]
            slot = gram if n < 3 else gram * np.uint32(0x9E3779B1) >> np.uint32(16)
            yield n, rows[at], slot.astype(np.int64) + base


def _has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray
    sharpness: float

    def raw_margins(self, texts: pa.Array) -> np.ndarray:
        """Mean log-odds of each text and bit; all 0 where a text has no n-gram."""
        total, n = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for _, row, slot in _windows(texts):
            if len(row):
                begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                total[row[begin]] += np.add.reduceat(self.odds[slot], begin, axis=0)
                n += np.bincount(row, minlength=len(n))
        return total / np.maximum(n, 1)[:, None]

    def distances(self, margins: np.ndarray) -> np.ndarray:
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :])
        return (loss * self.trust[None, :, :]).sum(axis=2)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and every codeword's probability."""
        d = -self.sharpness * self.distances(self.raw_margins(texts) * self.scale + self.shift)
        p = np.exp(d - d.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a ridge logistic fit of y (+1 or -1) on x, by Newton's method."""
    a = np.zeros(2)
    f = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(f @ a, -35, 35)))
        grad = f.T @ (w * (p - (y > 0))) + 1e-3 * a
        a = a - np.linalg.solve((f * (w * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2), grad)
    return float(a[0]), float(a[1])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model | None:
    """A model from the labelled documents of all folds but one; None if there are none.

    Rows with a null label, or without a letter in the text, teach nothing. Rows that repeat a key, label and text count
    once; a text with several labels counts for each. At most ``sample`` rows are read, and of their labels the
    ``languages`` most frequent are learned, which bounds the counters that a task holds.
    """
    spark = docs.sparkSession
    K.bound_batches(spark)
    marked = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    marked = marked.filter(~held_out(F.col("_key"), folds) & F.col("_lang").isNotNull())
    chosen = df_of(smallest(marked.select("_key", "_lang").dropna().distinct(), "_key", sample))  # at most ``sample`` pairs
    texts = sampled(marked, chosen, sample).drop("_t").filter(F.col("_text").rlike(r"\p{L}"))
    seen_most = texts.groupBy("_lang").count().orderBy(F.col("count").desc(), "_lang").limit(languages).collect()
    languages = sorted(r[0] for r in seen_most)
    texts = texts.filter(F.col("_lang").isin(languages))
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), SLOTS), np.int64)
        for batch in K.batches_of(batches, "_text", 1 << 20):
            of = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for _, row, slot in _windows(batch.column(1)):
                seen += np.bincount(of[row] * SLOTS + slot, minlength=seen.size).reshape(seen.shape)
        of, slot = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(seen[of, slot])], names=["_l", "_slot", "_n"])

    counted = texts.select("_lang", "_text").mapInArrow(count, "_l int, _slot int, _n long").groupBy("_l", "_slot").agg(F.sum("_n").alias("_n")).toPandas()
    seen = np.zeros((len(languages), SLOTS))
    seen[counted["_l"], counted["_slot"]] = counted["_n"]
    share = np.empty_like(seen)
    for base, size in zip(_BASES, _SIZES, strict=True):
        part = seen[:, base : base + size] + 0.5
        share[:, base : base + size] = part / part.sum(axis=1, keepdims=True)
    words = code(len(languages))
    odds = np.stack([np.log(share[b > 0].mean(axis=0)) - np.log(share[b < 0].mean(axis=0)) if (b < 0).any() else np.zeros(SLOTS) for b in words.T], axis=1).astype(np.float32)
    bits = words.shape[1]
    ones = np.ones(bits)
    model = Model(languages, words, odds, ones, 0 * ones, np.full(words.shape, 1 / bits), 1.0)
    if len(languages) == 1:
        return model
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.batches_of(batches, "_text", 1 << 20):
            m = shared.value.raw_margins(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(m), pa.list_(pa.float64()))], names=["_lang", "_m"])

    measured = texts.select("_lang", "_text").mapInArrow(measure, "_lang string, _m array<double>").toPandas()
    margins, truth = np.stack(measured["_m"].to_numpy()), measured["_lang"].map(number).to_numpy()
    order = np.lexsort((*margins.T, truth))
    margins, truth = margins[order], truth[order]
    even = (len(truth) / len(languages) / np.bincount(truth, minlength=len(languages)))[truth]
    fits = [_calibrate(margins[:, j], words[truth, j], even) for j in range(bits)]
    scale, shift = np.array(fits).T
    margins = margins * scale + shift
    right = margins * words[truth] > 0
    trust = np.stack([(right[truth == c].sum(axis=0) + 1) / ((truth == c).sum() + 2) for c in range(len(languages))])
    trust = np.maximum(trust - 0.5, 1e-3)
    trust /= trust.sum(axis=1, keepdims=True)
    model = Model(languages, words, odds, scale, shift, trust, 1.0)
    d = model.distances(margins)

    def likelihood(b: float) -> float:
        z = -b * d
        return float((z[np.arange(len(z)), truth] - np.logaddexp.reduce(z, axis=1)).mean())

    sharpness = max((2.0**e for e in np.arange(-3, 7, 0.5)), key=likelihood)
    return Model(languages, words, odds, scale, shift, trust, sharpness)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without its text and with ``_lang``, ``_score`` (the winner's probability), ``_runner_up`` and
    ``_ambiguous``. Null and empty texts and texts without a letter are ``und`` with score 0, as all are without a model.
    Of languages that are equally likely the first by name wins. Input columns of the added names go on with an underscore
    more."""
    docs = beside(docs, "_lang", "_score", "_runner_up", "_ambiguous")
    keep = [c for c in docs.columns if c != text]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in K.batches_of(batches, text, 1 << 20):
            texts = batch.column(len(keep))
            n = batch.num_rows
            lettered = _has_letter(texts) if m else np.zeros(n, bool)
            best, p = m.predict(texts) if m else (np.zeros(n, np.int64), np.zeros((n, 1)))
            two = np.argsort(-p, axis=1, kind="stable")[:, 1] if p.shape[1] > 1 else best
            top, second = p[np.arange(n), best], p[np.arange(n), two] if p.shape[1] > 1 else np.zeros(n)
            names = np.array([*(m.languages if m else []), UNKNOWN], object)
            lang = np.where(lettered, names[best], UNKNOWN)
            runner = np.where(lettered & (two != best), names[two], None)
            columns = [pa.array(lang, pa.string()), pa.array(np.where(lettered, np.clip(top, 0, 1), 0.0)), pa.array(runner, pa.string()), pa.array(~lettered | (top - second < LEAD))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, "_lang", "_score", "_runner_up", "_ambiguous"])

    K.bound_batches(spark)
    schema = docs.select(*keep).schema.add("_lang", "string").add("_score", "double").add("_runner_up", "string").add("_ambiguous", "boolean")
    return docs.select(*keep, text).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_runner_up").alias("runner_up"), F.col("_ambiguous").alias("ambiguous"))
