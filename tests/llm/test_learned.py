"""Language, quality, toxicity and language-model scores: held-out figures, brute force, awkward rows."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ctw, langid, quality, toxicity
from tessera.llm import kernels as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


# language


def test_code_words_are_apart():
    for n in (1, 2, 3, 4, 6, 9, 20):
        m = langid.code(n)
        assert m.shape[0] == n
        if n > 2:
            assert (abs(m.sum(axis=0)) < n).all()
            assert min((a != b).sum() for a, b in itertools.combinations(m, 2)) >= 2


def test_language_held_out(spark, sf):
    r = langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in r) >= 0.95 * len(r)
    assert all(0 <= x.score <= 1 for x in r)


def test_language_uses_text_alone(spark, sf, odd, clashing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    found = langid.predict(odd.select("doc_id", "text"), model)
    got = {(r.doc_id, r._lang, r._score) for r in found.collect()}
    assert {x for x in got if x[1] == "und"} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (7, "und", 0.0), (None, "und", 0.0)}
    assert found.count() == odd.count()
    again = langid.predict(clashing, model)
    assert by_id(again, "_lang") == by_id(found, "_lang") and len(set(again.columns)) == len(again.columns)
    held = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert langid.train(held).languages == model.languages


def brute_slots(text):
    """N-gram slots of a text, one by one."""
    raw = (text or "").lower().encode()
    raw = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", raw)
    for i in range(len(raw)):
        if raw[i] != 0x20:
            yield raw[i]
        if i + 1 < len(raw):
            yield 256 + raw[i] * 256 + raw[i + 1]
        if i + 2 < len(raw):
            yield 256 + 65536 + ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % 2**32 >> 16)


def test_language_against_brute_force(spark, sf):
    """Odds of n-grams, margins and decoding, recomputed with plain counters."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.lang is not None and r.text and len(r.text) < 3000][:80]
    frame = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs], "doc_id long, text string, lang string")
    model = langid.train(frame)
    learned = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and re.search(r"[^\W\d_]", r.text)]
    assert model.languages == sorted({r.lang for r in learned})
    seen = {x: collections.Counter() for x in model.languages}
    for r in learned:
        seen[r.lang].update(brute_slots(r.text))
    bounds = (0, 256, 256 + 65536, 256 + 2 * 65536)
    size = {x: [sum(n for k, n in c.items() if a <= k < b) + 0.5 * (b - a) for a, b in itertools.pairwise(bounds)] for x, c in seen.items()}

    def odds(slot, bits):
        part = next(i for i in range(3) if slot < bounds[i + 1])
        share = [(seen[x][slot] + 0.5) / size[x][part] for x in model.languages]
        yes, no = ([p for p, b in zip(share, bits, strict=True) if b == v] for v in (1, -1))
        return math.log(sum(yes) / len(yes)) - math.log(sum(no) / len(no))

    known = {}
    for r in docs[:12]:
        slots = list(brute_slots(r.text))
        margins = []
        for j, bits in enumerate(model.code.T):
            known.update({(s, j): odds(s, bits) for s in set(slots) if (s, j) not in known})
            margins.append(sum(known[(s, j)] for s in slots) / len(slots) * model.scale[j] + model.shift[j])
        far = [sum(t * math.log1p(math.exp(-m * b)) for m, b, t in zip(margins, word, trust, strict=True)) for word, trust in zip(model.code, model.trust, strict=True)]
        weights = [math.exp(-model.sharpness * x) for x in far]
        best, p = model.predict(pa.array([r.text]))
        assert best[0] == far.index(min(far))
        assert p[0].tolist() == pytest.approx([w / sum(weights) for w in weights], rel=1e-3, abs=1e-6)


def test_language_without_labels(spark, odd, nothing):
    assert langid.train(nothing) is None
    assert {r._lang for r in langid.predict(odd.select("doc_id", "text"), None).collect()} == {"und"}
    assert langid.predict(nothing.select("doc_id", "text"), None).count() == 0
    one = odd.filter("lang = 'fr'").withColumn("doc_id", F.lit(1))
    assert {r._lang for r in langid.predict(one.select("doc_id", "text"), langid.train(one)).collect()} <= {"fr", "und"}


# quality


def base(text):
    t = text or ""
    w = WORD.findall(t)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    times = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered)


def test_quality_counts(spark, sf, odd, labels):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    tricky = [(100_001, "a b c a b c"), (100_002, "x\nx\n\nx\n"), (100_003, "\n\na#\na#"), (100_004, "q w e r t q w e")]
    docs = docs.unionByName(spark.createDataFrame(tricky, "doc_id long, text string"))
    texts = sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=repr)
    out = quality.judged(docs, labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_id(out, *names) == texts
    for r in out.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_scores_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) < 4000][:60]
    frame, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{sf}/labels.parquet")
    marks = collections.defaultdict(set)
    for r in labels.collect():
        marks[r.doc_id].add(r.quality)
    good = {i for i, _ in docs if marks[i] and marks[i] - {None} == {1}}
    grams = lambda t: [int.from_bytes(t.encode()[i : i + 4], "big") * 0x9E3779B1 % 2**32 >> 15 for i in range(len(t.encode()) - 3)]
    raw, trusted = collections.Counter(), collections.Counter()
    for i, t in docs:
        raw.update(grams(t))
        if i in good:
            trusted.update(grams(t))
    n, m = sum(raw.values()) + 2**17, sum(trusted.values())
    share = lambda g: (raw[g] + 1) / n
    odds = {g: math.log((trusted[g] + quality.PRIOR * share(g)) / (m + quality.PRIOR) / share(g)) for g in raw}
    want = {i: sum(odds[g] for g in grams(t)) / max(1, len(grams(t))) for i, t in docs}
    low, median = np.quantile([want[i] for i in good], [quality.LOW, 0.5])
    least = low - quality.WIDTH * (median - low)
    for r in quality.judged(frame, labels).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-3, abs=1e-5)
        assert r.kept == (not r.base_failed and want[r.doc_id] >= least) or abs(want[r.doc_id] - least) < 1e-4


def test_quality_learns_from_all_trusted(spark):
    n = 24_600  # the sample that was read before had 24,000
    line = F.concat_ws(" ", *[F.substring(F.sha1(F.concat(F.col("id").cast("string"), F.lit(f".{i}"))), 1, 5) for i in range(3)])
    docs = spark.range(n).select(F.col("id").alias("doc_id"), line.alias("text"))
    good = quality.trusted(docs.select("doc_id", F.when(F.col("doc_id") % 100 == 0, 0).otherwise(1).alias("quality")))
    assert good.count() == n - n // 100
    seen = np.zeros((2, quality._SLOTS))
    rows = docs.collect()
    for some in (rows, [r for r in rows if r.doc_id % 100]):
        for _, slot in quality._grams(*K.text_bytes(pa.array([r.text for r in some]))):
            seen[int(len(some) < n)] += np.bincount(slot, minlength=quality._SLOTS)
    share = (seen[0] + 1) / (seen[0] + 1).sum()
    want = np.log((seen[1] + quality.PRIOR * share) / (seen[1].sum() + quality.PRIOR) / share)
    np.testing.assert_allclose(quality.ratios(docs, good), want, rtol=1e-4, atol=1e-6)


def test_quality_same_if_trusted_are_many(spark, sf, labels, odd, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    marks = spark.read.parquet(f"{sf}/labels.parquet").unionByName(labels)
    names = ("n_words", "base_failed", "kept", "score")
    sent = by_id(quality.judged(docs, marks), *names)
    plain = quality.quantiles
    monkeypatch.setattr(quality, "if_few", lambda df: df.hint("merge"))
    monkeypatch.setattr(quality, "quantiles", lambda df, by, value, shares, kept: plain(df, by, value, shares, 0))
    assert by_id(quality.judged(docs, marks), *names) == sent


def test_quality_tells_junk(spark, sf):
    r = quality.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    good, bad = [x.kept for x in r if x.quality == 1], [x.kept for x in r if x.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_quality_awkward(spark, nothing, odd, clashing, labels):
    assert quality.judged(nothing, labels).count() == 0
    none = quality.judged(odd, labels.limit(0))
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in none.collect())
    out = quality.judged(clashing, labels)
    assert out.count() == odd.count() and len(set(out.columns)) == len(out.columns)


# toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    r = toxicity.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    caught = [x for x in r if x.predicted]
    assert sum(x.toxic for x in caught) >= 0.9 * len(caught)
    assert sum(x.predicted for x in r if x.toxic) >= 0.5 * sum(x.toxic for x in r)


def test_toxicity_is_noisy_or_of_sentences(spark):
    weight = np.full(1 << toxicity.SLOT_BITS, np.nan, np.float32)
    for word, w in (("idiot", 3.0), ("clown", 1.0)):
        _, slots, _ = toxicity._slots(pa.array([word]))
        weight[slots[0, 0]] = w
    model = toxicity.Model(weight, -2.0, 0.01)
    texts = ["You IDIOT, you clown. Nice day!\nA clown", "nothing here", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = lambda z: 1 / (1 + math.exp(-z))
    want = [1 - 0.99 * (1 - p(2.0)) * (1 - p(-1.0)), 0.01, 0.01, 0.01]
    got = sorted(toxicity.score(df, model).collect())
    assert [r._score for r in got] == pytest.approx(want)
    assert [r._sentence for r in got] == [0, None, None, None]
    found = toxicity.locate(df, model, least=0.2).collect()
    assert [(r.doc_id, r.sentence, r.text) for r in found] == [(0, 0, "You IDIOT, you clown."), (0, 3, "A clown")]  # every stop ends a sentence, the line end too


def test_fit_is_the_likeliest(spark):
    """No small step from the fitted weights makes the noisy-or of the labels likelier, by a loop over documents."""
    rng = random.Random(2)
    bags = [[sorted(rng.sample(range(6), rng.randint(1, 3))) for _ in range(rng.randint(1, 4))] for _ in range(150)]
    label = np.array([int(any(0 in s for s in b) or rng.random() < 0.1) for b in bags])
    entry = [(d, s) for d, b in enumerate(bags) for s in b]
    feature = [(i, f) for i, (_, s) in enumerate(entry) for f in s]
    at, of = (np.array(x) for x in zip(*feature, strict=True))
    weight, bias, leak = toxicity._fit(np.array([d for d, _ in entry]), at, of, label, 6, steps=4000)

    def cost(w, b, k):
        total = 0.01 / len(bags) * sum(x * x for x in w)
        for bag, y in zip(bags, label, strict=True):
            clean = (1 - k) * math.prod(1 - 1 / (1 + math.exp(-(b + sum(w[f] for f in s)))) for s in bag)
            total -= math.log(1 - clean if y else clean) / len(bags)
        return total

    best = cost(weight, bias, leak)
    for _ in range(200):
        step = [rng.gauss(0, 0.1) for _ in range(8)]
        assert cost(weight + step[:6], bias + step[6], 1 / (1 + math.exp(-(math.log(leak / (1 - leak)) + step[7])))) > best - 2e-4
    assert weight.argmax() == 0


def test_evidence_and_places_against_brute_force(spark):
    """Document frequencies, G statistics, sentence scores and the most offending sentence, with plain sets."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    slot = lambda w: int(K.slice_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] >> np.uint64(64 - toxicity.SLOT_BITS))
    kinds = lambda w: {w} | {w[:n] for n in toxicity.STEMS if n < len(w)}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    some = [r for r in docs.orderBy("doc_id").collect() if r.text and len(r.text) < 2000][:60]
    toxic = [r for r in toxicity.score(docs, model).filter("_sentence IS NOT NULL").orderBy("doc_id").collect()][:40]
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {}
    for i in [r.doc_id for r in some] + [r.doc_id for r in toxic]:
        scores = {}
        for n, sentence in enumerate(re.split(rb"[.!?\n]", texts[i].lower().encode())):
            found = [model.weight[slot(k)] for w in re.findall(rb"[a-z0-9\x80-\xff]+", sentence) for k in kinds(w)]
            found = [float(x) for x in found if not math.isnan(x)]
            if found:
                scores[n] = sigmoid(model.bias + sum(found))
        want[i] = (1 - (1 - model.leak) * math.prod(1 - p for p in scores.values()), max(scores, key=lambda n: (scores[n], -n)) if scores else None)
    for r in toxicity.score(docs.filter(F.col("doc_id").isin(*want)), model).collect():
        assert r._score == pytest.approx(want[r.doc_id][0], rel=1e-4, abs=1e-6) and r._sentence == want[r.doc_id][1]


def test_nothing_to_learn_rejects_nothing(spark, odd, nothing, labels):
    assert toxicity.clean(odd, labels.limit(0)).count() == odd.count()


def test_repeated_rows_teach_no_more(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    once, thrice = toxicity.train(docs, labels), toxicity.train(docs.unionAll(docs).unionAll(docs), labels)
    assert (once.bias, once.leak) == (thrice.bias, thrice.leak) and np.array_equal(once.weight, thrice.weight, equal_nan=True)


def test_toxicity_awkward(spark, odd, nothing, clashing, labels):
    model = toxicity.train(odd, labels)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(odd, model).count() == odd.count()
    empty = toxicity.train(nothing, labels.limit(0))
    assert {r._score for r in toxicity.score(odd, empty).collect()} == {0.5}
    kept = toxicity.clean(clashing, labels)
    assert kept.columns == clashing.columns and by_id(kept, "_of") == by_id(toxicity.clean(odd.withColumn("_of", F.lit("_of")), labels), "_of")


# context-tree weighting


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


class BruteTree:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, collections.defaultdict(lambda: [0, 0])
        for t in texts:
            for context, byte in self.steps(t):
                for k in range(8):
                    for d in range(depth + 1):
                        self.n[(context[depth - d :], byte >> (8 - k) | 1 << k)][byte >> (7 - k) & 1] += 1
        self.children = collections.defaultdict(set)
        for context, node in self.n:
            if context:
                self.children[(context[1:], node)].add((context, node))
        self.memo = {}

    def steps(self, text):
        raw = bytes(self.depth) + lowered(text).encode() + b"\0"
        for i in range(self.depth, len(raw)):
            yield raw[i - self.depth : i], raw[i]

    def block(self, key):
        a, b = self.n[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, key):
        if key not in self.memo:
            own = self.block(key)
            if len(key[0]) < self.depth:
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(map(self.weighted, self.children[key])))
            self.memo[key] = own
        return self.memo[key]

    def one(self, context, node):
        """Chance that the decision is 1, mixed over all contexts that were seen."""
        p = None
        for d in range(self.depth, -1, -1):
            key = (context[self.depth - d :], node)
            if key not in self.n:
                continue
            a, b = self.n[key]
            kt = (b + 0.5) / (a + b + 1)
            if p is None:
                p = kt
            else:
                stop = math.exp(math.log(0.5) + self.block(key) - self.weighted(key))
                p = stop * kt + (1 - stop) * p
        return 0.5 if p is None else p

    def log10(self, text):
        total = 0.0
        for context, byte in self.steps(text):
            for k in range(8):
                p = self.one(context, byte >> (8 - k) | 1 << k)
                total += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
        return total


@pytest.mark.parametrize(("depth", "often"), [(2, 1 << 22), (2, 5), (5, 1 << 22), (5, 30)])
def test_scores_against_brute_force(spark, depth, often):
    train = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog sat", "the the the", "", None, "é cat\nsat"])]
    test = [*train, (10, "the cat ran"), (11, "zzz \x00 é"), (12, "the"), (12, "the"), (None, "a cat")]
    schema = "doc_id long, text string"
    out = ctw.score(spark.createDataFrame(test, schema), spark.createDataFrame(train, schema), depth=depth, head=3, often=often)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    brute = BruteTree([t for _, t in train], depth)
    count = collections.Counter()
    for _, t in train:
        count.update([*WORD.findall(lowered(t)), None])
    total, distinct = sum(count.values()), len(count)
    assert sum(map(len, got.values())) == len(test) and len(got[12]) == 2
    for i, t in test:
        words = [*WORD.findall(lowered(t)), None]
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), total)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words))
            assert r.score == pytest.approx(brute.log10(t), rel=1e-9)


def test_scores_are_probabilities():
    codes = np.concatenate([ctw.events(*_bytes(t), 2)[1] for t in ("abcabc", "abd")])
    seen, n = np.unique(codes, return_counts=True)
    every = ctw.levels(seen, n, 0, 2)
    one, _, _ = ctw.Mixture(every, 0).ones()
    for context in (0, ord("a") << 8 | ord("b") << 16, ord("z") << 8):
        p = 10 ** ctw.log10([x[0] for x in every], one, np.array([context | b for b in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1)


def _bytes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_scores_awkward(spark, odd, nothing, clashing):
    out = ctw.score(odd, odd)
    assert out.count() == odd.count()
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out.collect())
    assert ctw.score(nothing, odd).count() == 0
    untrained = ctw.score(odd.filter("doc_id = 7"), nothing).first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0 and untrained.bits_per_byte == pytest.approx(8)
    assert by_id(ctw.score(clashing, clashing), "n_tokens") == by_id(out, "n_tokens")


def test_a_condition_is_like_its_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    learn = F.col("doc_id") % 3 != 0
    assert by_id(ctw.score(docs, learn), "base_score", "n_known") == by_id(ctw.score(docs, docs.filter(learn)), "base_score", "n_known")
    a, b = (dict(x.select("doc_id", "score").collect()) for x in (ctw.score(docs, learn, often=1000), ctw.score(docs, docs.filter(learn))))
    assert all(a[i] == pytest.approx(b[i]) for i in b) and len(a) == len(b)


def test_scores_of_the_table_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text[:400]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    brute = BruteTree([t for i, t in docs if i % 4], ctw.DEPTH)
    for r in ctw.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 4 != 0, often=500).collect():
        assert r.score == pytest.approx(brute.log10(dict(docs)[r.doc_id]), rel=1e-9)


def test_scores_held_out(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in ctw.query(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.n_bytes == len((docs[r.doc_id] or "").encode())
