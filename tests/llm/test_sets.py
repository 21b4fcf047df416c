"""Near duplicates, decontamination, line chunks, shards, mixtures, pages and the pipeline: brute force, awkward rows."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, frames, html, linechunks, mixture, shard, simhash, similar
from tessera.plans.lineage import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# near duplicates


def fingerprint(text):
    w = WORD.findall(lowered(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(points, linked):
    parent = {p: p for p in points}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(points, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_masks_cover_every_pair():
    for radius in (1, 2, 4):
        family = simhash.masks(radius)
        rng = random.Random(radius)
        for _ in range(5000):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & bits for m in family)


def test_groups_against_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.filter("doc_id IS NOT NULL").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp = {i: fingerprint(t) for i, t in texts.items()}
    name = classes(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = {(r.doc_id, r._fp % (1 << 64), r._component) for r in simhash.groups(docs).collect()}
    assert got == {(i, fp[i], name[i]) for i in fp}


@pytest.mark.parametrize("block", [3, 2048])
def test_links_of_a_dense_ball(spark, block):
    """Many points near one another, so that buckets are split into blocks; components stay exact."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    points = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    want = classes(signed, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4)
    df = spark.createDataFrame([(p,) for p in signed], "_fp long")
    stars = {r._u: r._v for r in simhash.components(simhash.link(df, block=block)).collect()}
    assert {p: stars.get(p, p) for p in signed} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "_u long, _v long")
    assert {r._v for r in simhash.components(edges).collect()} == {0}


def test_dedup_awkward(spark, odd, nothing, clashing):
    kept = simhash.dedup(odd)
    # 1, 2, 3 and one without an id have no words; 5 stands twice and 6 is a copy of it
    assert rows(kept, "doc_id") == sorted([(1,), (4,), (5,), (7,), (None,)], key=repr)
    assert simhash.dedup(nothing).count() == 0 and simhash.dedup(nothing).columns == nothing.columns
    again = simhash.dedup(clashing)
    assert again.columns == clashing.columns and rows(again, "doc_id") == rows(kept, "doc_id")


def shingles(text):
    w = WORD.findall(lowered(text))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies(rng):
    """Texts with copies in which some words are changed, so that similarities lie on both sides of 0.8."""
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    for i in range(60):
        w = [word() for _ in range(rng.randint(30, 300))]
        yield " ".join(w)
        for _ in range(i % 4):
            at = set(rng.sample(range(len(w)), max(1, int(len(w) * rng.choice([0.01, 0.02, 0.025, 0.04])))))
            yield " ".join(word() if j in at else x for j, x in enumerate(w))


def test_pipeline_near_duplicates_against_brute_force(spark, sf):
    texts = dict(enumerate(near_copies(random.Random(8))))
    sets = {i: shingles(t) for i, t in texts.items()}
    name = classes(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for how in ({}, {"block": 2}, {"room": 500}):
        assert {r.doc_id for r in similar.dedup(docs, **how).collect()} == set(name.values())
    left = [sets[r.doc_id] for r in corpus_pipeline.near_duplicates_out(spark, docs, sf).collect()]
    assert all(jaccard(a, b) < 0.8 for a, b in itertools.combinations(left, 2))


def test_what_goes_to_every_task_is_bounded_in_rows_and_bytes(spark):
    named = spark.createDataFrame([(1, "aa", "é"), (2, None, None)], "_key long, _s string, _t string")
    assert frames.few(named, 2, 4) and not frames.few(named, 2, 3) and not frames.few(named, 1, 4)
    assert frames.few(named.select("_key"), 2, 0) and frames.few(named.filter("_key > 2"), 2, 0)


def test_near_copies_in_blocks():
    rng = random.Random(9)
    base = np.array(sorted(rng.sample(range(1 << 40), 200)), np.uint64)
    sets = [np.sort(np.concatenate([base[rng.sample(range(200), 190)], np.array(rng.sample(range(1 << 41, 1 << 42), rng.choice([2, 60])), np.uint64)])) for _ in range(40)]
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    edges = similar.forest(sets, 0.8)
    linked = {frozenset(e) for e in edges}
    assert all(alike(a, b) for a, b in edges)
    assert classes(range(40), alike) == classes(range(40), lambda a, b: frozenset((a, b)) in linked)


def test_near_copies_awkward(spark, odd, nothing, clashing):
    kept = similar.dedup(odd)
    assert rows(kept, "doc_id") == sorted([(1,), (4,), (5,), (7,), (None,)], key=repr)
    assert similar.dedup(nothing).count() == 0
    again = similar.dedup(clashing)
    assert again.columns == clashing.columns and rows(again, "doc_id") == rows(kept, "doc_id")
    one_id = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v"), (0, "a b c d e f")], "doc_id long, text string")
    assert rows(similar.dedup(one_id), "doc_id", "text") == [(0, "a b c d e f"), (1, "q r s t u v")]


def test_dedup_tells_rows_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (1, "other words that are near no text"), (0, "alpha beta gamma delta epsilon")], "doc_id long, text string")
    assert rows(simhash.dedup(docs), "doc_id", "text") == [(0, "alpha beta gamma delta epsilon"), (1, "other words that are near no text")]


@pytest.mark.parametrize("dedup", [simhash.dedup, similar.dedup])
def test_dedup_keeps_one_defined_row(spark, dedup):
    text = "one text that stands in several rows of the table"
    rest = [(None, text, "a"), (3, text, "b"), (3, text, "c"), (3, text, "c"), (4, "another text that is near to nothing else", "d"), (4, "another text that is near to nothing else", "d")]
    kept = [rows(dedup(spark.createDataFrame(part, "doc_id long, text string, lang string")), "doc_id", "lang") for part in (rest, rest[::-1], rest[3:] + rest[:3])]
    assert kept[0] == kept[1] == kept[2] and kept[0][1] == (4, "d") and kept[0][0] in [(3, "b"), (3, "c")] and len(kept[0]) == 2
    alone = spark.createDataFrame([(None, text, "a"), (None, None, "b"), (None, "", "c")], "doc_id long, text string, lang string")
    assert dedup(alone).count() == 2


# decontamination

PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards brew quite potent mixtures in glass jars"


def variants():
    w = PASSAGE.split()
    swap = lambda *at: " ".join("swapped" if i in at else x for i, x in enumerate(w))
    filler = "some words that have nothing to do with any of the benchmark items at all but are here to fill space"
    yield "exact", f"{filler} {PASSAGE}. {filler}", True
    yield "case and marks", f"{filler}\n{PASSAGE.upper().replace(' ', ', ')}", True
    yield "two substitutions", f"{filler} {swap(4, 11)} {filler}", True
    yield "three substitutions", f"{filler} {swap(2, 9, 16)}", True
    yield "part", f"{filler} {' '.join(w[3:16])} {filler}", True
    yield "too short a part", f"{filler} {' '.join(w[3:11])} {filler}", False
    yield "too many substitutions", swap(*range(0, 19, 3)), False
    yield "clean", filler, False
    yield "short item", "before tiny but whole item here after", True
    yield "short item changed", "before tiny but other item here after", False


def test_decontamination(spark, odd):
    items = [(1, PASSAGE), (2, "Tiny but whole item here"), (3, "too short"), (4, None), (5, ""), (None, PASSAGE)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    cases = list(variants())
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(cases)], "doc_id long, text string")
    for most in (decontaminate.BLOCK_BYTES, 40):
        found = {r.doc_id: list(r._items) for r in decontaminate.scan(docs, benchmark, most=most).collect()}
        for i, (name, _, hit) in enumerate(cases):
            assert bool(found[i]) == hit, name
    assert decontaminate.clean(odd, benchmark).count() == odd.count()
    assert decontaminate.scan(odd, benchmark.limit(0)).filter("size(_items) > 0").count() == 0


def test_overlap_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(12, 40)
        own = [rng.choice("abcdefgh") + str(i) for i in range(n)]
        doc = [x if rng.random() < rng.choice([0.5, 0.8, 0.95]) else "zz" for x in own]
        block = decontaminate.Block([0], pa.array([" ".join(own)]))
        tokens, start = decontaminate._tokens(pa.array([" ".join(doc)]))
        same = [a == b for a, b in zip(own, doc, strict=True)]
        best = max((j - i for i in range(n) for j in range(i + 1, n + 1) if same[i] and same[j - 1] and sum(same[i:j]) >= 0.8 * (j - i) - 1e-9), default=0)
        assert block.overlap(tokens, start, 0, 0, 0) == (best if best >= 12 else 0)


@pytest.mark.parametrize("n", range(12, 21))
def test_every_stretch_at_the_bound_is_found(n):
    """Any choice of as many substituted tokens inside the stretch as four fifths allow."""
    own = [f"item{i}" for i in range(n)]
    block = decontaminate.Block([7], pa.array([" ".join(own)]))
    choices = list(itertools.combinations(range(1, n - 1), n // 5))
    texts = [" ".join(["before", *("zz" if i in at else x for i, x in enumerate(own)), "after"]) for at in choices]
    assert all(found == [(7, n)] for found in block.found(pa.array(texts)))


def test_repeated_tokens_name_every_alignment(spark):
    rng = random.Random(5)
    own = [" ".join(rng.choices("ab", k=40)), "a " * 30 + "b", "x y " * 12, " ".join(f"t{i}" for i in range(20))]
    texts = [" ".join(rng.choices("abxy", [9, 2, 1, 1], k=rng.randint(0, 90))) for _ in range(20)] + ["a " * 300, "y x " * 40, own[3]]
    block = decontaminate.Block([0, 1, 2, 3], pa.array(own))
    tokens, start = decontaminate._tokens(pa.array(texts))
    want = set()
    for (row, t), (item, o) in itertools.product(enumerate(texts), enumerate(own)):
        t, o = t.split(), o.split()
        for mask in decontaminate.MASKS:
            at = [i for i, c in enumerate(mask) if c == "1"]
            for i, j in itertools.product(range(len(t) - len(mask) + 1), range(len(o) - len(mask) + 1)):
                if all(t[i + k] == o[j + k] for k in at):
                    want.add((row, item, start[row] + i - block.row_start[item] - j))
    assert {tuple(x) for x in block.hits(tokens, start).tolist()} == want
    whole = decontaminate.Block([0], pa.array(["same " * 300])).found(pa.array(["same " * 100_000]))
    assert whole == [[(0, 300)]]


def test_items_of_any_type_in_blocks(spark, clashing):
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(variants())] * 2, "doc_id long, text string").withColumn("_items", F.lit("own"))
    benchmark = spark.createDataFrame([("p", PASSAGE), ("q", PASSAGE), ("short", "Tiny but whole item here"), (None, PASSAGE)], "item_id string, text string")
    one, many = (decontaminate.scan(docs, benchmark, most=m) for m in (decontaminate.BLOCK_BYTES, 40))
    assert one.columns == many.columns == ["doc_id", "text", "_items_", "_items", "_overlap"]
    assert rows(one, "doc_id", "_items", "_overlap", "_items_") == rows(many, "doc_id", "_items", "_overlap", "_items_")
    assert one.filter("size(_items) = 2").count() and one.count() == docs.count()


def test_decontamination_of_the_tables(spark, sf):
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: " ".join(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = {i for i, t in texts.items() if any(x in t for x in items)}
    found = {r.doc_id for r in decontaminate.query(spark, sf).filter("contaminated").collect()}
    assert whole <= found and len(found - whole) <= 0.02 * len(texts)


def test_decontamination_keeps_columns(spark, clashing, nothing):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    kept = decontaminate.clean(clashing, benchmark)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    assert decontaminate.clean(nothing, benchmark).count() == 0


# line chunks


def brute_chunks(texts):
    """What is left of each (id, text), by chunks' bytes alone."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        lines, kept = t.split("\n"), []
        _, first, n, *_ = linechunks.chunks(pa.array([t]))
        for f, k in zip(first.tolist(), n.tolist(), strict=True):
            chunk = "\n".join(lines[f : f + k])
            if k >= 2 and len(chunk.encode()) >= k:
                if chunk in seen:
                    continue
                seen.add(chunk)
            kept += lines[f : f + k]
        out[i] = "\n".join(kept)
    return out


def test_line_chunks_against_brute_force(spark, sf):
    rng = random.Random(4)
    lines = [f"line {i} of it" for i in range(60)]
    passage = [f"shared {i}" for i in range(12)]
    texts = {i: "\n".join([*rng.choices(lines, k=rng.randint(0, 8)), *(passage if i % 3 == 0 else []), *rng.choices(lines, k=rng.randint(0, 8))]) for i in range(200)}
    texts |= {r.doc_id + 1000: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is not None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linechunks.without_repeats(docs, whole=False).collect()}
    assert got == brute_chunks(texts)
    assert sum(got[i].count("shared") for i in range(200)) < 0.5 * sum(t.count("shared") for i, t in texts.items() if i < 200)


def test_short_passages_go_whole(spark):
    """Passages of two to six lines, and one long line, that stand a second time between other neighbours."""
    rng = random.Random(6)
    own = lambda n: [f"own line {rng.getrandbits(60)}" for _ in range(n)]
    texts, want = {}, {}
    for i in range(150):
        passage = own(2 + i % 5)
        a, b, c, d = ([] if rng.random() < 0.2 else own(rng.randint(1, 5)) for _ in range(4))
        texts[i] = want[i] = "\n".join(a + passage + b)
        texts[1000 + i], want[1000 + i] = "\n".join(c + passage + d), "\n".join(c + d)
    long = " ".join(own(1)[0] for _ in range(20))
    texts |= {1500: f"a\n{long}\nb", 1501: f"c\n{long}\nd"}
    want |= {1500: f"a\n{long}\nb", 1501: "c\nd"}
    texts |= {2000: "x\nx\nx", 2001: "y\nz\ny\nz\ny"}
    want |= {2000: "x\nx\nx", 2001: "y\nz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in linechunks.without_repeats(docs, whole=True).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r._removed == r._lines - (len(want[i].split("\n")) if want[i] else 0) for i, r in got.items())


def test_chunks_hold_all_lines():
    texts = ["", "\n", "a", "a\nb\nc", "\n".join(map(str, range(500))), "\n" * 300]
    row, first, n, *_ = linechunks.chunks(pa.array(texts))
    for i, t in enumerate(texts):
        at = row == i
        assert n[at].sum() == len(t.split("\n")) and n[at].max() <= linechunks.MOST
        assert first[at].tolist() == [0, *np.cumsum(n[at])[:-1].tolist()]


def test_chunks_of_a_passage_are_the_same_anywhere():
    rng = random.Random(3)
    passage = [f"line {rng.random()}" for _ in range(200)]
    inner = []
    for before in range(40):
        t = "\n".join([f"other {rng.random()}" for _ in range(before)] + passage)
        _, first, n, *_ = linechunks.chunks(pa.array([t]))
        inner.append({(f - before, k) for f, k in zip(first.tolist(), n.tolist(), strict=True) if f > before + 1})
    common = set.intersection(*inner)
    assert sum(n for _, n in common) > 180 and all(i - common <= {min(i)} for i in inner)


def test_line_chunks_awkward(spark, odd, nothing, clashing):
    out = linechunks.without_repeats(odd)
    assert out.count() == odd.count()
    got = {(r.doc_id, r.text, r._removed) for r in out.collect()}
    assert (1, None, 0) in got and (2, "", 0) in got
    same = "Same text in two rows, here and there.\nSecond line of it."
    assert (5, same, 0) in got and (6, "", 2) in got  # the copy goes, repeated rows of one document stay
    assert linechunks.without_repeats(nothing).count() == 0
    again = linechunks.without_repeats(clashing)
    assert rows(again, "doc_id", "text") == rows(out, "doc_id", "text") and len(set(again.columns)) == len(again.columns)


# shards


def test_shards_against_oracle(spark, sf):
    got = shard.query(spark, "/root/testdata/sf0.01").toPandas()
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(shard.ORACLE).df()
    names = list(want.columns)
    assert sorted(map(tuple, got[names].values)) == sorted(map(tuple, want[names].values))


@pytest.mark.parametrize("limit", [50, 400, 3000])
def test_shards_split_only_when_too_big(spark, limit):
    docs = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(700)], "doc_id long, text string")
    r = shard.assign(docs, limit).collect()
    size, shards = collections.Counter(), collections.defaultdict(set)
    for x in r:
        size[x.shard] += x.n_bytes
        shards[x.shard].add(x.doc_id)
    assert len(r) == 700 and all(size[x.shard] == x.shard_bytes and len(shards[x.shard]) == x.shard_docs for x in r)
    assert all(size[s] <= limit or len(shards[s]) == 1 for s in size)
    for s in size:  # what was split had to be
        if len(s) > 1:
            parent = s[:-1]
            assert sum(size[o] for o in size if o.startswith(parent)) > limit
    d = shard.directory(shard.assign(docs, limit)).collect()
    slots = sorted((x.first_slot, x.slots) for x in d)
    ends = [a + n for a, n in slots]
    assert all(b >= a for a, (b, _) in zip(ends, slots[1:], strict=False))


def test_shards_overflow_and_awkward(spark, odd, nothing, clashing):
    same = spark.createDataFrame([(1, "x" * 30) for _ in range(10)], "doc_id long, text string")
    r = shard.assign(same, 100).collect()
    assert sorted(collections.Counter(x.shard for x in r).values()) == [1, 3, 3, 3]
    assert all(x.shard_bytes == 30 * x.shard_docs <= 100 for x in r)
    one_key = spark.createDataFrame([(None, f"text {i}") for i in range(200)], "doc_id long, text string")
    size = collections.Counter()
    for x in shard.assign(one_key, 100).collect():
        size[x.shard] += x.n_bytes
    assert sum(size.values()) == sum(len(f"text {i}") for i in range(200)) and max(size.values()) <= 100
    assert shard.assign(nothing, 100).count() == 0
    out = shard.assign(odd, 100)
    assert out.count() == odd.count()
    assert rows(shard.assign(clashing, 100), "doc_id", "shard") == rows(out, "doc_id", "shard")


def test_shards_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(40)], "doc_id long, text string")
    shard.write(docs, str(tmp_path / "out"), 500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and all(r.n <= 10 for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect())


# mixtures


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(r):
    sizes, taken = collections.Counter(), collections.Counter()
    for x in r:
        s = None if x._z else x._s
        sizes[s] += x._size
        taken[s] += x._taken
        assert 0 <= x._taken <= 3 * x._size
    target = brute_targets(sizes)
    for x in r:
        s = None if x._z else x._s
        assert x._total == sizes[s] and x._target == pytest.approx(target[s])
        assert abs(taken[s] - target[s]) <= 1


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_mixture(spark, block):
    rng = random.Random(1)
    rows_ = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "a", "b", "é", "z", None, ""])) for i in range(300)]
    rows_ += [(1000, "one two", "tiny"), (1001, "", "none at all"), (1002, None, "none at all")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    r = mixture.taken(docs, block=block).collect()
    assert len(r) == len(rows_)
    assert {(x._key, x._size) for x in r} == {(i, len(WORD.findall(t or ""))) for i, t, _ in rows_}
    check_mix(r)
    again = mixture.taken(docs.repartition(13), block=block).collect()
    assert sorted(map(str, r)) == sorted(map(str, again))


def test_schedule_is_even(spark):
    """Any stretch of the schedule holds sources in proportion to their slots."""
    sizes = {"a": 40_000, "b": 90_000, "c": 60_000}
    plan = mixture.plan(spark.createDataFrame([(s, False, n, float(n), n) for s, n in sizes.items()], "_s string, _z boolean, _total long, _target double, _words long"), 10)
    slots = mixture.schedule(plan, 10).toPandas().sort_values("_at")
    assert slots.groupby("_s")["_take"].sum().to_dict() == sizes
    for lo in range(0, 18_000, 3000):
        part = slots.iloc[lo : lo + 1000]["_s"].value_counts(normalize=True)
        for s, n in sizes.items():
            assert abs(part[s] - n / 190_000) < 0.02


def test_mixture_awkward(spark, odd, nothing, clashing):
    r = mixture.taken(odd).collect()
    assert len(r) == odd.count()
    check_mix(r)
    assert mixture.taken(nothing).count() == 0
    assert mixture.mix(nothing).count() == 0
    out = mixture.mix(clashing)
    assert out.columns == clashing.columns and rows(out, "doc_id") == rows(mixture.mix(odd), "doc_id")


# pages

PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><div id="top-menu"><a href=x>Home</a> <a href=y>News</a></div><header><h1>Site</h1></header>'
    '<div class="wrap"><div class="c1"><h2>A story</h2><p>One paragraph of text that is long enough to count &amp; more.</p><p>Short.<p>Another one,\n long enough,  with a '
    "<a href=z>link</a> in it that goes on.<ul><li>an item</li><li>other item</ul><table><tr><td>cell one<td>cell two</table></div><aside>Side</aside>"
    '<div class="comments"><p>Nice! I like this story and write a very long comment about it here.</p></div></div><form>Name <input></form>'
    '<div class="cookie-notice">We use cookies</div><footer>c 2024</footer><script>if (a<b) "</div>"</script></body></html>'
)


def test_main_text():
    want = "A story\nOne paragraph of text that is long enough to count & more.\nShort.\nAnother one, long enough, with a link in it that goes on.\nan item\nother item\ncell one\ncell two"
    assert html.extract(PAGE) == want


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("  \n", ""), ("<p>", ""), ("plain &lt;text&gt; only", "plain <text> only"), ("<p>a<![if x]>b", "ab"), ("<article><h1>T</h1><p>x<br>y", "T\nx y"), ("<script>only()</script>", ""), ('<div class="ad">Buy</div><article></article>', ""), ('<body class="has-sidebar"><p>x</p><div id=sideBar>y</div>', "x"), ("<div>" * 3000 + "deep", "deep")])
def test_main_text_of_odd_pages(page, text):
    assert html.extract(page) == text


LONG = "Long body of the story. " * 30


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div><h1>Title</h1><p>Intro</p><div>{LONG}</div></div><div>c</div></body>", f"Title\nIntro\n{LONG.strip()}"),
        ("<h1>Top</h1><article><h2>A</h2><p>First story.</article><article><h2>B</h2><p>Second story.</article><div>promo text</div>", "Top\nA\nFirst story.\nB\nSecond story."),
        ('<article><p>A <span class="promotion">great promotion</span> of <b class=ad>ads</b>.</p><p><a href=x>All of it a link</a></p><p>end</article>', "A great promotion of ads.\nAll of it a link\nend"),
        ("<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>The story of this page, a text of some length.</p><div><a>x</a></div><div><a>y</a></div><div><a>z</a></div>", "The story of this page, a text of some length."),
        ("<form><div>The whole page stands in a form.</div><nav>menu</nav><form class=search>Search <input></form></form>", "The whole page stands in a form."),
        ("<main><h1>Head</h1><article><p>Text of it all, quite long and good.</p></article></main>", "Head\nText of it all, quite long and good."),
        ("<article><table>" + "<tr><td>5<td>6" * 9 + "</table><p>after</article>", "5\n6\n" * 9 + "after"),
        ('<main><div class="comment">bad</div></main><div><p>real</p></div>', "real"),
        ('<article><p>Hi</p><article class="comment"><p>What a reader says about it, at some length.</article></article>', "Hi"),
    ],
)
def test_main_text_by_hand(page, text):
    assert html.extract(page) == text


def test_ratios_decide(sf, monkeypatch):
    pages = pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist()
    bare = [p.replace("article>", "div>").replace("nav>", "div>") for p in pages]
    before = [html.extract(p) for p in pages]
    assert [html.extract(p) for p in bare] == before
    monkeypatch.setattr(html, "ratios", lambda lines: np.ones(len(lines)))
    assert all(html.extract(p) != b for p, b in zip(pages, before, strict=True))


def test_pages_of_the_tables(spark, sf):
    import html as entities

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html.query(spark, sf).collect():
        h = pages[r.page_id]
        blocks = re.split(r"</?(?:h1|p)>", h[h.index("<article>") + 9 : h.index("</article>")])
        plain = [" ".join(entities.unescape(re.sub(r"</?\w+>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        assert r.text == "\n".join(b for b in plain if b) and r.n_chars == len(r.text)


def test_pages_awkward(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>" + "long " * 100_000, "y")], "page_id long, url string, html string, _main string")
    out = html.extracted(df).collect()
    assert [len(r._main) for r in sorted(out, key=repr, reverse=False)] in ([0, 499_999], [499_999, 0])
    assert html.extracted(df.limit(0)).count() == 0


# the pipeline


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns, name
        assert after.join(before, "doc_id", "left_anti").count() == 0, name
        if name == "near_duplicates":
            fp = {r.doc_id: fingerprint(r.text) for r in after.collect()}
            assert all((a ^ b).bit_count() > 4 for a, b in itertools.combinations(fp.values(), 2))
        if name == "decontamination":
            assert decontaminate.scan(after, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("size(_items) > 0").count() == 0
        before = after
    placed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert placed.count() == before.count()
    assert rows(corpus_pipeline.run(spark, sf), "doc_id", "shard") == rows(placed, "doc_id", "shard")


def test_pipeline_of_awkward_rows(spark, odd, nothing, clashing, labels, tmp_path):
    """Nulls, empty and long texts, repeated rows and extra columns go through all stages, and an empty table too."""
    benchmark = spark.createDataFrame([(1, PASSAGE), (None, PASSAGE), (2, None)], "item_id long, text string")
    got = {}
    leaked = odd.filter("doc_id = 7").withColumns({"doc_id": F.lit(8).cast("long"), "text": F.lit(f"before {PASSAGE} after")})
    for name, docs in {"odd": odd, "empty": nothing, "clashing": clashing, "repeated": odd.unionAll(odd), "leaked": odd.unionAll(leaked)}.items():
        at = str(tmp_path / name)
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
            df.write.parquet(f"{at}/{table}.parquet")
        before = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = cut(stage(spark, before, at))
            assert before.columns == docs.columns, name
        got[name] = rows(corpus_pipeline.run(spark, at), "doc_id", "n_bytes")
    assert got["empty"] == [] and got["odd"] == got["clashing"] == got["repeated"] == got["leaked"]
    ids = [r[0] for r in got["odd"]]
    assert 1 in ids and not {2, 3, 6, 8} & set(ids)  # one of the texts without words stays, the copy and the passage go


def test_pipeline_without_labels_or_benchmark(spark, odd, labels, tmp_path):
    for table, df in (("documents", odd), ("labels", labels.limit(0)), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 5
