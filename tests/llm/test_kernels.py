"""Array kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import kernels as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(3)
ALPHABET = "ab \t\n\x0b\x0cé€\U0001d11e\x1c\x85\xa0"
TEXTS = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 30))) for _ in range(800)] + [None, "", " ", "a"]


@pytest.mark.parametrize("texts", [pa.array(TEXTS), pa.array(["zz", *TEXTS]).slice(1), pa.array(["", "", None], pa.string()), pa.array([], pa.string())])
def test_words(texts):
    raw, offsets = K.text_bytes(texts)
    w = K.words(raw, offsets)
    want = [WORD.findall(t or "") for t in texts.to_pylist()]
    got = [[raw[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.row_start[:-1], w.row_start[1:], strict=True)]
    assert got == want
    seen = {}
    for word, h in zip((x for t in want for x in t), w.hashes(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    j = K.joined(w)
    assert (j.hashes() == w.hashes()).all()
    for i, t in enumerate(want):
        if t:
            assert j.buf[j.start[j.row_start[i]] : j.end[j.row_start[i + 1] - 1]].tobytes().decode() == " ".join(t)
    assert len(K.runs(w.row_start, 3)) == sum(max(0, len(t) - 2) for t in want)


def test_hashes_of_long_slices(monkeypatch):
    raw = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    start, end = np.arange(0, 4000, 7), np.arange(0, 4000, 7) + 900
    whole = K.slice_hashes(raw, start, end)
    monkeypatch.setattr(K, "_SPAN", 64)
    assert (K.slice_hashes(raw, start, end) == whole).all()
    assert (K.slice_hashes(raw, start, np.stack([end, start + 3]))[0] == whole).all()


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c"])], names=["t"])
    assert [b.num_rows for b in K.batches_of(iter([batch]), "t", 20)] == [2, 1, 1]
    assert [b.num_rows for b in K.batches_of(iter([batch]), "t", 1000)] == [4]
