"""Matching statistics over the run-compressed index, against plain search."""

import random

import numpy as np
import pytest

import foldmeter.llm.bytes as byte_module
from foldmeter.llm.runindex import RunIndex, earlier_matches, joined


def laid_out(strings):
    length = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum(length)[:-1]].astype(np.int64), length


def corpus(seed, n):
    r = random.Random(seed)
    base = [bytes(r.choice(b"ab\x00\xff") for _ in range(r.randrange(1, 40))) for _ in range(n // 3 + 1)]
    out = []
    for _ in range(n):
        a, b = r.choice(base), r.choice(base)
        out.append(a[r.randrange(len(a)) :] + b * r.randrange(1, 4))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_long_matches(seed):
    strings, window = corpus(seed, 24), 6
    known, asked = strings[:10], [*strings[10:], b"abc", b"c" * 20, b"x"]
    data, start, length = laid_out(known)
    index = RunIndex(joined(data, start, length)[0])
    data, start, length = laid_out(asked)
    text, at = joined(data, start, length)
    s, p = index.long_matches(text, at, length, window)
    want = [(i, j) for i, x in enumerate(asked) for j in range(len(x) - window + 1) if any(x[j : j + window] in k for k in known)]
    assert list(zip(s.tolist(), p.tolist())) == want


@pytest.mark.parametrize("seed", range(4))
def test_earlier_matches(seed):
    strings, window = corpus(seed, 30), 7
    rank = np.array([i // 2 for i in range(30)])  # pairs of equal rank say nothing about each other
    data, start, length = laid_out(strings)
    s, p = earlier_matches(np.zeros(30, np.int64), rank, data, start, length, window)
    want = {
        (i, j)
        for i, x in enumerate(strings)
        for j in range(len(x) - window + 1)
        if any(x[j : j + window] in strings[k] for k in range(30) if rank[k] < rank[i])
    }
    assert set(zip(s.tolist(), p.tolist())) == want


def test_index_is_compressed_and_small_cases():
    data, start, length = laid_out([b"the same passage of words " * 4] * 50)
    text = joined(data, start, length)[0]
    assert RunIndex(text).runs < len(text) / 20
    none = np.zeros(0, np.int64)
    assert [len(x) for x in earlier_matches(none, none, np.zeros(0, np.uint8), none, none, 50)] == [0, 0]


@pytest.mark.parametrize("variants", [1, 3, 32])
def test_crowded_anchors_give_the_same(spark, monkeypatch, variants):
    """Anchors above the bound are settled window by window; nothing in the result tells."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon"]
    shared = "a passage that many documents of this fixture hold, word by word, "
    texts = [shared[r.randrange(9) :] + " ".join(r.choice(words) for _ in range(12)) + shared * r.randrange(3) for _ in range(30)]
    texts += ["z" * 300, "z" * 200, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(byte_module, "VARIANTS", variants)
    got = {x.doc_id: bytes(x.kept) for x in byte_module.byte_dedup(docs).collect()}
    first = {}
    for d, text in enumerate(texts):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], d) < d:
                gone[i : i + 50] = [True] * 50
        assert got[d] == bytes(x for x, g in zip(raw, gone) if not g), d
