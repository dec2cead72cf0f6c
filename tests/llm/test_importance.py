"""Importance resampling against plain Python, and odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from foldmeter.llm.importance import BLOCK, _bits, bucket_gains, count_planes, gain_planes, gain_sums, importance_resample

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, id string, n_words string, weight string, position long, score string, rank string"


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(FOLD))
    return len(words), [zlib.crc32(f) % 10000 for f in [*words, *(a + b" " + b for a, b in zip(words, words[1:]))]]


def expected(docs, target, percent=25, least_words=20, seed=7):
    of = [(i, *features(t)) for i, t in docs]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, _, f in of:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gains = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + 10000) / ((int(s[b]) + 1) * (int(t.sum()) + 10000)))) for b in range(10000)]
    rows = {}
    for i, n, f in of:
        weight = sum(gains[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows[i] = (n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    order = sorted((i for i, r in rows.items() if r[0] >= least_words), key=lambda i: (-rows[i][3], i))
    rank = {i: k + 1 for k, i in enumerate(order[: percent * len(order) // 100])}
    return {i: (*r[1:], rank.get(i)) for i, r in rows.items()}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in importance_resample(docs, target).collect()}
    assert got == want and sum(x[3] is not None for x in want.values()) > 20


def test_odd_rows(spark):
    texts = [None, "", " .,! ", "One", "É x-É x", "word " * 3000, "w" * 5000 + " " + "z" * 5000, *(f"tie {i % 3} " * 15 for i in range(30))]
    rows = [(i, t, "a", "b", "c", 1, "d", "e") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, "word " * 40, *rows[0][2:])], SCHEMA)
    target = spark.createDataFrame([("one tie word 1",), (None,), ("",)], "text string")
    got = importance_resample(docs, target, percent=60).collect()
    assert len(got) == len(texts) + 2
    drawn = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert drawn == list(range(1, 60 * 32 // 100 + 1))
    for r in got:
        n, f = features("word " * 40 if r.doc_id is None else texts[r.doc_id])
        assert r.n_features == len(f) and (f or r.weight == 0)
    again = importance_resample(docs.repartition(7), target, percent=60).collect()
    assert {(r.doc_id, r.score, r["rank"]) for r in again} == {(r.doc_id, r.score, r["rank"]) for r in got}
    assert importance_resample(docs.limit(0), target).count() == 0
    assert importance_resample(docs, target.limit(0)).count() == len(got)


@pytest.mark.parametrize("buckets", [1, 63, 64, 10000])
def test_planes(buckets):
    rng = np.random.default_rng(buckets)
    docs = BLOCK + 5
    gains = rng.integers(-9000, 9000, buckets)
    doc, bucket = rng.integers(0, docs, 40000), rng.integers(0, buckets, 40000)
    bucket[:20000] = bucket[0]  # counts of many bits
    doc[:9000] = 3
    want = np.zeros(docs, np.int64)
    np.add.at(want, doc, gains[bucket])
    assert (gain_sums(doc, bucket, docs, *gain_planes(gains), buckets) == want).all()
    counts = np.array([5, 2], np.int64)
    planes = list(count_planes(np.array([0, 1]), np.array([0, buckets - 1]), counts, 2, buckets))
    flags = np.zeros((2, buckets), bool)
    flags[0, 0] = True
    assert (planes[0] == _bits(flags, buckets)).all() and len(planes) == 3


def test_gains_of_nothing():
    assert (bucket_gains(np.zeros(10, np.int64), np.zeros(10, np.int64)) == 0).all()
