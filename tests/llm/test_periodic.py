"""Periodic runs against brute force over every period, tiles of all sizes, odd rows, the registered query."""

import hashlib
import random
import re
import zlib

import pytest

from foldmeter.llm.periodic import periodic_runs, tiles_of, z_function
from foldmeter.llm.queries import QUERIES


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(words):
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(6, 4 * q):
                best.setdefault((a, i - a + q), q)
            i += 1
    return sorted((a, length, q) for (a, length), q in best.items())


def collapsed(words, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def mixed(rng):
    words = []
    for _ in range(rng.randrange(7)):
        unit = [str(rng.randrange(rng.choice([2, 3, 60]))) for _ in range(rng.randrange(1, 22))]
        words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 160)] if rng.random() < 0.6 else unit
    return " ".join(words)


def test_z_function():
    rng = random.Random(2)
    for _ in range(50):
        x = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        z = z_function(x, len(x))
        for i in range(1, len(x)):
            k = 0
            while i + k < len(x) and x[k] == x[i + k]:
                k += 1
            assert z[i] == k


@pytest.mark.parametrize(("n", "tile_words"), [(5, 16), (6, 16), (1000, 16), (100_000, 4096), (70_000, 64)])
def test_tiles_hold_every_stretch(n, tile_words):
    tiles = list(tiles_of(n, tile_words))
    q = 1
    while 4 * q <= n and n >= 6:
        of = [(a, b) for lo, hi, a, b in tiles if lo <= q <= hi]
        need = min(n, max(6, 4 * (2 * q - 1)))
        assert of[0][0] == 0 and of[-1][1] == n and all(b - c >= need for (_, b), (c, _) in zip(of, of[1:]))
        q *= 2


@pytest.mark.parametrize("tile_words", [16, 64, 4096])
def test_brute_force(spark, tile_words):
    rng = random.Random(tile_words)
    texts = [None, "", " \t\n", "a", "x " * 5, "x " * 6, "x " * 700, "p q " * 300 + "p", "é\x0bé " * 9, "w\xa0w " * 6, *(mixed(rng) for _ in range(150))]
    long = " ".join(f"u{i}" for i in range(200))
    texts += [f"{long} " * 9 + "end", long]
    rows = [(i, t, "k", "r", 1) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (6, "z " * 9, "k", "r", 1), (None, "y " * 8, "k", "r", 1), (None, "y " * 8, "k", "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, runs string, n_words long")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs(docs, tile_words=tile_words).collect()), key=str)
    want = [(i, len(words_of(t)), brute(words_of(t)), collapsed(words_of(t), brute(words_of(t)))) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        words = words_of(doc.text)
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[doc.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{length},{q}\n" for a, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
