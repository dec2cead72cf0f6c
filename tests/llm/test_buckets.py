"""Entries on their way to buckets: packed and unpacked, each hash in one bucket, few rows, shared hashes found."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from foldmeter.llm import bytes as byte_module
from foldmeter.llm import jaccard
from foldmeter.llm.buckets import HELD, buckets_of, packed, unpacked


def _tables(columns, by, widths, buckets):
    cuts = [0, 10, 10, 4000, len(columns[0])]
    sent = list(packed(([c[i:j] for c in columns] for i, j in zip(cuts, cuts[1:])), by, widths, buckets))
    return pa.Table.from_batches(sent) if sent else pa.table({"bucket": [], "n": [], "packed": []})


def test_entries_arrive_once_and_equal_hashes_meet():
    rng = np.random.default_rng(3)
    key = rng.choice(rng.integers(0, 1 << 64, 3000, np.uint64), 20_000)
    row = np.sort(rng.integers(-(1 << 62), 1 << 62, 20_000)).view(np.uint64)
    for buckets in (1, 7, 70_000):
        table = _tables([row, key], 1, [8, 8], buckets)
        assert table.num_rows <= min(buckets * (1 + len(key) // HELD), len(key))
        seen, got = {}, []
        for b in set(table["bucket"].to_pylist()):
            r, k = unpacked(table.filter(pa.compute.equal(table["bucket"], b)), [8, 8])
            assert all(seen.setdefault(x, b) == b for x in k.tolist())
            got += zip(r.tolist(), k.tolist())
        assert sorted(got) == sorted(zip(row.tolist(), key.tolist()))
    assert _tables([row[:0], key[:0]], 1, [8, 6], 3).num_rows == 0


def test_buckets_follow_the_entries():
    assert [buckets_of(n, 200) for n in (0, 1, 1 << 17, 1 << 27, 1 << 32)] == [1, 1, 2, 200, 1 << 12]


def test_sets_meet_at_the_smallest_of_a_key():
    rng = np.random.default_rng(4)
    names = rng.integers(0, 1 << 64, 400, np.uint64)
    key, row = rng.choice(names, 900), np.sort(rng.integers(0, 60, 900)) + (5 << 33)
    want = set()
    for k in set(key.tolist()):
        rows = row[key == k]
        want |= {(int(r), int(rows.min())) for r in rows} if rows.min() < rows.max() else set()
    got = jaccard._met(_tables([row.view(np.uint64), key], 1, jaccard.ENTRY, 1))
    assert sorted(zip(got["node"].to_pylist(), got["leader"].to_pylist())) == sorted(want)


def test_long_form_of_keys_is_not_shuffled(spark, monkeypatch):
    """With no side small enough to broadcast, keys still go to their buckets once, packed, and come back as pairs of sets."""
    made = []
    monkeypatch.setattr(jaccard, "broadcast_if_small", lambda df, **_: df)
    cut = jaccard.cut_lineage
    monkeypatch.setattr(jaccard, "cut_lineage", lambda df: made.append(df) or cut(df))
    words = [f"w{i * i % 101}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(words[: 190 + i % 4])) for i in range(12)] + [(20, "other words here")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.ngram_jaccard(docs).collect()}
    assert got == {i: (0, 11) for i in range(12)} | {20: (20, 0)}
    assert not any("key" in df.columns for df in made)


def test_segments_are_settled_in_their_bucket():
    """Anchors of one document go; of equal segments all but the earliest id's are hits; different ones stay open with their number."""
    rng = np.random.default_rng(5)
    n = 4000
    own = np.sort(rng.integers(-3, 40, n))
    anchor = rng.choice(rng.integers(0, 1 << 64, 700, np.uint64), n)
    value = rng.integers(0, 3, n).astype(np.uint64) + np.uint64(1 << 63)
    place = (rng.integers(0, 1 << 31, n) * byte_module.PLACE + rng.integers(0, byte_module.LONGEST, n)).view(np.uint64)
    mark = own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    by = {}
    for i in range(n):
        by.setdefault(int(anchor[i]), []).append(i)
    want = []
    for rows in by.values():
        if len({own[i] for i in rows}) < 2:
            continue
        least, values = {}, {int(value[i]) for i in rows}
        for i in rows:
            least[int(value[i])] = min(least.get(int(value[i]), 1 << 62), int(own[i]))
        for i in rows:
            m = 0 if own[i] > least[int(value[i])] else len(values)
            if m != 1:
                pos, more = divmod(int(place[i]), byte_module.PLACE)
                want.append((int(own[i]), int(mark.view(np.int64)[i]), pos, more + 1, m))
    table = _tables([own.view(np.uint64), mark, anchor, value, place], 2, byte_module.ENTRY, 5)
    got, names = [], set()
    for b in range(5):
        out = byte_module._settled(table.filter(pa.compute.equal(table["bucket"], pa.scalar(b, pa.int32()))))
        got += zip(*(out[c].to_pylist() for c in ("id", "mark", "pos", "n", "m")))
        assert not names & set(out["anchor"].to_pylist())
        names |= set(out["anchor"].to_pylist())
    assert sorted(got) == sorted(want)


def test_texts_are_read_once_for_segments(spark, monkeypatch):
    """With no side small enough to broadcast, texts meet sides only for open segments, not for the anchors that documents share."""
    joined = []
    monkeypatch.setattr(byte_module, "broadcast_if_small", lambda df, **_: joined.append(df.columns) or df)
    passage = "a passage of some length that stands in every one of these texts, letter by letter "
    docs = spark.createDataFrame([(i, f"{i} " * i + passage) for i in range(6)] + [(9, "z" * 70), (10, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in byte_module.byte_dedup(docs).collect()}
    shared = len(passage) + 1  # the blank before it, from the second text with one on
    assert got == {0: (83, 0), 1: (85, 83), 9: (70, 0), 10: (0, 0)} | {i: (83 + 2 * i, shared) for i in range(2, 6)}
    assert not any("shared" in columns for columns in joined)
