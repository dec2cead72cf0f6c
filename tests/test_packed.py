"""Packed term counts and rare features."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmeter.functions.text import tokens
from foldmeter.operators import packed, quantiles, text
from tests.test_order import plan


def texts(spark, rows):
    return spark.createDataFrame(rows, "row_id long, text string, fold int")


ROWS = [(1, "a b a\x1cc", 0), (2, " \t", 1), (3, None, 0), (4, "b  b\nd\x85e", 1), (5, "A a", 2), (None, "z z a", 2)]


def test_packed_counts_are_those_of_the_tokens(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_ENTRIES", 2)
    df = texts(spark, ROWS)
    p = packed.PackedTerms.of(df, "text", keep=("fold",), folds=3)
    want = df.select("row_id", "fold", F.explode(tokens(F.col("text"))).alias("term"))
    got = {r.term: (list(r.dfs), r.n) for r in p.totals(3).collect()}
    counts = {}
    for r in want.collect():
        dfs, n = counts.setdefault(r.term, [[set(), set(), set()], 0])
        dfs[r.fold].add(r.row_id)
        counts[r.term][1] = n + 1
    assert got == {t: ([len(s) for s in dfs], n) for t, (dfs, n) in counts.items()}
    assert p.unique and p.rows.select("chunk").distinct().count() > 1
    twice = packed.PackedTerms.of(df.unionAll(df.filter("row_id = 4")), "text")
    assert not twice.unique


@pytest.mark.parametrize("norm", ["l1", "l2", None])
def test_rows_are_weighed_and_normed_by_row_id(spark, monkeypatch, norm):
    monkeypatch.setattr(packed, "CHUNK_ENTRIES", 3)
    for rows in (ROWS, ROWS + [(4, "a q", 0)]):
        df = texts(spark, rows)
        model = text.Tfidf.fit(df, norm=norm)
        idf = {r.feature_ix: (r.term, r.idf) for r in model.vocab.collect()}
        got = sorted((str(r.row_id), idf[r.feature_ix][0], r.value) for r in model.transform(df).collect())
        weighed = []
        for i, t, _ in rows:
            words = (t or "").split()
            weighed += [(i, w, words.count(w) * next(x for y, x in idf.values() if y == w)) for w in set(words)]
        power = {"l1": abs, "l2": lambda v: v * v, None: lambda v: 0.0}[norm]
        size = {i: sum(power(v) for j, _, v in weighed if j == i) for i, _, _ in weighed}
        length = {i: (math.sqrt(s) if norm == "l2" else s) or 1.0 for i, s in size.items()}
        want = sorted((str(i), w, v / length[i]) for i, w, v in weighed)
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_only_terms_of_a_chunk_meet_the_vocabulary(spark, tmp_path):
    """Entries used to be shuffled by their term and again by their row."""
    spark.range(2000).select(F.col("id").alias("row_id"), F.lit("a b a c " * 20).alias("text")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    model = text.Tfidf.fit(df)
    p = plan(model.transform(df))
    assert "FlatMapCoGroupsInArrow" in p and "Window" not in p
    assert model.packed.terms.count() < 200  # 6,000 entries


def test_rare_features_are_not_put_in_order(spark, monkeypatch):
    rows = [(i, 0, 1.0 + i) for i in range(90)] + [(i, j, -1.0) for j in range(1, 30) for i in range(3)]
    entries = spark.createDataFrame(rows, "row_id long, feature_ix int, value double")
    seen, place = [], quantiles.with_positions
    monkeypatch.setattr(quantiles, "with_positions", lambda df, *a, **k: seen.append(df.count()) or place(df, *a, **k))
    got = {r.feature_ix: r.q for r in quantiles.sparse_quantiles(entries, 100, [0.25, 0.5, 0.75]).collect()}
    dense = np.zeros((100, 30))
    for i, j, v in rows:
        dense[i, j] = v
    assert set(got) == set(range(30)) and seen == [90]
    assert all(got[j] == pytest.approx(np.quantile(dense[:, j], [0.25, 0.5, 0.75])) for j in got)


def test_chunks_without_a_known_term(spark):
    rows = [(i, i % 3, 0, "a b") for i in range(6)]
    df = spark.createDataFrame(rows, "row_id long, fold int, label_ix int, text string")
    model = text.Tfidf.fit(df)
    other = spark.createDataFrame([(9, 0, 0, "z z"), (10, 0, 0, None)], df.schema)
    assert model.transform(other).count() == 0
    folds = text.TfidfFolds.fit(df.withColumn("text", F.col("row_id").cast("string")), 3, "text")
    assert folds.test().count() == 0 and folds.train().count() == 6
