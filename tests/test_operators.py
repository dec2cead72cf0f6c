import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldmeter.functions.numbers import strict_double
from foldmeter.functions.text import tokens
from foldmeter.operators import features, knn, lookup, quantiles, scaling, scores, selection, splits, text
from foldmeter.operators.ranks import rank_by_key, rank_by_text


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokens_like_python(spark):
    texts = ["", "  a  b\tc\n", "no break", "sep\x1cfile wide", "Áno áno"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [t.split() for t in texts]


def test_strict_numbers(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("-2e3",), (".5",), ("nan",), ("1_000",)], "t string")
    got = [r[0] for r in df.select(strict_double(F.col("t"), "t")).collect()]
    assert got[:3] == [1.5, -2000.0, 0.5] and np.isnan(got[3]) and got[4] == 1000.0
    for bad in ("1d", "", "x", "1 2", None):
        with pytest.raises(Exception, match="not a number"):
            spark.createDataFrame([(bad,)], "t string").select(strict_double(F.col("t"), "t")).collect()


def test_ranks_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"row_id": rng.permutation(5000) * 3, "label": np.where(rng.random(5000) < 0.6, "hot", "cold")})
    got = rank_by_key(spark.createDataFrame(pdf), by=["label"], n_buckets=16).toPandas()
    want = got.groupby("label").row_id.rank().astype(int) - 1
    assert (got["rank"] == want).all()
    assert (got.group_n == got.groupby("label").row_id.transform("size")).all()


def test_text_ranks(spark):
    words = sorted({"", "a", "aa", "aaaaaaaa", "aaaaaaab", "é", "z", "Z", "žž", "\U0001f600"}, key=lambda w: w.encode())
    got = rank_by_text(spark.createDataFrame([(w,) for w in words], "w string"), "w").orderBy("rank").collect()
    assert [r["w"] for r in got] == words


def test_prepared_sets(spark):
    marks = ["1", "1t", "2", "2t", "1.0", "10", "10t"]
    df = spark.createDataFrame(list(enumerate(marks)), "row_id bigint, split string")
    steps = splits.prepared_sets(df, "split")
    assert rows_of(steps) == [
        (0, 0, "train"), (0, 1, "test"), (0, 4, "train"), (1, 2, "train"), (1, 3, "test"), (2, 5, "train"), (2, 6, "test"),
    ]
    splits.check_steps(steps)
    with pytest.raises(ValueError, match="step 0"):
        splits.check_steps(steps.filter("role = 'train'"))
    with pytest.raises(ValueError, match="no attribute"):
        splits.prepared_sets(df, "nothing")


def test_small_class_and_bad_folds(spark):
    df = spark.createDataFrame([(i, "big" if i > 1 else "small") for i in range(12)], "row_id bigint, label string")
    got = splits.stratified_k_fold(df, 5).groupBy("label", "fold").count().collect()
    sizes = {(r["label"], r["fold"]): r["count"] for r in got}
    assert sizes[("small", 0)] == sizes[("small", 1)] == 1 and ("small", 2) not in sizes
    assert max(n for (c, _), n in sizes.items() if c == "big") == 2
    with pytest.raises(ValueError):
        splits.k_fold(df, 1)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 400, 25_000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    hot = np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))
    wide = rng.integers(0, 5, size=n).astype(float)
    pdf = pd.DataFrame({"feature_ix": [0] * n + [1] * n, "value": np.concatenate([hot, wide])})
    got = {r["feature_ix"]: r["q"] for r in quantiles.exact_quantiles(spark.createDataFrame(pdf), [0.25, 0.5, 0.75]).collect()}
    for ix, values in ((0, hot), (1, wide)):
        np.testing.assert_allclose(got[ix], np.quantile(values, [0.25, 0.5, 0.75]), atol=1e-12)


def test_constant_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(4)], "row_id bigint, features array<double>")
    low = scaling.min_max(df, -1, 1).transform(df)
    assert [r["features"][1] for r in low.collect()] == [-1.0] * 4
    for scaler in (scaling.standard(df), scaling.robust(df)):
        assert [r["features"][1] for r in scaler.transform(df).collect()] == [0.0] * 4
    long = features.to_long(df)
    assert rows_of(selection.variance_support(long, 4)) == [(0, 0)]
    zero = spark.createDataFrame([(0, [0.0, 0.0])], "row_id bigint, features array<double>")
    assert scaling.normalize_rows(zero, "l2").first()["features"] == [0.0, 0.0]


def test_salted_lookup_equals_broadcast(spark):
    big = spark.range(6000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    table = big.groupBy("k").agg(F.count("*").alias("w")).withColumn("x", F.col("k") * 2)
    small = lookup.lookup_join(big, table, ["k"], "w")
    salted = lookup.lookup_join(big, table, ["k"], "w", broadcast_rows=5, rows_per_salt=100)
    columns = ["row_id", "k", "x"]
    assert rows_of(small.select(columns)) == rows_of(salted.select(columns))


def test_hashing_dense_equals_long(spark):
    docs = spark.createDataFrame([(0, "a b a c"), (1, ""), (2, "d")], "row_id bigint, text string")
    words = text.tokens(F.col("text"))
    entries = text.hashed_counts(words, 7, False, "l2", "md5")
    dense = {r[0]: r[1] for r in docs.select("row_id", text.dense_array(entries, 7)).collect()}
    assert all(len(v) == 7 for v in dense.values()) and dense[1] == [0.0] * 7
    for r in text.hashed_features(docs, n_features=7, method="md5").collect():
        assert dense[r["row_id"]][r["feature_ix"]] == r["value"]
        dense[r["row_id"]][r["feature_ix"]] = 0.0
    assert not any(any(v) for v in dense.values())


def brute_force(train, queries, k, by_self):
    out = []
    for q in queries.itertuples():
        d = ((np.vstack(train.features) - np.array(q.features)) ** 2).sum(axis=1)
        keep = (train.row_id != q.row_id) if by_self else (train.grp != q.grp)
        near = sorted(zip(d[keep], train.row_id[keep]))[:k]
        out += [(q.row_id, r, i + 1) for i, (_, r) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("by_self", [False, True])
def test_nearest_is_exact(spark, monkeypatch, by_self):
    """Many cells, blocks and chunks; a third of the rows are copies of one vector."""
    rng = np.random.default_rng(5)
    n = 600
    vectors = rng.integers(0, 4, size=(n, 3)).astype(float) + rng.integers(0, 5, size=(n, 1)) * 50
    vectors[rng.random(n) < 0.33] = [100.0, 101.0, 102.0]
    pdf = pd.DataFrame(
        {"row_id": rng.permutation(n), "grp": rng.integers(0, 4, n), "label_ix": rng.integers(0, 3, n), "features": vectors.tolist()}
    )
    monkeypatch.setattr(knn, "CHUNK_ROWS", 50)
    df = spark.createDataFrame(pdf).withColumn("label_ix", F.col("label_ix").cast("int"))
    got = knn.nearest(df, df.select("row_id", "grp", "features"), 4, by_self, block_rows=40)
    assert rows_of(got.select("row_id", "neighbour", "rank")) == brute_force(pdf, pdf, 4, by_self)


def test_scores_edge_cases(spark):
    """A label predicted but never true, an undefined binary step, micro F1 = accuracy."""
    rows = [
        (0, "m", "a", "a"), (0, "m", "b", "b"), (0, "m", "b", "c"),
        (1, "m", "a", "a"), (1, "m", "a", "b"),
    ]
    df = spark.createDataFrame(rows, "step int, classifier string, real string, predicted string")
    got = {r["step"]: r for r in scores.scores_by_step(scores.confusion_by_step(df), "b").collect()}
    assert got[0]["accuracy"] == got[0]["micro_f1"] == pytest.approx(2 / 3)
    assert got[0]["macro_recall"] == pytest.approx((1 + 0.5 + 0) / 3)
    assert got[0]["binary_precision"] == 1.0 and got[0]["binary_recall"] == 0.5
    assert np.isnan(got[1]["binary_f1"])
    mean = scores.mean_scores(scores.scores_by_step(scores.confusion_by_step(df), "b")).first()
    assert np.isnan(mean["binary_f1"]) and mean["accuracy"] == pytest.approx((2 / 3 + 0.5) / 2)


def test_no_leak(spark):
    docs = [(0, "x common", 0), (1, "y common", 1), (2, "z common", 2)]
    vocab, feats = text.tfidf_by_fold(spark.createDataFrame(docs, "row_id bigint, text string, fold int"), 3)
    assert rows_of(vocab.select("step", "term")) == [
        (0, "common"), (0, "y"), (0, "z"), (1, "common"), (1, "x"), (1, "z"), (2, "common"), (2, "x"), (2, "y"),
    ]
    assert feats.count() == 3
