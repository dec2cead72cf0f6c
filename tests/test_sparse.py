"""Scalers of sparse features against dense ones."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from foldmeter.operators import classifiers, extractors, scaling


def data(rng):
    x = np.where(rng.random((60, 8)) < 0.6, 0.0, rng.normal(size=(60, 8)).round(1))
    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = 0, 5, np.arange(60) - 70, np.where(np.arange(60) < 3, 4.0, 0.0)
    return x


FITS = [
    ("sparse_min_max", lambda x: (x.min(0), np.ptp(x, axis=0))),
    ("sparse_standard", lambda x: (x.mean(0), x.std(0))),
    ("sparse_robust", lambda x: (np.median(x, 0), np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0))),
]


@pytest.mark.parametrize(("name", "rule"), FITS)
def test_stored_entries_and_zeros(spark, name, rule):
    x = data(np.random.default_rng(4))
    rows = [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v]
    entries = spark.createDataFrame(rows, "row_id long, feature_ix int, value double")
    scaler = getattr(scaling, name)(entries, len(x))
    shift, spread = rule(x)
    want = (x - shift) / np.where(np.isclose(spread, 0), 1, spread)
    got = scaler.transform(entries).collect()
    assert len(got) == len(rows)
    zero = (0 - shift) / np.where(np.isclose(spread, 0), 1, spread)
    for r in got:
        assert r.value == pytest.approx(want[r.row_id, r.feature_ix], abs=1e-9) and r.zero == pytest.approx(zero[r.feature_ix], abs=1e-9)
    dense = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    out = {r.row_id: r.features for r in scaler.dense(8).transform(dense).collect()}
    assert all(out[i] == pytest.approx(list(want[i]), abs=1e-9) for i in range(len(x)))


@pytest.mark.parametrize("normalizer", [classifiers.MinMax(-1, 2), classifiers.Standard(), classifiers.Robust(False)])
def test_vectors_and_arrays_scale_alike(spark, normalizer):
    x = data(np.random.default_rng(5))
    arrays = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, label_ix int, features array<double>")
    as_vectors = spark.createDataFrame(
        [(i, 0, Vectors.sparse(8, {j: float(v) for j, v in enumerate(r) if v}) if i % 2 else Vectors.dense(r)) for i, r in enumerate(x)],
        ["row_id", "label_ix", "features"],
    )
    a = {r.row_id: r.features.toArray() for r in normalizer.fit(arrays).transform(arrays).collect()}
    b = {r.row_id: r.features.toArray() for r in normalizer.fit(as_vectors).transform(as_vectors).collect()}
    assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_no_entries(spark):
    none = spark.createDataFrame([], "row_id long, feature_ix int, value double")
    for name, _ in FITS:
        assert getattr(scaling, name)(none, 5).transform(none).count() == 0
    assert scaling.sparse_min_max(none, 5, 3, 4).dense(2).params.filter(F.col("low") == 3).count() == 2


def test_wide_vocabularies_give_the_same_vectors(spark, monkeypatch):
    rows = [(0, "a b b c"), (1, "c d"), (2, ""), (3, None), (4, "z z z")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    fitted = extractors.Tfidf().fit(df.filter("row_id < 4"), "text")
    narrow = {r.row_id: r.v for r in fitted.vector(df, "v").collect()}
    monkeypatch.setattr(extractors, "BROADCAST_TERMS", 2)
    wide = {r.row_id: r.v for r in fitted.vector(df, "v").collect()}
    assert set(wide) == {0, 1, 2, 3, 4} and all(wide[i].size == 4 and wide[i].toArray() == pytest.approx(narrow[i].toArray()) for i in wide)
