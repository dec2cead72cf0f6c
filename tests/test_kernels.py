"""Kernel machines of all folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmeter.operators import linear


@pytest.mark.parametrize("n_classes", [2, 3])
def test_kernel_machines_of_all_folds_at_once(spark, monkeypatch, n_classes):
    """One series of passes for all kernels and folds, with the predictions of a machine per kernel and fold."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    label = (np.sqrt((x * x).sum(1)) * 10).astype(int) % n_classes
    rows = [(i, i % 3, int(label[i]), [float(v) for v in x[i]]) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, fold int, label_ix int, features array<double>").repartition(2).persist()
    calls, minimize = [], linear.minimize
    monkeypatch.setattr(linear, "minimize", lambda *a: calls.append(1) or minimize(*a))
    kernels = ("poly", "rbf", "sigmoid")
    model = linear.KernelMachines.fit(df, 3, kernels, n_classes, n_landmarks=20, max_passes=25)
    got = {(r.kernel, r.row_id): r.predicted_ix for r in model.predict(df).collect()}
    assert len(calls) == 1 and len(got) == 360
    k = "rbf"
    for s in range(3):
        one = linear.kernel_svm_predict(df.filter(F.col("fold") != s), df.filter(F.col("fold") == s), k, 20, max_iter=25, n_classes=n_classes)
        assert all(got[k, r.row_id] == r.predicted_ix for r in one.collect())
