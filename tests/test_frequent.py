"""Joins that shuffle rare keys only, and scratch tables that leave no shuffle files."""

import pathlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmeter import session
from foldmeter.operators import lookup, scaling, text
from tests.test_order import plan


@pytest.mark.parametrize("how", ["inner", "left"])
def test_only_rare_keys_are_shuffled(spark, monkeypatch, tmp_path, how):
    monkeypatch.setattr(lookup, "FREQUENT_KEYS", 3)
    big = spark.range(300).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).when(F.col("id") % 100 > 0, F.col("id")).alias("k"))
    table = big.filter("k is not null and k <> 40").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 10)
    table.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    want = sorted(map(str, big.join(table.drop("n"), "k", how).select("id", "k", "x").collect()))
    joined = lookup.frequent_join(big, table, "k", "n", how, broadcast_rows=10)
    assert sorted(map(str, joined.select("id", "k", "x").collect())) == want and len(want) == (296 if how == "inner" else 300)
    assert plan(joined).count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("fit", [scaling.sparse_min_max, scaling.sparse_standard, scaling.sparse_robust])
def test_scaled_alike_where_parameters_are_many(spark, monkeypatch, fit):
    rng = np.random.default_rng(8)
    rows = [(i, j, float(rng.integers(-3, 9))) for i in range(40) for j in range(30) if rng.random() < 1 / (1 + j)]
    entries = spark.createDataFrame([r for r in rows if r[2]], "row_id long, feature_ix int, value double")
    scaler = fit(entries, 40)
    other = entries.unionAll(spark.createDataFrame([(99, 77, 2.5)], entries.schema))  # a feature not seen in training
    whole = lambda: sorted((r.row_id, r.feature_ix, round(r.value, 9), round(r.zero, 9)) for r in scaler.transform(other).collect())
    want = whole()
    monkeypatch.setattr(lookup, "fits_broadcast", lambda df, rows=0, size=0: rows == 5)
    monkeypatch.setattr(lookup, "FREQUENT_KEYS", 5)
    assert whole() == want and plan(scaler.transform(other)).count("Union") == 3  # the joined halves, and ``other`` in each


def test_written_tables_leave_no_shuffle_files(spark):
    """They used to stay until the driver happened to collect garbage."""
    folder = pathlib.Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p.name for p in folder.rglob("shuffle_*.data")}
    before = files()
    held = spark.range(5000).select(F.xxhash64("id").alias("h")).repartition(4, "h")
    table, end = session.cut_lineage(held), time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and table.count() == 5000
    assert spark.conf.get(session._CLEANUP) == "false"


def test_weights_are_found_by_frequent_and_rare_terms(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 2, 0, " ".join(["all"] + [f"w{j}" for j in range(i)] * 2)) for i in range(12)], "row_id long, fold int, label_ix int, text string")

    def found():
        model, folds = text.Tfidf.fit(df), text.TfidfFolds.fit(df, 2, "text")
        parts = (model.transform(df), folds.test(), folds.train())
        return [sorted(str([round(x, 9) if isinstance(x, float) else x for x in r if not isinstance(x, list)]) for r in p.collect()) for p in parts]

    want = found()
    monkeypatch.setattr(lookup, "fits_broadcast", lambda d, rows=0, size=0: rows == 5)
    monkeypatch.setattr(lookup, "FREQUENT_KEYS", 5)
    assert found() == want
