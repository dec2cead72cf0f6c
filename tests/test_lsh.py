"""The locality-sensitive index: recall on clustered and on shapeless data, hot cells, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmeter.operators import knn, lsh


def frame(spark, x):
    return spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, label_ix int, features array<double>")


def exact(rows, queries, k):
    grp = F.lit(0).cast("bigint")
    return knn.nearest(rows.withColumn("grp", grp), queries.withColumn("grp", grp), k, by_self=True)


@pytest.mark.parametrize("kind", ["clusters", "noise", "hot"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "clusters":
        x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 8 + rng.normal(size=(3000, 16))
    elif kind == "noise":
        x = rng.normal(size=(1000, 32))
    else:  # a third of all rows in one cell
        x = np.vstack([rng.normal(size=(700, 8)) * 1e-3, rng.normal(size=(1400, 8))])
    rows = frame(spark, x).persist()
    queries = rows.filter("row_id % 20 = 0")
    index = lsh.LshIndex.fit(rows, 5)
    assert index.table.count() == 8 * len(x)  # every row is in every table
    found = index.nearest(queries, 5, block_rows=100)
    r = lsh.recall(found, exact(rows, queries, 5)).first()
    assert r.n == 5 * queries.count() and r.recall >= 0.9 and index.sampled_recall >= 0.97
    if kind == "clusters":
        largest = index.table.groupBy("cell").count().agg(F.max("count")).first()[0]
        assert largest < len(x) / 4  # it prunes where the data allow it


def test_odd_rows(spark):
    same = frame(spark, np.zeros((30, 4)))
    got = lsh.LshIndex.fit(same, 3).nearest(same, 3).collect()
    assert len(got) == 90 and all(r.sq_distance == 0 and r.neighbour != r.row_id for r in got)
    one = same.limit(1)
    assert lsh.LshIndex.fit(one, 3).nearest(one, 3).count() == 0
    none = same.limit(0)
    assert lsh.LshIndex.fit(none, 3).nearest(same, 3).count() == 0
