"""Blocks of the neighbour search, and statistics of trees, stay small."""

import numpy as np
import pyarrow as pa

from foldmeter.operators import classifiers, knn, selection


def test_neighbour_blocks_are_measured_a_few_queries_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    y, x = rng.integers(0, 3, (300, 4)).astype(float), rng.integers(0, 3, (200, 4)).astype(float)

    def table(a, start, grp):
        ids = np.arange(start, start + len(a))
        return pa.table({"row_id": ids, "grp": np.full(len(a), grp), "label_ix": (ids % 5).astype(np.int32), "features": a.tolist()})

    most, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *r, **k: most.append(a.shape) or partition(a, *r, **k))
    got = knn._block_top_k(table(y, 0, 0), table(x, 1000, 1), 3, False).to_pylist()
    assert max(s[0] for s in most) <= knn.QUERIES < 200 and len(got) == 600
    for i in range(200):
        d = ((y - x[i]) ** 2).sum(1)
        want = sorted(zip(d, range(300)))[:3]
        assert [(r["sq_distance"], r["neighbour"], r["label_ix"]) for r in got[3 * i : 3 * i + 3]] == [(a, j, j % 5) for a, j in want]


def test_trees_gather_bounded_statistics(monkeypatch):
    class Seen(Exception):
        pass

    def tree(**params):
        assert params["maxMemoryInMB"] <= 256
        raise Seen

    for module, fit in ((classifiers, lambda: classifiers.DecisionTree()._fit(None, 2)), (selection, lambda: selection.TreeSelector().fit(Frame()))):
        monkeypatch.setattr(module, "DecisionTreeClassifier", tree)
        try:
            fit()
        except Seen:
            continue
        raise AssertionError("no tree was built")


class Frame:
    dtypes = [("features", "vector")]
