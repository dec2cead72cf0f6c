"""Exact k nearest neighbours with pruned, blocked matching.

Training rows are assigned to the nearest of a few pivots.  For a query row the
pivots give an upper bound of its k-th neighbour distance and a lower bound of
its distance to every cell; only cells that can hold a neighbour are visited.
Cells are cut into blocks of bounded size, each (block, chunk of queries) is one
small group, and a group returns at most k rows per query.  Copies of the same
vector are reduced beforehand to the k with the smallest ids, which are the
only ones the tie rule can choose.

A query never meets training rows of its own group ``grp``: the fold in
cross-validation, the row itself in leave-one-out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a training block and of a query chunk that meet in one task.
BLOCK_ROWS = 8_192
CHUNK_ROWS = 65_536
#: Bound of the pivot table; about one pivot per block up to this many.
MAX_PIVOTS = 1_024
_SLACK = 1e-9


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.vstack(arrays.to_list()).astype("float64")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


@dataclass
class _Cells:
    """Pivot vectors and per-cell summaries; all sizes bounded by the pivot count."""

    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    near_dist: np.ndarray
    near_cell: np.ndarray
    near_grp: np.ndarray
    k: int
    by_self: bool

    def visits(self, x: np.ndarray, grp: np.ndarray) -> np.ndarray:
        """Boolean rows x cells: where a neighbour may be."""
        d = _distances(x, self.pivots)
        reach = d[:, self.near_cell] + self.near_dist[None, :]
        k = self.k
        if not self.by_self:
            reach = np.where(self.near_grp[None, :] == grp[:, None], np.inf, reach)
        if reach.shape[1] >= k:
            bound = np.partition(reach, k - 1, axis=1)[:, k - 1]
        else:
            bound = np.full(len(x), np.inf)
        lower = np.maximum(np.maximum(d - self.far, self.near - d), 0.0)
        scale = 1.0 + np.sqrt((x * x).sum(1)) + np.abs(self.pivots).max(initial=0.0)
        return lower <= (bound + 1e-6 * scale)[:, None]


def _rows(arrays: pa.ChunkedArray) -> np.ndarray:
    """Matrix of equally long Arrow lists, without an object per row."""
    sizes = arrays.combine_chunks().value_lengths()
    if sizes.null_count or len(sizes.unique()) > 1:
        raise ValueError("all rows need as many features")
    return arrays.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1).astype("float64", copy=False)


#: Queries of a block that are measured at a time.
QUERIES = 128


def _block_top_k(train: pa.Table, queries: pa.Table, k: int, by_self: bool) -> pa.Table:
    """Exact k nearest of one training block for each query of one chunk."""
    train = train.sort_by("row_id")
    ids, codes, grp = (train.column(c).to_numpy() for c in ("row_id", "label_ix", "grp"))
    y = _rows(train.column("features"))
    all_x, all_ids, all_grp = _rows(queries.column("features")), queries.column("row_id").to_numpy(), queries.column("grp").to_numpy()
    lengths, last = (y * y).sum(1), min(k, len(ids)) - 1
    out: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(queries), QUERIES):
        x, q_ids, q_grp = (a[start : start + QUERIES] for a in (all_x, all_ids, all_grp))
        rough = x @ y.T
        rough *= -2.0
        rough += lengths
        rough += (x * x).sum(1)[:, None]
        own = q_ids[:, None] == ids[None, :] if by_self else q_grp[:, None] == grp[None, :]
        rough[own] = np.inf
        kth = np.partition(rough, last, axis=1)[:, last]
        slack = _SLACK * (1.0 + (x * x).sum(1) + lengths.max())
        some = []
        for i in range(len(x)):
            close = np.flatnonzero((rough[i] <= kth[i] + slack[i]) & ~own[i])
            exact = ((y[close] - x[i]) ** 2).sum(axis=1)
            first = np.lexsort((ids[close], exact))[:k]
            some.append((np.full(len(first), i), exact[first], close[first]))
        at, exact, found = (np.concatenate(a) for a in zip(*some))
        out.append((q_ids[at], exact, ids[found], codes[found]))
    parts = [np.concatenate(a) for a in zip(*out)]
    kinds = zip(FOUND, parts, (pa.int64(), pa.float64(), pa.int64(), pa.int32()))
    return pa.table({n: pa.array(a, from_pandas=True).cast(t) for n, a, t in kinds})


FOUND = ("row_id", "sq_distance", "neighbour", "label_ix")
FOUND_TYPES = "row_id bigint, sq_distance double, neighbour bigint, label_ix int"


def matched(left: DataFrame, right: DataFrame, keys: list[str], k: int, by_self: bool) -> DataFrame:
    """The k nearest rows of every block of ``left`` for the queries of ``right`` that meet it, as Arrow tables of bounded size."""

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int32())
            return pa.table({n: pa.array([], t) for n, t in zip(FOUND, kinds)})
        return _block_top_k(a, b, k, by_self)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, FOUND_TYPES)


def nearest(train: DataFrame, queries: DataFrame, k: int, by_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, neighbour, label_ix, sq_distance, rank) with rank 1..k.

    ``train`` is (row_id, grp, label_ix, features); ``queries`` (row_id, grp, features).
    Ties in distance go to the smaller training ``row_id``.
    """
    if k < 1:
        raise ValueError("neighbours must be at least 1")
    keep = k + 1 if by_self else k  # one entry may be the query itself
    same = W.partitionBy("features", *([] if by_self else ["grp"])).orderBy("row_id")
    train = train.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= keep).drop("_copy")

    n_train = train.count()
    n_pivots = int(min(MAX_PIVOTS, max(1, n_train // block_rows)))
    sample = train.orderBy(F.xxhash64("row_id"), "row_id").select("features").limit(n_pivots)
    pivots = _matrix(pd.Series([r[0] for r in sample.collect()]))  # at most MAX_PIVOTS rows
    shared = train.sparkSession.sparkContext.broadcast(pivots)

    def cell_of(vectors: pd.Series) -> pd.DataFrame:
        cell, dist = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for s in range(0, len(vectors), 512):
            d = _distances(_matrix(vectors.iloc[s : s + 512]), shared.value)
            cell[s : s + 512], dist[s : s + 512] = d.argmin(1), d.min(1)
        return pd.DataFrame({"cell": cell, "dist": dist})

    placed = train.withColumn("_c", F.pandas_udf(cell_of, "cell int, dist double")("features"))
    placed = placed.select("row_id", "grp", "label_ix", "features", "_c.cell", "_c.dist").persist()
    near = W.partitionBy("cell", *([] if by_self else ["grp"])).orderBy("dist")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far"))
    closest = placed.select("cell", "grp", "dist", F.row_number().over(near).alias("r")).filter(F.col("r") <= keep)
    closest = closest.groupBy("cell", *([] if by_self else ["grp"])).agg(F.sort_array(F.collect_list("dist")).alias("d"))
    cells = summary.toPandas()  # one row per pivot
    dists = closest.toPandas()  # keep rows per pivot and group
    full = np.full((2, len(pivots)), np.inf)
    full[0, cells.cell], full[1, cells.cell] = cells.near, cells.far
    full[1, np.isinf(full[1])] = -np.inf
    counts = dists.d.map(len).to_numpy(dtype=int)
    shape = _Cells(
        pivots,
        full[0],
        full[1],
        np.concatenate([np.asarray(d, dtype=float) for d in dists.d]) if len(dists) else np.zeros(0),
        np.repeat(dists.cell.to_numpy(dtype=int), counts),
        np.repeat((dists.grp if not by_self else dists.cell * 0).to_numpy(), counts),
        keep,
        by_self,
    )
    shared_cells = train.sparkSession.sparkContext.broadcast(shape)

    def cells_to_visit(vectors: pd.Series, grp: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for s in range(0, len(vectors), 256):
            mask = shared_cells.value.visits(_matrix(vectors.iloc[s : s + 256]), grp.iloc[s : s + 256].to_numpy())
            out += [np.flatnonzero(row).astype(np.int32) for row in mask]
        return pd.Series(out, dtype=object)

    blocks = {int(c): -(-int(n) // block_rows) for c, n in zip(cells.cell, cells.n)}
    visiting = queries.select(
        "row_id", "grp", "features", F.explode(F.pandas_udf(cells_to_visit, "array<int>")("features", "grp")).alias("cell")
    ).persist()
    chunks = {r["cell"]: -(-r["count"] // CHUNK_ROWS) for r in visiting.groupBy("cell").count().collect()}  # per pivot

    plan = train.sparkSession.createDataFrame(
        [(c, blocks[c], int(chunks.get(c, 0))) for c in blocks], "cell int, blocks int, chunks int"
    )
    plan = F.broadcast(plan)  # one row per pivot
    spread = F.xxhash64(F.lit(7), F.col("row_id"))
    left = (
        placed.join(plan, "cell")
        .filter("chunks > 0")
        .withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cell", "block", "chunk", "row_id", "grp", "label_ix", "features")
    )
    right = (
        visiting.join(plan, "cell")
        .withColumn("chunk", F.pmod(spread, F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*[F.col(c).alias(c) for c in ("cell", "block", "chunk", "row_id", "grp", "features")])
    )
    keys = ["cell", "block", "chunk"]

    found = matched(left, right, keys, k, by_self)
    order = W.partitionBy("row_id").orderBy("sq_distance", "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("row_id", "neighbour", "label_ix", "sq_distance", "rank")


def vote(neighbours: DataFrame) -> DataFrame:
    """(row_id, predicted_ix): the most frequent class, the smallest code on a tie."""
    votes = neighbours.groupBy("row_id", "label_ix").agg(F.count("*").alias("n"))
    best = F.min_by("label_ix", F.struct(-F.col("n"), F.col("label_ix")))
    return votes.groupBy("row_id").agg(best.alias("predicted_ix"))


def knn_cross_validated(df: DataFrame, k: int = 3) -> DataFrame:
    """Predictions of all folds in one job: (fold, row_id, label_ix, predicted_ix)."""
    rows = df.withColumn("grp", F.col("fold").cast("bigint"))
    found = vote(nearest(rows.select("row_id", "grp", "label_ix", "features"), rows.select("row_id", "grp", "features"), k))
    return df.select("fold", "row_id", "label_ix").join(found, "row_id")


def knn_left_out(df: DataFrame, k: int = 3) -> DataFrame:
    """Leave-one-out predictions: every row against all others."""
    rows = df.withColumn("grp", F.lit(0).cast("bigint"))
    found = nearest(
        rows.select("row_id", "grp", "label_ix", "features"), rows.select("row_id", "grp", "features"), k, by_self=True
    )
    return df.select("row_id", "label_ix").join(vote(found), "row_id")


def knn_predict(train: DataFrame, test: DataFrame, k: int = 3) -> DataFrame:
    """(row_id, predicted_ix) of test rows from separate training rows."""
    a = train.select("row_id", F.lit(0).cast("bigint").alias("grp"), "label_ix", "features")
    b = test.select("row_id", F.lit(1).cast("bigint").alias("grp"), "features")
    return vote(nearest(a, b, k))
