"""Approximate nearest neighbours from bucketed random projections, with a recall that is measured before it is used.

Each of several tables cuts a few random directions into buckets of one width; rows that share the buckets of a table share a
cell.  The width is not guessed: the true neighbours of a bounded sample of query rows, found exactly among all rows, say which
share of neighbours any width would find, and the smallest width on a fixed ladder that reaches the wanted recall is taken.  A
width that puts all rows into one cell is the last rung, so the recall can always be reached, at the cost of the exact search.

Every row is indexed.  Queries meet the rows of their cells in blocks of bounded size, so a cell that holds a third of all rows
is many small groups, none of which returns more than k rows per query.  Distances are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldmeter.operators.knn import BLOCK_ROWS, CHUNK_ROWS, _distances, _matrix, matched
from foldmeter.session import cut_lineage, write_and_broadcast

#: Rows that the width is fitted on, and the ladder of widths, as multiples of the sample's mean neighbour distance.
SAMPLE_ROWS = 64
LADDER = tuple(0.25 * 1.25**i for i in range(24))


@dataclass
class Cells:
    """Directions (tables, projections, features), offsets in bucket widths, and the width (None: one cell for all)."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float | None

    def of(self, x: np.ndarray) -> np.ndarray:
        """64-bit cell numbers (rows, tables)."""
        tables, projections, _ = self.directions.shape
        out = np.tile(np.arange(tables, dtype=np.uint64), (len(x), 1))
        if self.width is None:
            return out.view(np.int64)
        for p in range(projections):
            at = np.floor(x @ self.directions[:, p].T / self.width + self.offsets[:, p]).astype(np.int64).view(np.uint64)
            out = (out ^ at) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def _true_neighbours(rows: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, distance, features) of the k nearest other rows, from one pass; k rows per query and task are shuffled."""
    ids, x = queries.row_id.to_numpy(), _matrix(queries.features)
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def nearest_here(parts):
        own, mine = shared.value
        for part in parts:
            if part.empty:
                continue
            d = _distances(mine, _matrix(part.features))
            d[own[:, None] == part.row_id.to_numpy()[None, :]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(own)), best.shape[1])
            found = d[q, best.ravel()]
            good = np.isfinite(found)
            yield pd.DataFrame({"q": q[good], "distance": found[good], "features": part.features.to_numpy()[best.ravel()[good]]})

    found = rows.select("row_id", "features").mapInPandas(nearest_here, "q int, distance double, features array<double>")
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance"))
    return found.withColumn("r", rank).filter(F.col("r") <= k).drop("r").toPandas()  # k rows per sampled query


@dataclass
class LshIndex:
    """``table`` holds every row once per table of cells: (cell, row_id, label_ix, features)."""

    cells: Cells
    table: DataFrame
    sampled_recall: float

    @staticmethod
    def fit(
        rows: DataFrame, k: int = 3, recall: float = 0.97, tables: int = 8, projections: int = 4, sample_rows: int = SAMPLE_ROWS, seed: int = 0
    ) -> LshIndex:
        """``rows`` is (row_id, label_ix, features).  ``recall`` is wanted on the sample; leave some room above what is needed."""
        sample = rows.orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").select("row_id", "features").limit(sample_rows).toPandas()
        rng = np.random.default_rng(seed)
        width = len(sample.features.iloc[0]) if len(sample) else 1
        cells = Cells(rng.normal(size=(tables, projections, width)), rng.random((tables, projections)), None)
        reached = 1.0
        if len(sample):
            near = _true_neighbours(rows, sample, k)
            if len(near) and near.distance.mean() > 0:
                queries, found = _matrix(sample.features)[near.q], _matrix(near.features)
                for step in LADDER:
                    tried = Cells(cells.directions, cells.offsets, step * float(near.distance.mean()))
                    share = float((tried.of(queries) == tried.of(found)).any(axis=1).mean())
                    if share >= recall:
                        cells, reached = tried, share
                        break
        return LshIndex(cells, cut_lineage(_in_cells(rows.select("row_id", "label_ix", "features"), cells)), reached)

    def nearest(self, queries: DataFrame, k: int = 3, by_self: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """(row_id, neighbour, label_ix, sq_distance, rank) of the nearest rows that share a cell; fewer than k if few do.

        ``queries`` is (row_id, features); with ``by_self`` a row is not its own neighbour.  Ties go to the smaller id.
        """
        visiting = cut_lineage(_in_cells(queries.select("row_id", "features"), self.cells))
        asked = visiting.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CHUNK_ROWS)).cast("int").alias("chunks"))
        asked = write_and_broadcast(asked)
        held = self.table.join(asked, "cell", "left_semi").groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
        plan = write_and_broadcast(held.join(asked, "cell"))
        spread = F.xxhash64(F.lit(11), F.col("row_id"))
        left = (
            self.table.join(plan, "cell")
            .withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("cell", "block", "chunk", "row_id", F.lit(0).cast("bigint").alias("grp"), "label_ix", "features")
        )
        right = (
            visiting.join(plan, "cell")
            .withColumn("chunk", F.pmod(spread, F.col("chunks")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("cell", "block", "chunk", "row_id", F.lit(1).cast("bigint").alias("grp"), "features")
        )

        found = matched(left, right, ["cell", "block", "chunk"], k, by_self)
        # a neighbour found in several tables counts once
        once = found.groupBy("row_id", "neighbour").agg(F.min("sq_distance").alias("sq_distance"), F.min("label_ix").alias("label_ix"))
        rank = F.row_number().over(W.partitionBy("row_id").orderBy("sq_distance", "neighbour"))
        return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("row_id", "neighbour", "label_ix", "sq_distance", "rank")


def _in_cells(rows: DataFrame, cells: Cells) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def cells_of(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(shared.value.of(_matrix(vectors))))

    return rows.withColumn("cell", F.explode(F.pandas_udf(cells_of, "array<long>")("features")))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact neighbours ``n``, and the share of them ``recall`` that are as near as a found one of the same rank or better.

    Compared by distance, so that ties may be broken either way.
    """
    worst = exact.groupBy("row_id").agg(F.max("sq_distance").alias("worst"), F.count("*").alias("n"))
    close = found.join(worst, "row_id").groupBy("row_id").agg(F.count_if(F.col("sq_distance") <= F.col("worst") * (1 + 1e-9)).alias("hits"))
    both = worst.join(close, "row_id", "left").select("n", F.least(F.coalesce("hits", F.lit(0)), F.col("n")).alias("hits"))
    return both.agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("recall"))
