"""Classification by prototype functions.

A candidate classifier has one function per class.  The function rates a row by
its distances to a few stored vectors (slots), each carrying a value; the class
with the highest rating wins.  The gene table (individual, class, fun, slot,
value, vector) is bounded by population x classes x slots and goes to every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the rating functions.
FUNCTIONS = ("nearest", "2+2", "2+2+2")


@dataclass
class ClassFunction:
    """Slots of one class of one individual."""

    fun: str
    values: np.ndarray
    vectors: np.ndarray

    def rate(self, x: np.ndarray) -> np.ndarray:
        d = np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in self.vectors], axis=1)
        near = np.argsort(d, axis=1, kind="stable")  # ties: lower slot first
        if self.fun == "nearest":
            return self.values[near[:, 0]]
        positive = self.values > 0
        groups = [_first_two(near, np.ones_like(positive))] if self.fun == "2+2+2" else []
        groups += [_first_two(near, side) for side in (positive, ~positive) if side.any()]
        chosen = np.hstack(groups)
        return _weighted_mean(np.take_along_axis(d, chosen, axis=1), self.values[chosen])


def _first_two(near: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Columns of the two nearest slots of one side, per row."""
    return near[side[near]].reshape(len(near), -1)[:, :2]


def _weighted_mean(d: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inverse-distance mean; a slot at distance 0 decides, the first one in order."""
    hit = d == 0
    weight = 1.0 / np.where(hit, 1.0, d)
    mean = (v * weight).sum(axis=1) / weight.sum(axis=1)
    return np.where(hit.any(axis=1), v[np.arange(len(v)), hit.argmax(axis=1)], mean)


#: individuals x {class code: function}
Population = list[dict[int, ClassFunction]]


def population_of(genes: DataFrame) -> Population:
    """Read a gene table into memory; its size is population x classes x slots."""
    out: dict[int, dict[int, ClassFunction]] = {}
    rows = genes.orderBy("individual", "class", "slot").toPandas()
    for (ind, cls), part in rows.groupby(["individual", "class"]):
        fun = ClassFunction(part.fun.iloc[0], part.value.to_numpy(dtype=float), np.vstack(part.vector.to_list()))
        out.setdefault(int(ind), {})[int(cls)] = fun
    return [out[i] for i in sorted(out)]


def gene_table(spark, population: Population) -> DataFrame:
    rows = [
        (i, c, f.fun, s, float(f.values[s]), [float(x) for x in f.vectors[s]])
        for i, ind in enumerate(population)
        for c, f in ind.items()
        for s in range(len(f.values))
    ]
    return spark.createDataFrame(
        rows, "individual int, class int, fun string, slot int, value double, vector array<double>"
    )


def ratings(df: DataFrame, population: Population) -> DataFrame:
    """Add ``ratings``: array<struct<individual, class, value>>."""
    shared = df.sparkSession.sparkContext.broadcast(population)
    keys = [(i, c) for i, ind in enumerate(population) for c in sorted(ind)]

    def rate(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.vstack(vectors.to_list())
        return pd.Series(list(np.stack([shared.value[i][c].rate(x) for i, c in keys], axis=1)))

    values = F.pandas_udf(rate, "array<double>")("features")
    index = F.array(*[F.struct(F.lit(i).alias("individual"), F.lit(c).alias("class")) for i, c in keys])
    pair = F.zip_with(
        index, "_v", lambda k, v: F.struct(k["individual"].alias("individual"), k["class"].alias("class"), v.alias("value"))
    )
    return df.withColumn("_v", values).withColumn("ratings", pair).drop("_v")


def classify(df: DataFrame, population: Population, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(keep..., individual, predicted_ix): the best rated class, the first one on a tie."""
    shared = df.sparkSession.sparkContext.broadcast(population)

    def best(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.vstack(vectors.to_list())
        out = []
        for ind in shared.value:
            codes = np.array(sorted(ind))
            out.append(codes[np.stack([ind[c].rate(x) for c in codes], axis=1).argmax(axis=1)])
        return pd.Series(list(np.stack(out, axis=1).astype("int32")))

    chosen = F.pandas_udf(best, "array<int>")("features")
    return df.select(*keep, F.posexplode(chosen).alias("individual", "predicted_ix"))


def fitness(df: DataFrame, population: Population) -> DataFrame:
    """(individual, fitness): share of right rows, all candidates in one pass."""
    hits = classify(df, population, keep=("label_ix",))
    right = (F.col("predicted_ix") == F.col("label_ix")).cast("double")
    return hits.groupBy("individual").agg(F.avg(right).alias("fitness"))
