"""Feature selectors: fitted on training rows, applied to any rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VarianceThresholdSelector, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Named importance thresholds.
NAMED_THRESHOLDS = ("mean", "median", "1.25*mean")

#: Split statistics that one task of a tree gathers in a pass.  It holds them several times over while they are merged; more
#: saves passes, and the tree is the same.
TREE_MEMORY_MB = 256

#: Dense statistics of at most so many features are held by a task; those of wider vectors are grouped by feature.
WIDE = 1 << 18


def feature_variances(features: DataFrame, n_rows: int) -> DataFrame:
    """(feature_ix, variance): population variance over ``n_rows`` rows of a long frame.

    The moments of the present entries are merged with the absent zeros, which
    keeps a constant column at exactly 0.
    """
    present = features.groupBy("feature_ix").agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    absent = F.lit(n_rows) - F.col("n")
    spread = F.col("n") * F.col("v") + F.col("n") * absent / n_rows * F.col("m") ** 2
    return present.select("feature_ix", (spread / n_rows).alias("variance"))


def variance_support(features: DataFrame, n_rows: int, threshold: float = 0.0) -> DataFrame:
    """(feature_ix, new_ix): kept features of a long frame; all-zero features have variance 0."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    return _renumber(feature_variances(features, n_rows).filter(F.col("variance") > threshold))


def _renumber(kept: DataFrame) -> DataFrame:
    from foldmeter.operators.ranks import rank_by_key

    return rank_by_key(kept.select("feature_ix"), "feature_ix").select(
        "feature_ix", F.col("rank").cast("int").alias("new_ix")
    )


def apply_support(features: DataFrame, support: DataFrame) -> DataFrame:
    """Keep the supported features and renumber them."""
    from foldmeter.session import broadcast_if_small

    joined = features.join(broadcast_if_small(support), "feature_ix").drop("feature_ix")
    return joined.withColumnRenamed("new_ix", "feature_ix").select(*features.columns)


def support_mask(support: DataFrame, width: int) -> DataFrame:
    """(feature_ix, kept) for all features."""
    all_ix = support.sparkSession.range(width).select(F.col("id").cast("int").alias("feature_ix"))
    return all_ix.join(support, "feature_ix", "left").select("feature_ix", F.col("new_ix").isNotNull().alias("kept"))


@dataclass
class FittedSelector:
    """Kept feature indices of a vector column."""

    indices: list[int]

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        sliced = VectorSlicer(inputCol=column, outputCol="_kept", indices=self.indices).transform(df)
        return sliced.drop(column).withColumnRenamed("_kept", column)

    def names(self, names: Sequence[str]) -> list[str]:
        return names.pick(self.indices) if hasattr(names, "pick") else [names[i] for i in self.indices]


def _kept(indices: list[int]) -> FittedSelector:
    if not indices:
        raise ValueError("no feature meets the selector's threshold")
    return FittedSelector(indices)


@dataclass
class VarianceSelector:
    """Keep the features whose population variance exceeds ``threshold``."""

    threshold: float = 0.0

    def __post_init__(self):
        if self.threshold < 0:
            raise ValueError("threshold must not be negative")

    def fit(self, train: DataFrame, column: str = "features") -> FittedSelector:
        from pyspark.ml.stat import Summarizer

        row = train.select(Summarizer.metrics("variance", "count").summary(F.col(column)).alias("s")).first()["s"]
        shrink = (row["count"] - 1) / row["count"] if row["count"] else 0.0
        return _kept([i for i, v in enumerate(row["variance"].toArray() * shrink) if v > self.threshold])


@dataclass
class TreeSelector:
    """Keep the features whose decision-tree importance reaches ``threshold``.

    The threshold is a number, ``mean``, ``median``, ``1.25*mean``, or None for the mean.
    """

    threshold: float | str | None = None
    seed: int = 0
    max_depth: int = 30

    def __post_init__(self):
        if isinstance(self.threshold, str) and self.threshold not in NAMED_THRESHOLDS:
            raise ValueError(f"threshold must be a number or one of {NAMED_THRESHOLDS}")

    def fit(self, train: DataFrame, column: str = "features") -> FittedSelector:
        import numpy as np

        if dict(train.dtypes)[column].startswith("array"):
            train = train.withColumn(column, array_to_vector(column))
        tree = DecisionTreeClassifier(
            featuresCol=column, labelCol="label_ix", maxDepth=self.max_depth, seed=self.seed, maxMemoryInMB=TREE_MEMORY_MB
        )
        importance = tree.fit(train).featureImportances.toArray()
        named: dict[str, Callable[[], float]] = {
            "mean": importance.mean,
            "median": lambda: float(np.median(importance)),
            "1.25*mean": lambda: 1.25 * importance.mean(),
        }
        limit = self.threshold if isinstance(self.threshold, (int, float)) else named[self.threshold or "mean"]()
        return _kept([int(i) for i in np.flatnonzero(importance >= limit)])


def _vector_width(df: DataFrame, column: str) -> int:
    u = F.unwrap_udt(column)
    first = df.select(F.coalesce(u["size"], F.size(u["values"]))).first()
    return first[0] if first else 0


def _varying(train: DataFrame, column: str, threshold: float) -> list[int]:
    """Features whose sample variance exceeds ``threshold``, from the stored entries."""
    from foldmeter.operators.machines import as_entries

    n = train.count()
    parts = as_entries(train.select(column), column)
    at = F.coalesce("ix", F.sequence(F.lit(0), F.size("v") - 1))
    stored = parts.select(F.explode(F.arrays_zip(at.alias("feature_ix"), F.col("v").alias("value"))).alias("e"))
    variances = feature_variances(stored.select("e.*").filter("value <> 0"), n)
    sample = F.col("variance") * n / max(n - 1, 1)
    return sorted(r[0] for r in variances.filter((sample > threshold) & ~F.isnan(sample)).select("feature_ix").collect())


@dataclass
class MLSelector:
    """Any ``pyspark.ml`` feature selector that tells its ``selectedFeatures``; labels are passed where it takes them."""

    estimator: Any

    def fit(self, train: DataFrame, column: str = "features") -> FittedSelector:
        params = {self.estimator.getParam("featuresCol"): column, self.estimator.getParam("outputCol"): "_kept"}
        if self.estimator.hasParam("labelCol"):
            params[self.estimator.getParam("labelCol")] = "label_ix"
        if dict(train.dtypes)[column].startswith("array"):
            train = train.withColumn(column, array_to_vector(column))
        if type(self.estimator) is VarianceThresholdSelector and _vector_width(train, column) > WIDE:
            return _kept(_varying(train, column, self.estimator.getVarianceThreshold()))
        return _kept(sorted(int(i) for i in self.estimator.fit(train, params).selectedFeatures))


def select_chain(selectors: Sequence, train: DataFrame, tests: Sequence[DataFrame], column: str = "features"):
    """Fit each selector on the training rows left by the one before; apply it to all frames."""
    fitted = []
    for s in selectors:
        model = s.fit(train, column)
        fitted.append(model)
        train, tests = model.transform(train, column), [model.transform(t, column) for t in tests]
    return fitted, train, list(tests)
