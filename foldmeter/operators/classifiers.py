"""Classifiers of a comparison.

A classifier has a name, an abbreviation and ``fit(train, n_classes)``; the
fitted model has ``predict(test)`` giving (row_id, predicted_ix) and, where it
can tell, ``top``.  Frames are (row_id, label_ix, features vector).  Any
``pyspark.ml`` estimator takes part through ``MLClassifier``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.classification import NaiveBayes as MLNaiveBayes
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.operators import evolve, knn, linear, network, scaling
from foldmeter.operators.machines import LinearMachines, as_entries
from foldmeter.operators.selection import TREE_MEMORY_MB
from foldmeter.operators.bayes import GaussianNB, multinomial_all_folds, multinomial_left_out


def dense(df: DataFrame) -> DataFrame:
    if dict(df.dtypes)["features"].startswith("array"):
        return df
    return df.withColumn("features", vector_to_array("features"))


def vectors(df: DataFrame) -> DataFrame:
    if dict(df.dtypes)["features"].startswith("array"):
        return df.withColumn("features", array_to_vector("features"))
    return df


def entries(df: DataFrame, *keep: str) -> DataFrame:
    """(row_id, keep..., feature_ix, value) of the features that are not zero."""
    parts = as_entries(df.select("row_id", *keep, "features"))
    at = F.coalesce("ix", F.sequence(F.lit(0), F.size("v") - 1))
    long = parts.select("row_id", *keep, F.explode(F.arrays_zip(at.alias("feature_ix"), F.col("v").alias("value"))).alias("e"))
    return long.select("row_id", *keep, "e.feature_ix", "e.value").filter("value <> 0")


@dataclass
class RowNorm:
    """Unit-length rows."""

    norm: str = "l2"

    def __post_init__(self):
        if self.norm not in ("l1", "l2"):
            raise ValueError("norm must be l1 or l2")

    def fit(self, train: DataFrame):
        from pyspark.ml.feature import Normalizer

        return _Stage(Normalizer(p=float(self.norm[1]), inputCol="features", outputCol="_n"))


@dataclass
class _Stage:
    stage: Any

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stage.transform(vectors(df)).drop("features").withColumnRenamed("_n", "features")


@dataclass
class MLNormalizer:
    """Any ``pyspark.ml`` scaler or transformer from vectors to vectors, fitted on the training rows."""

    stage: Any

    def fit(self, train: DataFrame) -> _Stage:
        stage = self.stage.copy({self.stage.getParam("inputCol"): "features", self.stage.getParam("outputCol"): "_n"})
        return _Stage(stage.fit(vectors(train)) if hasattr(stage, "fit") else stage)


@dataclass
class _Columns:
    scaler: scaling.Scaler

    def transform(self, df: DataFrame) -> DataFrame:
        return vectors(self.scaler.transform(dense(df)))


def _fit_columns(train: DataFrame, of_arrays: Callable, of_entries: Callable) -> _Columns:
    """Arrays are read as they are, vectors by their stored entries: the zeros of a sparse one are counted, not written out."""
    if dict(train.dtypes)["features"].startswith("array"):
        return _Columns(of_arrays(train))
    size = F.unwrap_udt("features")
    n, width = train.agg(F.count("*"), F.max(F.coalesce(size["size"], F.size(size["values"])))).first()
    return _Columns(of_entries(entries(train), n).dense(width or 0))


@dataclass
class MinMax:
    min_v: int = 0
    max_v: int = 1

    def fit(self, train: DataFrame) -> _Columns:
        limits = (self.min_v, self.max_v)
        return _fit_columns(train, lambda t: scaling.min_max(t, *limits), lambda e, n: scaling.sparse_min_max(e, n, *limits))


@dataclass
class Robust:
    centering: bool = True

    def fit(self, train: DataFrame) -> _Columns:
        return _fit_columns(train, lambda t: scaling.robust(t, self.centering), lambda e, n: scaling.sparse_robust(e, n, self.centering))


@dataclass
class Standard:
    centering: bool = True

    def fit(self, train: DataFrame) -> _Columns:
        return _fit_columns(train, lambda t: scaling.standard(t, self.centering), lambda e, n: scaling.sparse_standard(e, n, self.centering))


@dataclass
class Fitted:
    """Predicting function plus what a report may ask for."""

    predict: Callable[[DataFrame], DataFrame]
    weights: Any = None
    epochs: list[tuple[int, float, float]] = field(default_factory=list)


class Classifier:
    """Common part: the optional normalizer is fitted on train and applied to both sides."""

    name: str
    abbreviation: str
    normalizer: Any = None

    def fit(self, train: DataFrame, n_classes: int) -> Fitted:
        norm = self.normalizer.fit(train) if self.normalizer is not None else None
        prepared = norm.transform(train) if norm else train
        model = self._fit(prepared, n_classes)
        if norm is None:
            return model
        inner = model.predict
        return Fitted(lambda test: inner(norm.transform(test)), model.weights, model.epochs)

    def _fit(self, train: DataFrame, n_classes: int) -> Fitted:
        raise NotImplementedError


def _codes(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.col("prediction").cast("int").alias("predicted_ix"))


@dataclass
class MLClassifier(Classifier):
    """Any ``pyspark.ml`` classifier."""

    estimator: Any
    name: str
    abbreviation: str
    normalizer: Any = None

    def _fit(self, train: DataFrame, n_classes: int) -> Fitted:
        est = self.estimator.copy()
        params = {est.getParam("labelCol"): "label_ix", est.getParam("featuresCol"): "features"}
        model = est.fit(vectors(train), params)
        weights = model.featureImportances.toArray() if hasattr(model, "featureImportances") else None
        return Fitted(lambda test: _codes(model.transform(vectors(test))), weights)


@dataclass
class SVM(Classifier):
    normalizer: Any = field(default_factory=RowNorm)
    kernel: str = "linear"
    show_imp_features: int = 0
    c: float = 1.0
    max_iter: int = 100
    landmarks: int = 200
    random_seed: int = 0
    name: str = "Support Vector Machines"
    abbreviation: str = "SVM"

    def __post_init__(self):
        if self.kernel not in linear.KERNELS:
            raise ValueError(f"kernel must be one of {linear.KERNELS}")
        if self.show_imp_features < 0:
            raise ValueError("show_imp_features must not be negative")
        if self.show_imp_features and self.kernel != "linear":
            raise ValueError("top features need the linear kernel")

    def _fit(self, train: DataFrame, n_classes: int) -> Fitted:
        if self.kernel != "linear":
            mapping = linear.KernelMap.fit(dense(train), self.kernel, self.landmarks, self.random_seed)
            model = LinearMachines.fit(mapping.transform(dense(train)), n_classes, c=self.c, max_passes=self.max_iter)
            return Fitted(lambda test: model.predict(mapping.transform(dense(test))))
        model = LinearMachines.fit(train, n_classes, c=self.c, max_passes=self.max_iter)
        matrix = model.coefficients

        def predict(test: DataFrame) -> DataFrame:
            codes = model.predict(test)
            if not self.show_imp_features:
                return codes
            coef = linear.coefficient_table(test.sparkSession, matrix)
            long = entries(test)
            top = linear.top_features(long, codes, coef, matrix.shape[1], self.show_imp_features, len(matrix) == 1)
            return codes.join(top, "row_id")

        return Fitted(predict, matrix)

    @property
    def takes_all_folds(self) -> bool:
        return self.kernel == "linear" and not self.show_imp_features and (self.normalizer is None or isinstance(self.normalizer, RowNorm))

    def all_folds_dense(self, df: DataFrame, n_folds: int, n_classes: int) -> DataFrame:
        """(row_id, predicted_ix) of every row by the machines of its fold, all trained together."""
        rows = self.normalizer.fit(df).transform(df) if self.normalizer is not None else df
        model = LinearMachines.fit(rows, n_classes, n_folds, self.c, max_passes=self.max_iter)
        return model.predict(rows, own_fold=True)


@dataclass
class KNN(Classifier):
    normalizer: Any = None
    neighbors: int = 3
    name: str = "k-Nearest Neighbor"
    abbreviation: str = "KNN"

    def __post_init__(self):
        if self.neighbors < 1:
            raise ValueError("neighbors must be at least 1")

    def _fit(self, train: DataFrame, n_classes: int) -> Fitted:
        rows = dense(train)
        return Fitted(lambda test: knn.knn_predict(rows, dense(test), self.neighbors))

    def left_out(self, df: DataFrame) -> DataFrame:
        return knn.knn_left_out(dense(df), self.neighbors).select("row_id", "predicted_ix")


@dataclass
class NaiveBayes(Classifier):
    normalizer: Any = None
    type_v: str = "gaussian"
    name: str = "Naive Bayes Classifier"
    abbreviation: str = "NBC"

    def __post_init__(self):
        if self.type_v not in ("gaussian", "multinomial"):
            raise ValueError("type_v must be gaussian or multinomial")

    def _fit(self, train: DataFrame, n_classes: int) -> Fitted:
        if self.type_v == "multinomial":
            est = MLNaiveBayes(modelType="multinomial", smoothing=1.0, labelCol="label_ix", featuresCol="features")
            model = est.fit(vectors(train))
            return Fitted(lambda test: _codes(model.transform(vectors(test))))
        gnb = GaussianNB.fit(dense(train).withColumn("fold", F.lit(0)))
        return Fitted(lambda test: gnb.predict(dense(test), leave_out_fold=False).select("row_id", "predicted_ix"))

    def all_folds(self, rows: DataFrame, parts: list, folds: int, widths: list[int], n_classes: int) -> DataFrame:
        """(row_id, predicted_ix) of every row by the model of its step; ``parts`` are the ``FoldFeatures`` of the attributes."""
        start = [F.lit(i << 40) for i in range(len(parts))]  # an attribute's features follow those of the attributes before it

        def scores(table: DataFrame) -> DataFrame:
            of = [table.filter(F.shiftright("feature", 40) == i).withColumn("feature", F.col("feature") - s) for i, s in enumerate(start)]
            return reduce(DataFrame.unionByName, [p.scores(t, n_classes) for p, t in zip(parts, of)])

        sums = [p.sums(n_classes).withColumn("feature", F.col("feature").cast("bigint") + s) for p, s in zip(parts, start)]
        return multinomial_all_folds(rows, reduce(DataFrame.unionByName, sums), scores, folds, widths, n_classes)

    takes_all_folds = property(lambda self: self.normalizer is None)

    def all_folds_dense(self, df: DataFrame, n_folds: int, n_classes: int) -> DataFrame:
        """The same from ``features`` that are equal in all steps; ``df`` has fold and label_ix."""
        rows = dense(df)
        return GaussianNB.fit(rows).predict(rows).select("row_id", "predicted_ix")

    def left_out(self, df: DataFrame) -> DataFrame:
        if self.type_v == "multinomial":
            sizes = F.unwrap_udt("features")
            width = F.size("features") if dict(df.dtypes)["features"].startswith("array") else F.coalesce(sizes["size"], F.size(sizes["values"]))
            n_features, last = df.agg(F.max(width), F.max("label_ix")).first()
            return multinomial_left_out(df, entries(df), n_features or 0, (last or 0) + 1).select("row_id", "predicted_ix")
        rows = dense(df).withColumn("fold", F.lit(0))
        return GaussianNB.fit(rows).predict_left_out(rows).select("row_id", "predicted_ix")


@dataclass
class DecisionTree(Classifier):
    """``side_by_side``: deep in a tree a pass costs dense statistics of its nodes from every partition, hardly any rows, so the
    steps' trees grow at the same time, each in a few partitions."""

    normalizer: Any = None
    random_seed: int | None = None
    criterion: str = "Gini Impurity"
    max_depth: int = 30
    max_bins: int = 256
    name: str = "Decision Tree Classifier"
    abbreviation: str = "DTC"

    side_by_side = True

    # Names of the split criteria.
    CRITERIA = {"Gini Impurity": "gini", "Information Gain": "entropy"}

    def __post_init__(self):
        if self.criterion not in self.CRITERIA:
            raise ValueError(f"criterion must be one of {list(self.CRITERIA)}")

    def _fit(self, train: DataFrame, n_classes: int) -> Fitted:
        tree = DecisionTreeClassifier(
            labelCol="label_ix",
            impurity=self.CRITERIA[self.criterion],
            maxDepth=self.max_depth,
            maxBins=self.max_bins,
            maxMemoryInMB=TREE_MEMORY_MB,
            seed=self.random_seed,
        )
        model = tree.fit(vectors(train))
        return Fitted(lambda test: _codes(model.transform(vectors(test))), model.featureImportances.toArray())


@dataclass
class ANN(Classifier):
    normalizer: Any = field(default_factory=lambda: MinMax(-1, 1))
    network: network.NeuralNetwork = field(default_factory=network.NeuralNetwork)
    name: str = "Artificial Neural Networks"
    abbreviation: str = "ANN"

    def _fit(self, train: DataFrame, n_classes: int) -> Fitted:
        model = self.network.fit(dense(train), n_classes)
        return Fitted(lambda test: model.predict(dense(test)), epochs=model.history)


@dataclass
class Prototypes(Classifier):
    normalizer: Any = None
    evolution: evolve.EvolvedPrototypes = field(default_factory=evolve.EvolvedPrototypes)
    name: str = "Evolved Prototypes"
    abbreviation: str = "EP"

    def _fit(self, train: DataFrame, n_classes: int) -> Fitted:
        model = self.evolution.fit(dense(train))
        return Fitted(lambda test: model.predict(dense(test)))
