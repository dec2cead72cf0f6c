"""Linear and kernel support vector machines, and the features behind their predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.operators.machines import LinearMachines, minimize
from foldmeter.session import broadcast_if_small

# Kernels a machine may use.
KERNELS = ("linear", "poly", "rbf", "sigmoid")


def coefficient_table(spark, matrix: np.ndarray) -> DataFrame:
    """(class, feature_ix, w)."""
    c, j = np.indices(matrix.shape)
    return spark.createDataFrame(
        pd.DataFrame({"class": c.ravel().astype("int32"), "feature_ix": j.ravel().astype("int32"), "w": matrix.ravel()})
    )


def top_features(
    features: DataFrame, predictions: DataFrame, coef: DataFrame, n_features: int, k: int, binary: bool = False
) -> DataFrame:
    """(row_id, top array<struct<feature_ix, importance>>), best first.

    ``features`` is long, ``predictions`` (row_id, predicted_ix).  The importance
    is value x coefficient of the predicted class; with ``binary`` there is one
    coefficient row (class 0) and its sign turns when class 1 is not predicted.
    Absent features weigh 0, so up to k of them, lowest index first, compete too.
    """
    entries = features.join(predictions.select("row_id", "predicted_ix"), "row_id")
    cls = F.lit(0) if binary else F.col("predicted_ix")
    sign = F.when(F.col("predicted_ix") == 1, 1.0).otherwise(-1.0) if binary else F.lit(1.0)
    weighed = (
        entries.withColumn("class", cls)
        .join(broadcast_if_small(coef), ["class", "feature_ix"])
        .select("row_id", "feature_ix", (sign * F.col("value") * F.col("w")).alias("importance"))
    )
    item = F.struct((-F.col("importance")).alias("minus"), F.col("feature_ix").alias("feature_ix"))
    per_row = weighed.groupBy("row_id").agg(F.collect_list(item).alias("found"))  # one row's features
    per_row = predictions.select("row_id").join(per_row, "row_id", "left")
    found = F.coalesce("found", F.array().cast("array<struct<minus:double,feature_ix:int>>"))
    present = F.transform("found", lambda e: e["feature_ix"])
    reach = F.least(F.lit(n_features), F.size("found") + k)
    lowest = F.when(reach > 0, F.sequence(F.lit(0), reach - 1)).otherwise(F.array().cast("array<int>"))
    absent = F.slice(F.array_except(lowest, present), 1, k)
    zeros = F.transform(absent, lambda j: F.struct(F.lit(0.0).alias("minus"), j.alias("feature_ix")))
    best = F.slice(F.array_sort(F.concat("found", zeros)), 1, k)
    return per_row.select("row_id", found.alias("found")).select(
        "row_id",
        F.transform(best, lambda e: F.struct(e["feature_ix"].alias("feature_ix"), (-e["minus"]).alias("importance"))).alias("top"),
    )


def global_top_features(weights: np.ndarray, names: list[str], k: int) -> list[tuple[str, float]]:
    """The k features of the largest weight: tree importances, or the largest absolute coefficient."""
    strength = np.abs(weights) if weights.ndim == 1 else np.abs(weights).max(axis=0)
    order = np.lexsort((np.arange(len(strength)), -strength))[:k]
    return [(names[i], float(strength[i])) for i in order]


def _landmarks(train: DataFrame, n_landmarks: int, seed: int) -> tuple[np.ndarray, float | None]:
    """Landmark rows and the variance of all feature values."""
    rows = train.orderBy(F.xxhash64(F.lit(seed), F.col("row_id")), "row_id").select("features").limit(n_landmarks)
    landmarks = np.array([r[0] for r in rows.collect()], dtype=float)  # n_landmarks rows
    return landmarks, train.select(F.explode("features").alias("v")).agg(F.var_pop("v").alias("v")).first()["v"]


@dataclass
class KernelMap:
    """Kernel values against a bounded set of landmark rows.

    For positive kernels the values are whitened, so that dot products of the
    mapped rows approximate the kernel; a linear machine is then trained on them.
    """

    landmarks: np.ndarray
    kernel: str
    gamma: float
    degree: int
    coef0: float
    whitening: np.ndarray

    @staticmethod
    def fit(train: DataFrame, kernel: str, n_landmarks: int = 200, seed: int = 0, degree: int = 3, coef0: float = 0.0) -> KernelMap:
        if kernel not in KERNELS[1:]:
            raise ValueError(f"kernel must be one of {KERNELS[1:]}")
        return KernelMap.of(*_landmarks(train, n_landmarks, seed), kernel, degree, coef0)

    @staticmethod
    def of(landmarks: np.ndarray, variance: float | None, kernel: str, degree: int = 3, coef0: float = 0.0) -> KernelMap:
        gamma = 1.0 / (landmarks.shape[1] * variance) if variance else 1.0
        out = KernelMap(landmarks, kernel, gamma, degree, coef0, np.eye(len(landmarks)))
        if kernel != "sigmoid":
            values, vectors = np.linalg.eigh(out.raw(landmarks))
            good = values > 1e-10 * values.max()
            out.whitening = vectors[:, good] / np.sqrt(values[good])
        return out

    def raw(self, x: np.ndarray, dot: np.ndarray | None = None) -> np.ndarray:
        """Kernel values of rows; ``dot`` are their products with the landmarks, if these are known."""
        dot = x @ self.landmarks.T if dot is None else dot
        if self.kernel == "poly":
            return (self.gamma * dot + self.coef0) ** self.degree
        if self.kernel == "sigmoid":
            return np.tanh(self.gamma * dot + self.coef0)
        sq = (x * x).sum(1)[:, None] + (self.landmarks**2).sum(1)[None, :] - 2 * dot
        return np.exp(-self.gamma * np.maximum(sq, 0.0))

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        def mapped(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            m = shared.value
            return pd.Series(list(m.raw(np.vstack(vectors.to_list())) @ m.whitening))

        return df.withColumn("features", F.pandas_udf(mapped, "array<double>")("features"))


def kernel_svm_predict(
    train: DataFrame, test: DataFrame, kernel: str, n_landmarks: int = 200, seed: int = 0, max_iter: int = 100, n_classes: int | None = None
) -> DataFrame:
    """(row_id, predicted_ix) of dense test rows."""
    mapping = KernelMap.fit(train, kernel, n_landmarks, seed)
    n_classes = n_classes or train.agg(F.max("label_ix")).first()[0] + 1
    model = LinearMachines.fit(mapping.transform(train), n_classes, max_passes=max_iter)
    return model.predict(mapping.transform(test))


@dataclass
class KernelMachines:
    """Kernel machines of all kernels, folds and classes, trained side by side like ``LinearMachines``.

    Mapped rows are never stored or shipped: a pass reads the plain rows, forms the kernel values of a few rows at a time and
    adds up the gradients of every machine that still moves.  Passes do not grow with kernels, folds or classes.
    """

    maps: dict[tuple[str, int], KernelMap]
    weights: dict[tuple[str, int], np.ndarray]

    @staticmethod
    def fit(
        df: DataFrame,
        folds: int,
        kernels: Sequence[str],
        n_classes: int,
        n_landmarks: int = 200,
        seed: int = 0,
        c: float = 1.0,
        tol: float = 1e-4,
        max_passes: int = 100,
    ) -> KernelMachines:
        """``df`` is (row_id, fold, label_ix, dense features); the machines of a fold never see its rows."""
        if unknown := [k for k in kernels if k not in KERNELS[1:]]:
            raise ValueError(f"kernels must be among {KERNELS[1:]}, not {unknown}")
        seen = [_landmarks(df.filter(F.col("fold") != s), n_landmarks, seed) for s in range(folds)]
        maps = {(k, s): KernelMap.of(*seen[s], k) for s in range(folds) for k in kernels}
        groups = list(maps)
        per = 1 if n_classes == 2 else n_classes
        width = max(m.whitening.shape[1] for m in maps.values()) + 1
        rows = df.select("fold", "label_ix", F.col("features").cast("array<double>").alias("features"))
        counts = np.zeros((folds, n_classes))
        for r in rows.groupBy("fold", "label_ix").count().collect():  # folds x classes rows
            counts[r["fold"], r["label_ix"]] += r["count"]
        used = counts.sum(0) - counts
        good = used[:, 1:] if n_classes == 2 else used
        rest = used.sum(1, keepdims=True) - good
        tols = tol * np.maximum(np.minimum(good, rest), 1) / np.maximum(good + rest, 1)
        context = df.sparkSession.sparkContext
        shared_maps = context.broadcast(maps)
        known = {"x": np.full((width, len(groups) * per), np.nan), "f": np.zeros(len(groups) * per), "g": np.zeros((width, len(groups) * per))}

        def evaluate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            moved = [g for g in range(len(groups)) if not np.array_equal(x[:, g * per : (g + 1) * per], known["x"][:, g * per : (g + 1) * per])]
            shared = context.broadcast({g: x[:, g * per : (g + 1) * per] for g in moved})

            def passed(batches):
                maps, weights = shared_maps.value, shared.value
                sums = {g: np.zeros((width + 1, per)) for g in weights}
                for batch in batches:
                    fold, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    for i, j, x in _dense_blocks(batch.column(2)):
                        sign = np.where(label[i:j, None] == (1 if n_classes == 2 else np.arange(n_classes)[None, :]), 1.0, -1.0)
                        for s in sorted({groups[g][1] for g in weights}):
                            mine = fold[i:j] != s
                            own, y, dot = x[mine], sign[mine], None
                            for g in (g for g in weights if groups[g][1] == s):
                                m, w = maps[groups[g]], weights[g]
                                dot = own @ m.landmarks.T if dot is None else dot
                                raw, d = m.raw(own, dot), m.whitening.shape[1]
                                short = np.maximum(0.0, 1.0 - y * (raw @ (m.whitening @ w[:d]) + w[-1]))
                                pull = -2.0 * y * short
                                sums[g][:d] += m.whitening.T @ (raw.T @ pull)
                                sums[g][width - 1] += pull.sum(0)
                                sums[g][width] += (short * short).sum(0)
                cells = {g: np.flatnonzero(a) for g, a in sums.items()}
                columns = [np.concatenate([np.zeros(0, np.int64), *[cells[g] + g * (width + 1) * per for g in sums]])]
                columns.append(np.concatenate([np.zeros(0), *[sums[g].ravel()[cells[g]] for g in sums]]))
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in columns], names=["cell", "x"])

            if moved:
                found = rows.mapInArrow(passed, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()  # weights, losses
                shared.unpersist()
                flat = np.zeros(len(groups) * (width + 1) * per)
                flat[found.column("cell").to_numpy()] = found.column("x").to_numpy()
                out = c * flat.reshape(len(groups), width + 1, per)
                for g in moved:
                    at = slice(g * per, (g + 1) * per)
                    known["x"][:, at], known["g"][:, at] = x[:, at], out[g, :-1] + x[:, at]
                    known["f"][at] = out[g, -1] + 0.5 * (x[:, at] * x[:, at]).sum(0)
            return known["f"].copy(), known["g"].copy()

        rows = rows.persist()
        machine_tols = np.concatenate([tols[s] for _, s in groups])
        x = minimize(evaluate, (width, len(groups) * per), machine_tols, max_passes)
        rows.unpersist()
        return KernelMachines(maps, {key: x[:, g * per : (g + 1) * per] for g, key in enumerate(groups)})

    def predict(self, df: DataFrame) -> DataFrame:
        """(kernel, row_id, fold, predicted_ix): every row by the machines of its fold.  Ties go to the first class."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        rows = df.select("row_id", "fold", F.col("features").cast("array<double>").alias("features"))
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

        def scored(batches):
            machines = shared.value
            for batch in batches:
                fold = batch.column(1).to_numpy(zero_copy_only=False)
                for kernel in dict.fromkeys(k for k, _ in machines.maps):
                    best = np.zeros(len(batch), np.int32)
                    for i, j, x in _dense_blocks(batch.column(2)):
                        for s in np.unique(fold[i:j]):
                            m, w = machines.maps[kernel, int(s)], machines.weights[kernel, int(s)]
                            mine = np.flatnonzero(fold[i:j] == s)
                            margin = m.raw(x[mine]) @ (m.whitening @ w[: m.whitening.shape[1]]) + w[-1]
                            best[i + mine] = margin[:, 0] > 0 if margin.shape[1] == 1 else margin.argmax(1)
                    columns = [pa.array([kernel] * len(batch), pa.string()), batch.column(0), batch.column(1), pa.array(best)]
                    yield pa.RecordBatch.from_arrays(columns, names=["kernel", "row_id", "fold", "predicted_ix"])

        return rows.mapInArrow(scored, f"kernel string, row_id {kinds['row_id']}, fold {kinds['fold']}, predicted_ix int")


def _dense_blocks(arrays: pa.Array, rows: int = 2048) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, matrix) of equally long arrays, a few rows at a time."""
    if not len(arrays):
        return
    sizes = arrays.value_lengths()
    if arrays.null_count or sizes.to_numpy().min() != sizes.to_numpy().max():
        raise ValueError("all rows need as many features")
    x = arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1)
    for i in range(0, len(arrays), rows):
        yield i, min(i + rows, len(arrays)), x[i : i + rows]
