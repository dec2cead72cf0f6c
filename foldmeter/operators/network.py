"""Dense neural network, trained by one Spark job per epoch.

Rows are dealt to shards by the hash of their id.  In an epoch every shard runs
mini-batch Adam on its own rows, starting from the shared weights; weights and
moments are then averaged, weighted by rows.  Shards, and so the result, depend
on the ids and on ``rows_per_shard``, not on how the input was partitioned.  With
one shard this is ordinary mini-batch training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Activations and the optimizer's constants.
ACTIVATIONS = ("relu", "sigmoid", "softmax")
BETA1, BETA2, ADAM_EPS, PROB_EPS = 0.9, 0.999, 1e-7, 1e-7


@dataclass
class Layer:
    neurons: int = 1
    activation: str = "relu"

    def __post_init__(self):
        if self.neurons < 1 or self.activation not in ACTIVATIONS:
            raise ValueError(f"a layer needs neurons >= 1 and an activation of {ACTIVATIONS}")


def _activate(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0.0)
    if kind == "sigmoid":
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _back(grad: np.ndarray, out: np.ndarray, kind: str) -> np.ndarray:
    """Gradient before the activation from the gradient after it."""
    if kind == "relu":
        return grad * (out > 0)
    if kind == "sigmoid":
        return grad * out * (1.0 - out)
    return out * (grad - (grad * out).sum(axis=1, keepdims=True))


class _Net:
    """Shapes and the flat parameter vector's layout."""

    def __init__(self, sizes: list[int], activations: list[str]):
        self.sizes, self.activations = sizes, activations
        self.n_params = sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))

    def start(self, seed: int | None) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            limit = np.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-limit, limit, a * b), np.zeros(b)]
        return np.concatenate(parts)

    def layers(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
        at = 0
        for a, b, kind in zip(self.sizes, self.sizes[1:], self.activations):
            yield flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b], kind
            at += (a + 1) * b

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        outs = [x]
        for w, b, kind in self.layers(flat):
            outs.append(_activate(outs[-1] @ w + b, kind))
        return outs

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, int]:
        """(mean gradient, summed cross entropy, right predictions)."""
        outs = self.forward(flat, x)
        p = np.clip(outs[-1], PROB_EPS, None)
        total, rows = p.sum(axis=1), np.arange(len(y))
        loss = float((np.log(total) - np.log(p[rows, y])).sum())
        right = int((outs[-1].argmax(axis=1) == y).sum())
        grad = np.repeat(1.0 / total[:, None], p.shape[1], axis=1)
        grad[rows, y] -= 1.0 / p[rows, y]
        grad /= len(y)
        parts: list[np.ndarray] = []
        stack = list(self.layers(flat))
        for i in range(len(stack) - 1, -1, -1):
            grad = _back(grad, outs[i + 1], stack[i][2])
            parts[:0] = [(outs[i].T @ grad).ravel(), grad.sum(axis=0)]
            grad = grad @ stack[i][0].T
        return np.concatenate(parts), loss, right


@dataclass
class NeuralNetwork:
    """Parameters of the network; ``features`` should be scaled, by default to -1..1."""

    hidden: list[Layer] = field(default_factory=list)
    random_seed: int | None = None
    epochs: int = 10
    batch_size: int = 32
    learning_rate: float = 0.001
    out_activation: str = "softmax"
    log: bool = True
    rows_per_shard: int = 8192

    def __post_init__(self):
        if min(self.epochs, self.batch_size, self.rows_per_shard) < 1 or self.learning_rate <= 0:
            raise ValueError("epochs, batch_size and rows_per_shard must be at least 1, learning_rate positive")
        if self.out_activation not in ACTIVATIONS:
            raise ValueError(f"out_activation must be one of {ACTIVATIONS}")

    def fit(self, train: DataFrame, n_classes: int | None = None) -> FittedNetwork:
        """``train`` is (row_id, label_ix, features)."""
        facts = train.agg(F.count("*").alias("n"), F.max("label_ix").alias("c"), F.max(F.size("features")).alias("d")).first()
        classes = n_classes or facts["c"] + 1
        sizes = [facts["d"], *[h.neurons for h in self.hidden], classes]
        net = _Net(sizes, [*[h.activation for h in self.hidden], self.out_activation])
        shards = max(1, -(-facts["n"] // self.rows_per_shard))
        shard = F.pmod(F.xxhash64("row_id"), F.lit(shards)).alias("shard")
        rows = train.select("row_id", "label_ix", "features", shard).repartition("shard").persist()
        groups = int(np.ceil(np.sqrt(shards)))
        params = net.start(self.random_seed)
        state = np.concatenate([params, np.zeros(2 * net.n_params), [0.0]])
        history = []
        for epoch in range(self.epochs):
            state, loss, accuracy = self._epoch(rows, net, state, epoch, groups)
            history.append((epoch + 1, loss, accuracy))
        rows.unpersist()
        return FittedNetwork(net, state[: net.n_params], history if self.log else [])

    def _epoch(self, rows: DataFrame, net: _Net, state: np.ndarray, epoch: int, groups: int) -> tuple[np.ndarray, float, float]:
        spark = rows.sparkSession
        shared = spark.sparkContext.broadcast((net, state, self.batch_size, self.learning_rate))
        order = np.random.default_rng([self.random_seed or 0, epoch]).integers(1 << 31)

        def train_shard(pdf: pd.DataFrame) -> pd.DataFrame:
            net, state, size, rate = shared.value
            p = net.n_params
            w, m, v, t = state[:p].copy(), state[p : 2 * p].copy(), state[2 * p : 3 * p].copy(), state[-1]
            shard = int(pdf.shard.iloc[0])
            loss, right = 0.0, 0
            shuffled = np.argsort(pdf.row_id.to_numpy())[np.random.default_rng([int(order), shard]).permutation(len(pdf))]
            x, y = np.vstack(pdf.features.to_list()), pdf.label_ix.to_numpy()
            for s in range(0, len(pdf), size):
                pick = shuffled[s : s + size]
                g, batch_loss, batch_right = net.gradient(w, x[pick], y[pick])
                t += 1
                m = BETA1 * m + (1 - BETA1) * g
                v = BETA2 * v + (1 - BETA2) * g * g
                step = rate * np.sqrt(1 - BETA2**t) / (1 - BETA1**t)
                w = w - step * m / (np.sqrt(v) + ADAM_EPS)
                loss, right = loss + batch_loss, right + batch_right
            total = len(pdf) * np.concatenate([w, m, v, [t]])
            return pd.DataFrame({"part": [shard], "n": [len(pdf)], "loss": [loss], "hits": [right], "total": [total]})

        def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
            """Sums in a fixed order."""
            pdf = pdf.sort_values("part")
            total = np.add.reduce([np.asarray(x) for x in pdf.total])
            sums = {c: [pdf[c].sum()] for c in ("n", "loss", "hits")}
            return pd.DataFrame({"part": [pdf.group.iloc[0]], **sums, "total": [total]})

        kind = "part bigint, n bigint, loss double, hits bigint, total array<double>"
        parts = rows.groupBy("shard").applyInPandas(train_shard, kind)
        # the square root of the shards' number meets in one task, twice
        for group in (F.pmod("part", F.lit(groups)), F.lit(0).cast("bigint")):
            parts = parts.withColumn("group", group).groupBy("group").applyInPandas(add_up, kind)
        got = parts.first()
        shared.unpersist()
        return np.array(got.total) / got.n, got.loss / got.n, got.hits / got.n


@dataclass
class FittedNetwork:
    net: _Net
    params: np.ndarray
    history: list[tuple[int, float, float]]

    def predict(self, df: DataFrame) -> DataFrame:
        """(row_id, predicted_ix)."""
        shared = df.sparkSession.sparkContext.broadcast((self.net, self.params))

        def best(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="int32")
            net, params = shared.value
            out = net.forward(params, np.vstack(vectors.to_list()))[-1]
            return pd.Series(out.argmax(axis=1).astype("int32"))

        return df.select("row_id", F.pandas_udf(best, "int")("features").alias("predicted_ix"))

    def epoch_log(self, spark, step: int = 0, classifier: str = "network") -> DataFrame:
        """(step, classifier, epoch, loss, accuracy)."""
        rows = [(step, classifier, e, loss, acc) for e, loss, acc in self.history]
        return spark.createDataFrame(rows, "step int, classifier string, epoch int, loss double, accuracy double")
