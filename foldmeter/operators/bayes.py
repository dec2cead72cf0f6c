"""Naive Bayes classifiers, trained for all folds in one job.

Sums are kept per fold, so the model of step ``s`` is the merge of the other
folds' sums: the rows are scanned once, not once per step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.session import cut_lineage

VAR_SMOOTHING = 1e-9


def class_moments(df: DataFrame, keys: tuple[str, ...] = ("fold", "label_ix")) -> DataFrame:
    """(keys, feature_ix, n, mean, m2) of a dense ``features`` array.

    Rows explode inside the scan stage and meet a map-side aggregate, so only
    keys x features rows are shuffled.
    """
    long = df.select(*keys, F.posexplode("features").alias("feature_ix", "v"))
    return long.groupBy(*keys, "feature_ix").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("m2")
    )


def _merge(n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge moments along axis 0; empty cells have n = 0."""
    total = n.sum(axis=0)
    safe = np.where(total == 0, 1, total)
    mu = (n * mean).sum(axis=0) / safe
    return total, mu, (m2 + n * (mean - mu) ** 2).sum(axis=0)


@dataclass
class GaussianNB:
    """Moments per (fold, class, feature); ``n[f, c]``, ``mean[f, c, j]``, ``m2[f, c, j]``."""

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    @staticmethod
    def fit(df: DataFrame) -> GaussianNB:
        """``df`` has fold, label_ix and features; a frame without folds is one fold -1."""
        if "fold" not in df.columns:
            df = df.withColumn("fold", F.lit(0))
        rows = class_moments(df).toPandas()  # folds x classes x features rows
        shape = (int(rows.fold.max()) + 1, int(rows.label_ix.max()) + 1, int(rows.feature_ix.max()) + 1)
        at = (rows.fold.to_numpy(), rows.label_ix.to_numpy(), rows.feature_ix.to_numpy())
        n, mean, m2 = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        n[at], mean[at], m2[at] = rows.n, rows["mean"], rows.m2
        return GaussianNB(n[:, :, 0], mean, m2)

    def step_model(self, step: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class rows, means, variances) from all folds except ``step``."""
        keep = [f for f in range(self.n.shape[0]) if f != step]
        n, mean, m2 = _merge(self.n[keep][:, :, None], self.mean[keep], self.m2[keep])
        _, _, pooled = _merge(n, mean, m2)
        eps = VAR_SMOOTHING * (pooled / n.sum()).max()
        return n[:, 0], mean, m2 / np.where(n == 0, 1, n) + eps

    def predict(self, df: DataFrame, leave_out_fold: bool = True) -> DataFrame:
        """Add ``predicted_ix`` and its joint log likelihood ``log_score``.

        With ``leave_out_fold`` a row is scored by the model of its own step.
        """
        steps = range(self.n.shape[0]) if leave_out_fold else [None]
        models = df.sparkSession.sparkContext.broadcast([self.step_model(s) for s in steps])

        def score(folds: pd.Series, vectors: pd.Series) -> pd.DataFrame:
            best = np.full(len(folds), -1, dtype="int32")
            value = np.full(len(folds), np.nan)
            x = np.vstack(vectors.to_list()) if len(folds) else np.zeros((0, 1))
            for s in np.unique(folds):
                rows = np.flatnonzero(folds == s)
                counts, mean, var = models.value[int(s)]
                part = x[rows]
                scores = np.full((len(rows), len(counts)), -np.inf)
                for c in np.flatnonzero(counts):
                    density = np.log(2 * np.pi * var[c]) + (part - mean[c]) ** 2 / var[c]
                    scores[:, c] = np.log(counts[c] / counts.sum()) - 0.5 * density.sum(axis=1)
                best[rows] = scores.argmax(axis=1)
                value[rows] = scores.max(axis=1)
            return pd.DataFrame({"predicted_ix": best, "log_score": value})

        step = F.col("fold").cast("int") if leave_out_fold else F.lit(0)
        return _with_prediction(df, F.pandas_udf(score, "predicted_ix int, log_score double")(step, "features"))

    def predict_left_out(self, df: DataFrame) -> DataFrame:
        """Leave-one-out over the fitted rows: each row is taken out of its own class's moments."""
        n, mean, m2 = _merge(self.n[:, :, None], self.mean, self.m2)
        total, all_mean, all_m2 = _merge(n, mean, m2)
        shared = df.sparkSession.sparkContext.broadcast((n[:, 0], mean, m2, total[0], all_mean, all_m2))

        def without(x, count, mu, square_sum):
            left = np.maximum(count - 1, 1)
            new_mu = mu - (x - mu) / left
            return new_mu, np.maximum(square_sum - (x - mu) * (x - new_mu), 0.0)

        def score(labels: pd.Series, vectors: pd.Series) -> pd.DataFrame:
            counts, mu, square_sum, n_all, mu_all, square_all = shared.value
            x = np.vstack(vectors.to_list()) if len(labels) else np.zeros((0, mu.shape[1]))
            own = labels.to_numpy()
            _, rest = without(x, n_all, mu_all, square_all)
            eps = VAR_SMOOTHING * (rest / (n_all - 1)).max(axis=1, initial=0.0)[:, None]
            scores = np.full((len(own), len(counts)), -np.inf)
            for c in range(len(counts)):
                mine = own == c
                own_mu, own_square = without(x, counts[c], mu[c], square_sum[c])
                left = counts[c] - mine
                center = np.where(mine[:, None], own_mu, mu[c])
                var = np.where(mine[:, None], own_square, square_sum[c]) / np.maximum(left, 1)[:, None] + eps
                density = (np.log(2 * np.pi * var) + (x - center) ** 2 / var).sum(axis=1)
                with np.errstate(divide="ignore"):
                    prior = np.log(left / (n_all - 1))
                scores[:, c] = np.where(left > 0, prior - 0.5 * density, -np.inf)
            return pd.DataFrame({"predicted_ix": scores.argmax(axis=1).astype("int32"), "log_score": scores.max(axis=1)})

        return _with_prediction(df, F.pandas_udf(score, "predicted_ix int, log_score double")("label_ix", "features"))


def _with_prediction(df: DataFrame, scored: Column) -> DataFrame:
    return df.withColumn("_p", scored).select(*df.columns, "_p.predicted_ix", "_p.log_score")


SMOOTHING = 1.0


def multinomial_log_probabilities(features: DataFrame, folds: int, n_features: int) -> tuple[DataFrame, np.ndarray]:
    """Per (step, feature) the log probability of each class, and log priors[step, class].

    ``features`` is long: (row_id, fold, label_ix, feature_ix, value).  Sums are
    kept per fold; a step adds up the other folds.
    """
    v = F.col("value")
    v = F.when(v < 0, F.raise_error(F.lit("multinomial model: negative feature value")).cast("double")).otherwise(v)
    sums = features.groupBy("label_ix", "feature_ix").agg(
        F.array(*[F.sum(F.when(F.col("fold") == f, v).otherwise(0.0)) for f in range(folds)]).alias("s")
    )
    others = [sum((F.get("s", F.lit(f)) for f in range(folds) if f != s), F.lit(0.0)) for s in range(folds)]
    by_step = sums.select("label_ix", "feature_ix", F.posexplode(F.array(*others)).alias("step", "s"))
    by_step = cut_lineage(by_step)
    totals = by_step.groupBy("step", "label_ix").agg(F.sum("s").alias("total")).toPandas()  # steps x classes
    n_classes = int(totals.label_ix.max()) + 1
    total = np.zeros((folds, n_classes))
    total[totals.step, totals.label_ix] = totals.total
    floor = [[float(-np.log(t + SMOOTHING * n_features)) for t in row] for row in total]
    wide = by_step.groupBy("step", "feature_ix").agg(
        *[F.sum(F.when(F.col("label_ix") == c, F.col("s")).otherwise(0.0)).alias(f"s{c}") for c in range(n_classes)]
    )
    base = F.array(*[F.array(*[F.lit(x) for x in row]) for row in floor])
    log_p = [
        (F.log(F.col(f"s{c}") + SMOOTHING) + F.get(F.get(base, F.col("step")), F.lit(c))).alias(f"p{c}")
        for c in range(n_classes)
    ]
    return wide.select("step", "feature_ix", *log_p), total


def multinomial_cross_validated(rows: DataFrame, features: DataFrame, folds: int, n_features: int) -> DataFrame:
    """(row_id, predicted_ix, log_score) for every row by the model of its step.

    ``rows`` is (row_id, fold, label_ix) and may hold rows without any feature.
    """
    from foldmeter.operators.lookup import lookup_join

    features = cut_lineage(features)
    table, total = multinomial_log_probabilities(features, folds, n_features)
    n_classes = total.shape[1]
    counts = np.zeros((folds, n_classes))
    for r in rows.groupBy("fold", "label_ix").count().collect():  # folds x classes rows
        counts[r["fold"], r["label_ix"]] = r["count"]
    train = counts.sum(axis=0) - counts
    with np.errstate(divide="ignore"):
        prior = np.log(train / train.sum(axis=1, keepdims=True))
    weight = features.groupBy(F.col("fold").alias("step"), "feature_ix").agg(F.count("*").alias("w"))
    table = cut_lineage(table.join(weight, ["step", "feature_ix"]))
    entries = features.select("row_id", F.col("fold").alias("step"), "feature_ix", "value")
    hits = lookup_join(entries, table, ["step", "feature_ix"], "w")
    sums = hits.groupBy("row_id").agg(
        *[F.sum(F.col("value") * F.col(f"p{c}")).alias(f"l{c}") for c in range(n_classes)]
    )
    joined = rows.select("row_id", F.col("fold").alias("step")).join(sums, "row_id", "left")
    base = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in prior])
    scores = [
        F.struct(
            (F.coalesce(F.col(f"l{c}"), F.lit(0.0)) + F.get(F.get(base, F.col("step")), F.lit(c))).alias("score"),
            F.lit(-c).alias("c"),
        )
        for c in range(n_classes)
    ]
    best = F.array_max(F.array(*scores))
    return joined.select("row_id", best.alias("b")).select(
        "row_id", (-F.col("b.c")).alias("predicted_ix"), F.col("b.score").alias("log_score")
    )


def fold_sums(train: DataFrame, folds: int) -> DataFrame:
    """(label_ix, feature, s0.., w0..) of long training entries (row_id, fold, label_ix, feature, values): what step i adds up, and
    whether it tests the entry.  Rows of one class and feature are parts of one sum."""
    negative = F.raise_error(F.lit("multinomial model: negative feature value")).cast("double")

    def own(s: int) -> Column:
        v = F.get("values", F.lit(s))
        return F.when(F.col("fold") == s, F.lit(0.0)).when(v < 0, negative).otherwise(v)

    tested = [F.when(F.col("fold") == s, 1).otherwise(0).cast("bigint").alias(f"w{s}") for s in range(folds)]
    return train.select("label_ix", "feature", *[own(s).alias(f"s{s}") for s in range(folds)], *tested)


def step_sum(step: Column, c: int, folds: int) -> Column:
    """Class ``c``'s sum of a step in ``multinomial_all_folds``'s table."""
    return F.get(F.array(*[f"s{s}_{c}" for s in range(folds)]), step)


def fold_scores(test: DataFrame, table: DataFrame, folds: int, n_classes: int) -> DataFrame:
    """(row_id, size, l0..) of long test entries (row_id, fold, feature, value), in parts to be added up: values, and for every
    class their product with the logarithm of its sum in ``table`` (feature, n, w0.., s0_0..), sums being by step and class."""
    from foldmeter.operators.lookup import lookup_join

    steps = table.withColumn("_w", F.array(*[f"w{s}" for s in range(folds)])).select("*", F.posexplode("_w").alias("fold", "w")).filter("w > 0")
    logs = [F.log(step_sum(F.col("fold"), c, folds) + SMOOTHING).alias(f"p{c}") for c in range(n_classes)]
    hits = lookup_join(test, cut_lineage(steps.select("fold", "feature", "w", *logs)), ["fold", "feature"], "w")
    value = F.col("value")
    return hits.select("row_id", value.alias("size"), *[(value * F.col(f"p{c}")).alias(f"l{c}") for c in range(n_classes)])


def multinomial_all_folds(
    rows: DataFrame, sums: DataFrame, scores: Callable[[DataFrame], DataFrame], folds: int, widths: list[int], n_classes: int
) -> DataFrame:
    """(row_id, predicted_ix) for every row by the model of its step, where features differ from step to step.

    ``rows`` is (row_id, fold, label_ix), ``sums`` like ``fold_sums``, ``scores(table)`` like ``fold_scores``, both in any number of
    parts, and ``widths`` the number of features per step.  One grouping by feature holds the sums of all steps and classes;
    classes x steps numbers reach the driver.
    """
    cells = [(s, c) for s in range(folds) for c in range(n_classes)]
    of = [F.sum(F.when(F.col("label_ix") == c, F.col(f"s{s}")).otherwise(0.0)).alias(f"s{s}_{c}") for s, c in cells]
    tested = [F.sum(f"w{s}") for s in range(folds)]
    tested = [sum(tested[1:], tested[0]).alias("n"), *[w.alias(f"w{s}") for s, w in enumerate(tested)]]
    cube = cut_lineage(sums.groupBy("feature").agg(*tested, *of))
    sum_of = cube.agg(*[F.sum(f"s{s}_{c}").alias(f"{s}_{c}") for s, c in cells]).first()
    floor = np.array([[-np.log((sum_of[f"{s}_{c}"] or 0.0) + SMOOTHING * widths[s]) if widths[s] else 0.0 for c in range(n_classes)] for s in range(folds)])
    counts = np.zeros((folds, n_classes))
    for r in rows.groupBy("fold", "label_ix").count().collect():  # folds x classes rows
        counts[r["fold"], r["label_ix"]] = r["count"]
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = counts.sum(axis=0) - counts
        prior = np.log(seen / seen.sum(axis=1, keepdims=True))

    def lit(table: np.ndarray) -> Column:
        return F.get(F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table]), F.col("fold"))

    scored = scores(cube).groupBy("row_id").agg(F.sum("size").alias("size"), *[F.sum(f"l{c}").alias(f"l{c}") for c in range(n_classes)])
    joined = rows.select("row_id", "fold").join(scored, "row_id", "left")
    zero = F.lit(0.0)
    totals = [
        F.coalesce(F.col(f"l{c}") + F.col("size") * F.get(lit(floor), F.lit(c)), zero) + F.get(lit(prior), F.lit(c)) for c in range(n_classes)
    ]
    best = F.array_max(F.array(*[F.struct(t.alias("score"), F.lit(-c).alias("c")) for c, t in enumerate(totals)]))
    return joined.select("row_id", (-best["c"]).alias("predicted_ix"))


def multinomial_left_out(rows: DataFrame, entries: DataFrame, n_features: int, n_classes: int) -> DataFrame:
    """(row_id, predicted_ix, log_score): leave-one-out in closed form, for any number of rows.

    ``rows`` is (row_id, label_ix), ``entries`` (row_id, feature_ix, value).  A row's model is that of all rows with the row's
    own values taken out of its class's sums and counts, so one grouping and one lookup serve every row.
    """
    from foldmeter.operators.lookup import lookup_join
    v = F.col("value")
    v = F.when(v < 0, F.raise_error(F.lit("multinomial model: negative feature value")).cast("double")).otherwise(v)
    labelled = entries.select("row_id", "feature_ix", v.alias("value")).join(rows.select("row_id", "label_ix"), "row_id")
    mine = [F.col("label_ix") == c for c in range(n_classes)]
    sums = labelled.groupBy("feature_ix").agg(
        F.count("*").alias("w"), *[F.sum(F.when(m, F.col("value")).otherwise(0.0)).alias(f"s{c}") for c, m in enumerate(mine)]
    )
    sums = cut_lineage(sums)
    total = sums.agg(*[F.coalesce(F.sum(f"s{c}"), F.lit(0.0)) for c in range(n_classes)]).first()
    found = {r["label_ix"]: r["count"] for r in rows.groupBy("label_ix").count().collect()}  # one row per class
    counts = [found.get(c, 0) for c in range(n_classes)]
    rest = max(sum(counts) - 1, 1)
    hits = lookup_join(labelled, sums, ["feature_ix"], "w")
    value = F.col("value")
    left = [F.log(F.col(f"s{c}") - F.when(m, value).otherwise(0.0) + SMOOTHING) for c, m in enumerate(mine)]
    per_row = hits.groupBy("row_id").agg(F.sum(value).alias("size"), *[F.sum(value * x).alias(f"l{c}") for c, x in enumerate(left)])
    joined = rows.select("row_id", "label_ix").join(per_row, "row_id", "left").withColumn("size", F.coalesce("size", F.lit(0.0)))
    scores = []
    for c, m in enumerate(mine):
        n = F.lit(float(counts[c])) - F.when(m, 1.0).otherwise(0.0)
        size = F.lit(float(total[c]) + SMOOTHING * n_features) - F.when(m, F.col("size")).otherwise(0.0)
        prior = F.when(n > 0, F.log(n / rest)).otherwise(F.lit(float("-inf")))
        score = prior + F.coalesce(F.col(f"l{c}"), F.lit(0.0)) - F.col("size") * F.log(size)
        scores.append(F.struct(score.alias("score"), F.lit(-c).alias("c")))
    best = F.array_max(F.array(*scores))
    return joined.select("row_id", (-best["c"]).alias("predicted_ix"), best["score"].alias("log_score"))
