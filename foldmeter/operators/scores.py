"""Scores and confusion matrices.

One scan of the predictions gives the counts per (step, classifier, real,
predicted); every score is computed from that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldmeter.functions.numbers import ratio
from foldmeter.session import broadcast_if_small

_RUN = ["step", "classifier"]

# Score columns in report order.
SCORES = [
    "accuracy",
    "micro_f1", "micro_precision", "micro_recall",
    "macro_f1", "macro_precision", "macro_recall",
    "weighted_f1", "weighted_precision", "weighted_recall",
    "binary_f1", "binary_precision", "binary_recall",
]


def confusion_by_step(predictions: DataFrame) -> DataFrame:
    """(step, classifier, real, predicted, n)."""
    return predictions.groupBy(*_RUN, "real", "predicted").agg(F.count("*").alias("n"))


def _f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def class_scores(confusion: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 per class, over the union of true and predicted classes."""
    keys = _RUN if keys is None else keys
    hit = F.col("real") == F.col("predicted")
    side = F.explode(
        F.array(
            F.struct(F.col("real").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")),
        )
    )
    counts = (
        confusion.select(*keys, F.when(hit, F.col("n")).otherwise(0).alias("hit"), side.alias("s"))
        .groupBy(*keys, F.col("s.label").alias("label"))
        .agg(
            F.sum(F.when(F.col("s.t") > 0, F.col("hit")).otherwise(0)).alias("tp"),
            F.sum("s.t").alias("n_true"),
            F.sum("s.p").alias("n_pred"),
        )
    )
    p, r = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_true"))
    return counts.select(
        *keys, "label", "tp", "n_true", "n_pred",
        p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"),
    )


def scores_by_step(confusion: DataFrame, positive: str | None) -> DataFrame:
    """All scores of each (step, classifier).

    ``positive`` is the class with code 1.  Binary scores are NaN unless the
    step has exactly two true classes and the positive one is among its labels.
    """
    per_class = class_scores(confusion)
    tp, n_true, n_pred = F.sum("tp"), F.sum("n_true"), F.sum("n_pred")
    micro_p, micro_r = ratio(tp, n_pred), ratio(tp, n_true)
    is_pos = F.col("label") == F.lit(positive)
    defined = (F.count_if(F.col("n_true") > 0) == 2) & (F.count_if(is_pos) == 1)

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("n_true")), n_true)

    def binary(c: str) -> Column:
        return F.when(defined, F.max(F.when(is_pos, F.col(c)))).otherwise(F.lit(float("nan")))

    columns = {"accuracy": micro_r}
    columns |= {"micro_f1": _f1(micro_p, micro_r), "micro_precision": micro_p, "micro_recall": micro_r}
    columns |= {f"macro_{c}": F.avg(c) for c in ("f1", "precision", "recall")}
    columns |= {f"weighted_{c}": weighted(c) for c in ("f1", "precision", "recall")}
    columns |= {f"binary_{c}": binary(c) for c in ("f1", "precision", "recall")}
    return per_class.groupBy(*_RUN).agg(*[columns[s].alias(s) for s in SCORES])


def mean_scores(step_scores: DataFrame) -> DataFrame:
    """Unweighted mean over the steps; one undefined step makes the mean undefined."""
    return step_scores.groupBy("classifier").agg(*[F.avg(s).alias(s) for s in SCORES])


def confusion_total(confusion: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts summed over the steps for every pair of classes, zeros filled in.

    The pairs come from one row per class holding the class list, so their
    number is classes squared by definition of the report.
    """
    names = mapping.agg(F.sort_array(F.collect_list("label"))).scalar()
    found = confusion.groupBy("classifier", "real", "predicted").agg(F.sum("n").alias("n"))
    grid = (
        found.select("classifier")
        .distinct()
        .select("classifier", F.explode(names).alias("real"))
        .select("classifier", "real", F.explode(names).alias("predicted"))
    )
    return grid.join(found, ["classifier", "real", "predicted"], "left").select(
        "classifier", "real", "predicted", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def confusion_matrix(total: DataFrame, classes: list[str]) -> DataFrame:
    """Wide view: one row per true class, one column per predicted class."""
    return total.groupBy("classifier", "real").pivot("predicted", classes).agg(F.sum("n"))


def cross_table(confusion: DataFrame) -> DataFrame:
    """Real x predicted with margins; ``All`` marks a total."""
    cube = confusion.cube("real", "predicted").agg(
        F.sum("n").alias("n"), F.grouping("real").alias("_r"), F.grouping("predicted").alias("_p")
    )
    return cube.select(
        F.when(F.col("_r") == 1, "All").otherwise(F.col("real").cast("string")).alias("real"),
        F.when(F.col("_p") == 1, "All").otherwise(F.col("predicted").cast("string")).alias("predicted"),
        "n",
    )


def class_report(confusion: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted average rows."""
    keys = _RUN if keys is None else keys
    rows = class_scores(confusion, keys)
    names = ["precision", "recall", "f1", "support"]
    per_class = rows.select(
        *keys, F.lit("class").alias("kind"), "label", "precision", "recall", "f1", F.col("n_true").alias("support")
    )
    agg = rows.groupBy(*keys).agg(
        ratio(F.sum("tp"), F.sum("n_true")).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in names[:3]],
        *[ratio(F.sum(F.col(c) * F.col("n_true")), F.sum("n_true")).alias(f"w_{c}") for c in names[:3]],
        F.sum("n_true").alias("support"),
    )
    averages = agg.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit("average").alias("kind"),
                        F.lit(label).alias("label"),
                        *[F.col(f"{prefix}{c}" if prefix else "acc").alias(c) for c in names[:3]],
                    )
                    for label, prefix in (("accuracy", ""), ("macro avg", "m_"), ("weighted avg", "w_"))
                ]
            )
        ).alias("a"),
        "support",
    ).select(*keys, "a.kind", "a.label", "a.precision", "a.recall", "a.f1", "support")
    return per_class.unionByName(averages)


def mean_times(timings: DataFrame) -> DataFrame:
    """Mean seconds over the steps per classifier and metric."""
    return timings.groupBy("classifier", "metric").agg(F.avg("seconds").alias("seconds"))


def prediction_table(predictions: DataFrame, k: int = 0) -> DataFrame:
    """Row number and step from 1, truth, prediction, mismatch mark, k ``name | importance`` columns."""
    tops = [
        F.format_string("%s | %s", F.get("top", F.lit(i))["name"], F.get("top", F.lit(i))["importance"].cast("string"))
        for i in range(k)
    ]
    return predictions.select(
        "classifier",
        (F.col("row_id") + 1).alias("row_number"),
        (F.col("step") + 1).cast("int").alias("step"),
        "real",
        "predicted",
        (F.col("real") != F.col("predicted")).alias("mismatch"),
        *[F.when(F.size("top") > i, t).alias(f"top_{i + 1}") for i, t in enumerate(tops)],
    )


def n_predictions(predictions: DataFrame) -> DataFrame:
    """Rows predicted over all steps, per classifier."""
    return predictions.groupBy("classifier").agg(F.count("*").alias("n_predictions"))


def summary_table(scores: DataFrame, times: DataFrame, classifiers: DataFrame) -> DataFrame:
    """The 19-column summary, one row per classifier in ``position`` order.

    ``classifiers`` is (position, classifier, name, abbreviation); ``times`` the mean times.
    """
    metrics = ["train_time", "test_time", "train_process_time", "test_process_time"]
    wide = times.groupBy("classifier").pivot("metric", metrics).agg(F.first("seconds"))
    wide = wide.select("classifier", *[F.col(m).alias(f"avg_{m}") for m in metrics])
    return (
        broadcast_if_small(classifiers)
        .join(scores, "classifier")
        .join(wide, "classifier", "left")
        .orderBy("position")
        .select("name", "abbreviation", *SCORES, *[f"avg_{m}" for m in metrics])
    )


def step_stats(splits: DataFrame, n_features: DataFrame) -> DataFrame:
    """(step, n_train, n_test, n_features) from role rows and the selected feature counts."""
    counts = splits.groupBy("step").agg(
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.count_if(F.col("role") == "test").alias("n_test"),
    )
    return counts.join(n_features, "step", "left")


def fold_step_stats(df: DataFrame) -> DataFrame:
    """(step, n_train, n_test) of a fold column: the rows outside and inside each fold."""
    per_fold = df.groupBy(F.col("fold").alias("step")).agg(F.count("*").alias("n_test"))
    everything = F.sum("n_test").over(W.partitionBy(F.lit(0)))
    return per_fold.select("step", (everything - F.col("n_test")).alias("n_train"), "n_test")
