"""Labels, stratified folds, Gaussian naive Bayes and its scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import DENSE_SQL, PREDICTIONS_SQL, dense, dense_folds, orders, predictions
from checks.registry import query, rounded
from foldmeter.operators import bayes, labels, scores, splits

GNB_SQL = (
    "WITH "
    + DENSE_SQL
    + """,
steps AS (SELECT CAST(range AS INTEGER) AS step FROM range(5)),
stats AS (SELECT step, label_ix, feature_ix, avg(v) AS mu, var_pop(v) AS var, count(*) AS n
          FROM long, steps WHERE fold <> step GROUP BY ALL),
eps AS (SELECT step, 1e-9 * max(var) AS eps FROM
          (SELECT step, feature_ix, var_pop(v) AS var FROM long, steps WHERE fold <> step GROUP BY ALL)
        GROUP BY step),
tot AS (SELECT step, count(*) AS n FROM base, steps WHERE fold <> step GROUP BY step),
scored AS (
  SELECT l.row_id, l.fold, l.label_ix, s.label_ix AS c,
         ln(any_value(s.n) / any_value(t.n))
           - 0.5 * sum(ln(2 * pi() * (s.var + e.eps)) + (l.v - s.mu) ** 2 / (s.var + e.eps)) AS score
  FROM long l JOIN stats s ON s.step = l.fold AND s.feature_ix = l.feature_ix
  JOIN eps e ON e.step = l.fold JOIN tot t ON t.step = l.fold
  GROUP BY l.row_id, l.fold, l.label_ix, s.label_ix),
gnb AS (
  SELECT fold AS step, row_id, label_ix, c AS predicted_ix, score AS log_score FROM scored
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, c) = 1)
"""
)


def scores_sql(predictions: str, positive: str) -> str:
    """Score CTEs over ``predictions`` (step, classifier, real, predicted)."""
    names = ["f1", "precision", "recall"]
    avg = ", ".join(f"avg({c}) AS macro_{c}" for c in names)
    wgt = ", ".join(f"sum({c} * n_true) / sum(n_true) AS weighted_{c}" for c in names)
    bin_ = ", ".join(
        f"CASE WHEN count(*) FILTER (n_true > 0) = 2 AND count(*) FILTER (label = {positive}) = 1 "
        f"THEN max(CASE WHEN label = {positive} THEN {c} END) ELSE CAST('nan' AS DOUBLE) END AS binary_{c}"
        for c in names
    )
    return f"""
sides AS (
  SELECT step, classifier, real AS label, 1 AS t, 0 AS p, CASE WHEN real = predicted THEN 1 ELSE 0 END AS hit FROM {predictions}
  UNION ALL
  SELECT step, classifier, predicted, 0, 1, 0 FROM {predictions}),
per_label AS (
  SELECT step, classifier, label, CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(t) AS BIGINT) AS n_true,
         CAST(sum(p) AS BIGINT) AS n_pred,
         coalesce(sum(hit) / nullif(sum(p), 0), 0) AS precision, coalesce(sum(hit) / nullif(sum(t), 0), 0) AS recall
  FROM sides GROUP BY step, classifier, label),
per_class AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per_label),
step_scores AS (
  SELECT step, classifier, sum(tp) / sum(n_true) AS accuracy,
         sum(tp) / sum(n_true) AS micro_f1, sum(tp) / sum(n_pred) AS micro_precision, sum(tp) / sum(n_true) AS micro_recall,
         {avg}, {wgt}, {bin_}
  FROM per_class GROUP BY step, classifier)
"""


STEP_SCORES = "step, classifier, " + ", ".join(f"round({s}, 6) AS {s}" for s in scores.SCORES)
MEAN_SCORES = "classifier, " + ", ".join(f"round(avg({s}), 6) AS {s}" for s in scores.SCORES)


@query(
    "label_encode",
    "SELECT o_orderkey AS row_id, o_orderpriority AS label, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) "
    "AS label_ix FROM orders",
)
def label_encode(spark, sf_dir):
    df = orders(spark, sf_dir).select("row_id", "label")
    return labels.encode(df, labels.label_map(df))


@query(
    "label_decode",
    "WITH m AS (SELECT o_orderkey AS row_id, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS label_ix, "
    "o_orderpriority AS real FROM orders) SELECT row_id, label_ix, real FROM m",
)
def label_decode(spark, sf_dir):
    df = orders(spark, sf_dir).select("row_id", "label")
    mapping = labels.label_map(df)
    coded = labels.encode(df, mapping).select("row_id", "label_ix")
    return labels.decode(coded, mapping, {"label_ix": "real"}).select("row_id", "label_ix", "real")


@query(
    "split_stratified_kfold",
    "SELECT o_orderkey AS row_id, o_orderpriority AS label, "
    "CAST(ntile(5) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
)
def split_stratified(spark, sf_dir):
    return splits.stratified_k_fold(orders(spark, sf_dir).select("row_id", "label"), 5)


@query(
    "gnb_cv_predictions",
    GNB_SQL + " SELECT step, row_id, label_ix, CAST(predicted_ix AS INTEGER) AS predicted_ix, round(log_score, 4) AS log_score FROM gnb",
)
def gnb_cv_predictions(spark, sf_dir):
    df = dense_folds(spark, sf_dir)
    scored = bayes.GaussianNB.fit(df).predict(df)
    return rounded(
        scored.select(F.col("fold").alias("step"), "row_id", "label_ix", "predicted_ix", "log_score"), 4
    )


def gnb_scores(spark, sf_dir):
    """Flagship: stratified 5-fold Gaussian naive Bayes and its mean scores."""
    df = dense_folds(spark, sf_dir)
    predicted = bayes.GaussianNB.fit(df).predict(df).select(
        F.col("fold").alias("step"),
        F.lit("gaussian_nb").alias("classifier"),
        "row_id",
        F.col("label_ix").cast("string").alias("real"),
        F.col("predicted_ix").cast("string").alias("predicted"),
    )
    steps = scores.scores_by_step(scores.confusion_by_step(predicted), positive="1")
    return rounded(scores.mean_scores(steps))


query(
    "scores_mean_gnb",
    GNB_SQL
    + ", predictions AS (SELECT step, 'gaussian_nb' AS classifier, CAST(label_ix AS VARCHAR) AS real, "
    + "CAST(predicted_ix AS VARCHAR) AS predicted FROM gnb), "
    + scores_sql("predictions", "'1'")
    + f" SELECT {MEAN_SCORES} FROM step_scores GROUP BY classifier",
)(gnb_scores)


@query(
    "scores_by_step",
    "WITH " + PREDICTIONS_SQL + "," + scores_sql("predictions", "(SELECT label FROM classes WHERE ix = 1)")
    + f" SELECT {STEP_SCORES} FROM step_scores",
)
def scores_by_step(spark, sf_dir):
    confusion = scores.confusion_by_step(predictions(spark, sf_dir))
    return rounded(scores.scores_by_step(confusion, positive="2-HIGH"))


@query(
    "scores_mean",
    "WITH " + PREDICTIONS_SQL + "," + scores_sql("predictions", "(SELECT label FROM classes WHERE ix = 1)")
    + f" SELECT {MEAN_SCORES} FROM step_scores GROUP BY classifier",
)
def scores_mean(spark, sf_dir):
    confusion = scores.confusion_by_step(predictions(spark, sf_dir))
    return rounded(scores.mean_scores(scores.scores_by_step(confusion, positive="2-HIGH")))
