"""Confusion matrices, reports and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.features import FOLD_VOCAB_SQL
from checks.inputs import PREDICTIONS_SQL, documents, orders, predictions
from checks.registry import query, rounded, table
from checks.slice import MEAN_SCORES, scores_sql
from foldmeter.operators import labels, scores, splits, text
from foldmeter.session import scratch_dir
from foldmeter.sources import csv, results

_P = "WITH " + PREDICTIONS_SQL
_SCORES = _P + "," + scores_sql("predictions", "(SELECT label FROM classes WHERE ix = 1)")
POSITIVE = "2-HIGH"


def _confusion(spark, sf_dir):
    return scores.confusion_by_step(predictions(spark, sf_dir))


@query("confusion_step", _P + " SELECT step, classifier, real, predicted, count(*) AS n FROM predictions GROUP BY ALL")
def confusion_step(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(
    "confusion_total",
    _P
    + " SELECT c.classifier, a.label AS real, b.label AS predicted, count(p.row_id) AS n FROM (SELECT DISTINCT classifier FROM predictions) c "
    "CROSS JOIN classes a CROSS JOIN classes b LEFT JOIN predictions p ON p.classifier = c.classifier AND p.real = a.label AND p.predicted = b.label "
    "GROUP BY ALL",
)
def confusion_total(spark, sf_dir):
    mapping = labels.label_map(orders(spark, sf_dir).select("label"))
    return scores.confusion_total(_confusion(spark, sf_dir), mapping)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "confusion_matrix",
    _P + " SELECT classifier, real, " + ", ".join(f"count(*) FILTER (predicted = '{p}') AS \"{p}\"" for p in PRIORITIES)
    + " FROM predictions GROUP BY ALL",
)
def confusion_matrix(spark, sf_dir):
    mapping = labels.label_map(orders(spark, sf_dir).select("label")).persist()
    total = scores.confusion_total(_confusion(spark, sf_dir), mapping)
    return scores.confusion_matrix(total, labels.class_names(mapping))


@query(
    "crosstab_margins",
    _P
    + " SELECT CASE WHEN grouping(real) = 1 THEN 'All' ELSE real END AS real, CASE WHEN grouping(predicted) = 1 THEN 'All' ELSE predicted END AS predicted, "
    "count(*) AS n FROM predictions WHERE classifier = 'alpha' GROUP BY CUBE (real, predicted)",
)
def crosstab_margins(spark, sf_dir):
    return scores.cross_table(_confusion(spark, sf_dir).filter("classifier = 'alpha'"))


@query(
    "class_report",
    _SCORES
    + """
SELECT step, classifier, 'class' AS kind, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n_true AS support FROM per_class
UNION ALL SELECT step, classifier, 'average', 'accuracy', round(sum(tp) / sum(n_true), 6), round(sum(tp) / sum(n_true), 6), round(sum(tp) / sum(n_true), 6),
  CAST(sum(n_true) AS BIGINT) FROM per_class GROUP BY step, classifier
UNION ALL SELECT step, classifier, 'average', 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(n_true) AS BIGINT)
  FROM per_class GROUP BY step, classifier
UNION ALL SELECT step, classifier, 'average', 'weighted avg', round(sum(precision * n_true) / sum(n_true), 6), round(sum(recall * n_true) / sum(n_true), 6),
  round(sum(f1 * n_true) / sum(n_true), 6), CAST(sum(n_true) AS BIGINT) FROM per_class GROUP BY step, classifier
""",
)
def class_report(spark, sf_dir):
    return rounded(scores.class_report(_confusion(spark, sf_dir)))


TIMES_SQL = """
times AS (SELECT CAST(event_id % 5 AS INTEGER) AS step, CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS classifier,
  list_extract(['train_time', 'test_time', 'train_process_time', 'test_process_time'], CAST(event_id % 4 + 1 AS INTEGER)) AS metric,
  value AS seconds FROM events)
"""


def _times(spark, sf_dir):
    metrics = F.array(*[F.lit(m) for m in ("train_time", "test_time", "train_process_time", "test_process_time")])
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 5).cast("int").alias("step"),
        F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta").alias("classifier"),
        F.get(metrics, (F.col("event_id") % 4).cast("int")).alias("metric"),
        F.col("value").alias("seconds"),
    )


@query("timings_mean", f"WITH {TIMES_SQL} SELECT classifier, metric, round(avg(seconds), 6) AS seconds FROM times GROUP BY ALL")
def timings_mean(spark, sf_dir):
    return rounded(scores.mean_times(_times(spark, sf_dir)))


TOP_SQL = "CASE WHEN h % 2 < {i} THEN NULL ELSE 'f' || (h % 7 + {i}) || ' | ' || CAST((h % 1000) / 8.0 - {i} AS DOUBLE) END AS top_{j}"
_WITH_H = PREDICTIONS_SQL.replace("SELECT step, classifier, row_id, real,\n         CASE", "SELECT step, classifier, row_id, real, h,\n         CASE")


def _with_top(spark, sf_dir):
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "classifier", F.col("row_id").cast("string"))), 1, 6), 16, 10).cast("bigint")
    entry = lambda i: F.struct(
        F.concat(F.lit("f"), (h % 7 + i).cast("string")).alias("name"), (h % 1000 / 8.0 - i).cast("double").alias("importance")
    )
    return predictions(spark, sf_dir).withColumn("top", F.slice(F.array(entry(0), entry(1)), 1, (h % 2 + 1).cast("int")))


@query(
    "prediction_table",
    "WITH " + _WITH_H + f" SELECT classifier, row_id + 1 AS row_number, step + 1 AS step, real, predicted, real <> predicted AS mismatch, "
    f"{TOP_SQL.format(i=0, j=1)}, {TOP_SQL.format(i=1, j=2)} FROM predictions",
)
def prediction_table(spark, sf_dir):
    return scores.prediction_table(_with_top(spark, sf_dir), 2)


@query("prediction_count", _P + " SELECT classifier, count(*) AS n_predictions FROM predictions GROUP BY classifier")
def prediction_count(spark, sf_dir):
    return scores.n_predictions(predictions(spark, sf_dir))


_WIDE_TIMES = ", ".join(
    f"round(avg(seconds) FILTER (metric = '{m}'), 6) AS avg_{m}"
    for m in ("train_time", "test_time", "train_process_time", "test_process_time")
)


@query(
    "summary_table",
    _SCORES
    + f", {TIMES_SQL}, means AS (SELECT {MEAN_SCORES} FROM step_scores GROUP BY classifier), "
    f"wide AS (SELECT classifier, {_WIDE_TIMES} FROM times GROUP BY classifier) "
    "SELECT CASE classifier WHEN 'alpha' THEN 'Alpha machine' ELSE 'Beta machine' END AS name, upper(classifier[1]) AS abbreviation, "
    "* EXCLUDE (classifier) FROM means JOIN wide USING (classifier)",
)
def summary_table(spark, sf_dir):
    mean = scores.mean_scores(scores.scores_by_step(_confusion(spark, sf_dir), POSITIVE))
    order = spark.createDataFrame(
        [(1, "beta", "Beta machine", "B"), (0, "alpha", "Alpha machine", "A")],
        "position int, classifier string, name string, abbreviation string",
    )
    return rounded(scores.summary_table(mean, scores.mean_times(_times(spark, sf_dir)), order))


@query(
    "step_stats",
    f"WITH {FOLD_VOCAB_SQL}, sizes AS (SELECT fold AS step, count(*) AS n_test FROM doc GROUP BY fold) "
    "SELECT step, (SELECT count(*) FROM doc) - n_test AS n_train, n_test, n_features FROM sizes "
    "JOIN (SELECT step, count(*) AS n_features FROM vocab GROUP BY step) USING (step)",
)
def step_stats(spark, sf_dir):
    folded = splits.stratified_k_fold(documents(spark, sf_dir), 5)
    vocab, _ = text.tfidf_by_fold(folded, 5)
    n_features = vocab.groupBy("step").agg(F.count("*").alias("n_features"))
    return scores.fold_step_stats(folded).join(n_features, "step")


@query("results_saved", _P + " SELECT step, classifier, row_id, real, predicted FROM predictions")
def results_saved(spark, sf_dir):
    """Predictions written with their configuration, then read back."""
    path = scratch_dir(spark)
    results.save_results({"predictions": predictions(spark, sf_dir)}, {"folds": 5}, path)
    back, config = results.load_results(spark, path, ["predictions"])
    assert config == {"folds": 5}
    return back["predictions"].select("step", "classifier", "row_id", "real", "predicted")


@query(
    "report_export",
    _P + " SELECT CAST(step AS VARCHAR) AS step, classifier, real, predicted, CAST(count(*) AS VARCHAR) AS n FROM predictions GROUP BY ALL",
)
def report_export(spark, sf_dir):
    path = scratch_dir(spark)
    csv.write_csv(_confusion(spark, sf_dir), path)
    return csv.read_csv(spark, path)
