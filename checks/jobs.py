"""Whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.features import ATTRIBUTES_SQL, FOLD_VOCAB_SQL, sd_sql
from checks.registry import query, rounded, table
from checks.slice import GNB_SQL, scores_sql
from checks.inputs import dense
from foldmeter.operators import classifiers, extractors, scores
from foldmeter.operators.selection import VarianceSelector
from foldmeter.plans.config import Experiment, StratifiedKFold
from foldmeter.plans.experiment import run_experiment
from foldmeter.plans.profile import profile
from foldmeter.plans.saved import load_experiment, save_experiment
from foldmeter.session import scratch_dir


def _experiment(spark, sf_dir, models, selectors=()):
    config = Experiment(
        label="label",
        attributes={"features": extractors.Pass()},
        validator=StratifiedKFold(5),
        classifiers=models,
        selectors=selectors,
    )
    return run_experiment(dense(spark, sf_dir).select("row_id", "label", "features"), config)


@query(
    "experiment_predictions",
    GNB_SQL + " SELECT step, 'Naive Bayes Classifier' AS classifier, row_id, CAST(label_ix AS VARCHAR) AS real, "
    "CAST(predicted_ix AS VARCHAR) AS predicted FROM gnb",
)
def experiment_predictions(spark, sf_dir):
    result = _experiment(spark, sf_dir, [classifiers.NaiveBayes()])
    return result.predictions.select("step", "classifier", "row_id", "real", "predicted")


@query(
    "experiment_reloaded",
    GNB_SQL + " SELECT step, 'Naive Bayes Classifier' AS classifier, row_id, CAST(label_ix AS VARCHAR) AS real, "
    "CAST(predicted_ix AS VARCHAR) AS predicted FROM gnb",
)
def experiment_reloaded(spark, sf_dir):
    """An experiment saved as text, read back and run."""
    config = Experiment(
        label="label", attributes={"features": extractors.Pass()}, validator=StratifiedKFold(5), classifiers=[classifiers.NaiveBayes()]
    )
    path = scratch_dir(spark)
    save_experiment(spark, config, path)
    again = load_experiment(spark, path)
    result = run_experiment(dense(spark, sf_dir).select("row_id", "label", "features"), again)
    return result.predictions.select("step", "classifier", "row_id", "real", "predicted")


_SUMMARY = ", ".join(f"round(avg({s}), 6) AS {s}" for s in scores.SCORES)


@query(
    "experiment_full",
    GNB_SQL
    + ", predictions AS (SELECT step, 'Naive Bayes Classifier' AS classifier, CAST(label_ix AS VARCHAR) AS real, CAST(predicted_ix AS VARCHAR) AS predicted FROM gnb), "
    + scores_sql("predictions", "'1'")
    + f" SELECT classifier AS name, 'NBC' AS abbreviation, {_SUMMARY} FROM step_scores GROUP BY classifier",
)
def experiment_full(spark, sf_dir):
    """Extract, select, train and score in one call; the summary without its time columns."""
    result = _experiment(spark, sf_dir, [classifiers.NaiveBayes()], [VarianceSelector(0.0)])
    return rounded(result.summary().select("name", "abbreviation", *scores.SCORES))


def _documents_experiment(spark, sf_dir, attributes, models):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    return run_experiment(docs, Experiment(label="lang", attributes=attributes, validator=StratifiedKFold(5), classifiers=models))


@query("experiment_text_table")
def experiment_text_table(spark, sf_dir):
    """Two classifiers on documents, hashed text and length; the summary table."""
    attributes = {"text": extractors.Hashing(non_negative=True, n_features=256), "n_chars": extractors.Pass()}
    return _documents_experiment(
        spark, sf_dir, attributes, [classifiers.NaiveBayes(type_v="multinomial"), classifiers.DecisionTree()]
    ).summary()


MNB_TFIDF_SQL = (
    f"WITH {FOLD_VOCAB_SQL}"
    + """,
lab AS (SELECT doc_id AS row_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS c FROM documents),
tr AS (SELECT v.step, t.row_id, t.term, tf * idf AS value
       FROM tf t JOIN doc USING (row_id) JOIN vocab v ON v.term = t.term AND v.step <> doc.fold),
trn AS (SELECT step, row_id, term, value / sqrt(sum(value * value) OVER (PARTITION BY step, row_id)) AS value FROM tr),
sums AS (SELECT step, c, term, sum(value) AS s FROM trn JOIN lab USING (row_id) GROUP BY ALL),
width AS (SELECT step, count(*) AS n FROM vocab GROUP BY step),
classes AS (SELECT DISTINCT c FROM lab),
tot AS (SELECT w.step, k.c, any_value(w.n) AS width, coalesce(sum(s), 0) AS total
        FROM width w CROSS JOIN classes k LEFT JOIN sums ON sums.step = w.step AND sums.c = k.c GROUP BY ALL),
prior AS (SELECT s.step, c, count(*) AS n FROM steps s JOIN doc ON doc.fold <> s.step JOIN lab USING (row_id) GROUP BY ALL),
ten AS (SELECT step, row_id, term, value / sqrt(sum(value * value) OVER (PARTITION BY row_id)) AS value
        FROM (SELECT v.step, t.row_id, t.term, tf * idf AS value
              FROM tf t JOIN doc USING (row_id) JOIN vocab v ON v.step = doc.fold AND v.term = t.term)),
part AS (SELECT ten.row_id, k.c, sum(ten.value * (ln(coalesce(s, 0) + 1) - ln(total + width))) AS l
         FROM ten CROSS JOIN classes k JOIN tot ON tot.step = ten.step AND tot.c = k.c
         LEFT JOIN sums ON sums.step = ten.step AND sums.term = ten.term AND sums.c = k.c GROUP BY ALL),
scored AS (SELECT doc.row_id, doc.fold, p.c, coalesce(l, 0) + ln(p.n / sum(p.n) OVER (PARTITION BY doc.row_id)) AS score
           FROM doc JOIN prior p ON p.step = doc.fold LEFT JOIN part ON part.row_id = doc.row_id AND part.c = p.c),
best AS (SELECT row_id, fold, c FROM scored QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, c) = 1)
"""
)


@query(
    "experiment_tfidf",
    MNB_TFIDF_SQL
    + "SELECT fold AS step, 'Naive Bayes Classifier' AS classifier, row_id, l.lang AS real, n.lang AS predicted "
    "FROM best JOIN lab l USING (row_id) JOIN (SELECT DISTINCT c, lang FROM lab) n ON n.c = best.c",
)
def experiment_tfidf(spark, sf_dir):
    """Five vocabularies, weights and models from one scan of the text."""
    result = _documents_experiment(spark, sf_dir, {"text": extractors.Tfidf()}, [classifiers.NaiveBayes(type_v="multinomial")])
    return result.predictions.select("step", "classifier", "row_id", "real", "predicted")


@query(
    "timings_recorded",
    "WITH k AS (SELECT unnest(['train_extraction', 'train_selection', 'test_extraction', 'test_selection', 'train', 'test']) AS k), "
    "t AS (SELECT unnest(['time', 'process_time']) AS t) "
    "SELECT CAST(s AS INTEGER) AS step, c AS classifier, k || '_' || t AS metric, CAST(1 AS BIGINT) AS n, true AS valid "
    "FROM range(5) r(s), (SELECT unnest(['Naive Bayes Classifier', 'Decision Tree Classifier']) AS c), k, t "
    "WHERE (SELECT count(*) FROM embeddings) > 0",
)
def timings_recorded(spark, sf_dir):
    """The twelve durations of every step, for a classifier trained for all folds at once and for one trained per step."""
    models = [classifiers.NaiveBayes(), classifiers.DecisionTree(max_depth=3)]
    timings = _experiment(spark, sf_dir, models).timings
    return timings.groupBy("step", "classifier", "metric").agg(
        F.count("*").alias("n"), F.min(F.col("seconds") >= 0).alias("valid")
    )


@query(
    "profile_full",
    f"WITH {ATTRIBUTES_SQL} {sd_sql('num', 'n_chars', '1')} UNION ALL {sd_sql('feats', 'text', '(SELECT count(*) FROM vocab)')} "
    "UNION ALL SELECT 'class ' || lang, count(*), NULL FROM documents GROUP BY lang "
    "UNION ALL SELECT 'total', count(*), round((SELECT stddev_samp(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)), 6) FROM documents",
)
def profile_full(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    config = Experiment(label="lang", attributes={"n_chars": extractors.Pass(), "text": extractors.Tfidf()})
    p = profile(docs, config)
    classes = p.class_stats.select(
        F.concat(F.lit("class "), "class").alias("attribute"), F.col("samples").alias("n_features"), F.lit(None).cast("double").alias("mean_sd")
    )
    total = p.totals.select(F.lit("total").alias("attribute"), F.col("n_samples").alias("n_features"), F.col("sd_samples").alias("mean_sd"))
    return rounded(p.attribute_stats.unionAll(classes).unionAll(total))
