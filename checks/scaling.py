"""Normalizers and selectors."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, MaxAbsScaler, VarianceThresholdSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from checks.features import TERMS_SQL, VOCAB_SQL, _tfidf_sql
from checks.inputs import DENSE_SQL, dense_folds, documents
from checks.registry import query, rounded, table
from foldmeter.operators import classifiers, extractors, features, scaling, selection, text
from foldmeter.session import cut_lineage, drop_scratch, recorded_scratch

# Fit on the rows outside fold 0, transform all rows.
_ALL = "FROM long JOIN p USING (feature_ix)"


def _split(spark, sf_dir):
    df = dense_folds(spark, sf_dir).select("row_id", "fold", "label_ix", "features")
    return df.filter("fold <> 0"), df


def _out(df):
    return rounded(df.select("row_id", F.posexplode("features").alias("feature_ix", "value")))


def _sql(params: str, value: str) -> str:
    return (
        f"WITH {DENSE_SQL}, p AS (SELECT feature_ix, {params} FROM long WHERE fold <> 0 GROUP BY feature_ix) "
        f"SELECT row_id, feature_ix, round({value}, 6) AS value {_ALL}"
    )


for _norm, _len in (("l1", "sum(abs(v)) OVER r"), ("l2", "sqrt(sum(v * v) OVER r)")):
    query(
        f"norm_{_norm}",
        f"WITH {DENSE_SQL} SELECT row_id, feature_ix, round(v / {_len}, 6) AS value FROM long WINDOW r AS (PARTITION BY row_id)",
    )(lambda spark, sf_dir, norm=_norm: _out(scaling.normalize_rows(dense_folds(spark, sf_dir), norm)))


@query(
    "scale_minmax",
    _sql("min(v) AS lo, max(v) AS hi", "-1 + (v - lo) * 2 / CASE WHEN hi = lo THEN 1 ELSE hi - lo END"),
)
def scale_minmax(spark, sf_dir):
    train, rows = _split(spark, sf_dir)
    return _out(scaling.min_max(train, -1, 1).transform(rows))


@query("scale_standard", _sql("avg(v) AS m, stddev_pop(v) AS sd", "(v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END"))
def scale_standard(spark, sf_dir):
    train, rows = _split(spark, sf_dir)
    return _out(scaling.standard(train).transform(rows))


@query(
    "scale_robust",
    _sql(
        "quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b",
        "(v - m) / CASE WHEN b = a THEN 1 ELSE b - a END",
    ),
)
def scale_robust(spark, sf_dir):
    train, rows = _split(spark, sf_dir)
    return _out(scaling.robust(train).transform(rows))


LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PARAMS = ", ".join(
    f"({i}, (SELECT min({c}) FROM lineitem), (SELECT max({c}) FROM lineitem), (SELECT avg({c}) FROM lineitem), "
    f"(SELECT stddev_pop({c}) FROM lineitem), (SELECT quantile_cont({c}, 0.25) FROM lineitem), "
    f"(SELECT quantile_cont({c}, 0.5) FROM lineitem), (SELECT quantile_cont({c}, 0.75) FROM lineitem))"
    for i, c in enumerate(LINEITEM)
)


@query(
    "scaling_parameters_lineitem",
    "SELECT CAST(i AS INTEGER) AS feature_ix, round(lo, 6) AS minimum, round(hi - lo, 6) AS span, round(m, 6) AS mean, round(sd, 6) AS sd, "
    f"round(q2, 6) AS median, round(q3 - q1, 6) AS iqr FROM (VALUES {_PARAMS}) t(i, lo, hi, m, sd, q1, q2, q3)",
)
def scaling_parameters_lineitem(spark, sf_dir):
    df = features.pass_attributes(table(spark, sf_dir, "lineitem").select(*LINEITEM), LINEITEM)
    parts = [
        (scaling.min_max(df), "minimum", "span"),
        (scaling.standard(df), "mean", "sd"),
        (scaling.robust(df), "median", "iqr"),
    ]
    out = None
    for scaler, a, b in parts:
        p = scaler.params.select("feature_ix", F.col("shift").alias(a), F.col("range").alias(b))
        out = p if out is None else out.join(p, "feature_ix")
    return rounded(out)


def _sparse_sql(params: str, shift: str, spread: str, gain: str = "1", low: str = "0") -> str:
    """Scaled stored entries of TF-IDF rows, and the scaled zero of their feature."""
    return (
        f"WITH {VOCAB_SQL}, {_tfidf_sql('l2')}, c AS (SELECT count(*) AS total FROM documents), p0 AS ({params}), "
        f"p AS (SELECT feature_ix, {shift} AS shift, CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END AS spread FROM p0) "
        f"SELECT row_id, feature_ix, round({low} + (value - shift) * {gain} / spread, 6) AS value, "
        f"round({low} - shift * {gain} / spread + 0.0, 6) AS zero FROM feats JOIN p USING (feature_ix)"
    )


def _sparse_out(spark, sf_dir, fit):
    docs = documents(spark, sf_dir)
    with recorded_scratch() as made:
        found = text.Tfidf.fit(docs).transform(docs)
    feats = cut_lineage(found, "zstd")  # read for every statistic and to be scaled
    drop_scratch(spark, made)
    return rounded(fit(feats, docs.count()).transform(feats))


@query(
    "scale_minmax_sparse",
    _sparse_sql(
        "SELECT feature_ix, CASE WHEN count(*) < any_value(total) THEN least(min(value), 0) ELSE min(value) END AS lo, "
        "CASE WHEN count(*) < any_value(total) THEN greatest(max(value), 0) ELSE max(value) END AS hi FROM feats, c GROUP BY feature_ix",
        "lo",
        "(hi - lo)",
        "2",
        "-1",
    ),
)
def scale_minmax_sparse(spark, sf_dir):
    return _sparse_out(spark, sf_dir, lambda e, n: scaling.sparse_min_max(e, n, -1, 1))


@query(
    "scale_standard_sparse",
    _sparse_sql(
        "SELECT feature_ix, sum(value) / any_value(total) AS m, sqrt((sum(value * value) - sum(value) ** 2 / any_value(total)) / any_value(total)) AS sd "
        "FROM feats, c GROUP BY feature_ix",
        "m",
        "sd",
    ),
)
def scale_standard_sparse(spark, sf_dir):
    return _sparse_out(spark, sf_dir, scaling.sparse_standard)


_AT = ", ".join(
    f"coalesce(max(value) FILTER (r = floor((total - 1) * {p})), 0) + (coalesce(max(value) FILTER (r = ceil((total - 1) * {p})), 0) "
    f"- coalesce(max(value) FILTER (r = floor((total - 1) * {p})), 0)) * ((any_value(total) - 1) * {p} - floor((any_value(total) - 1) * {p})) AS q{i}"
    for i, p in enumerate((0.25, 0.5, 0.75))
)


@query(
    "scale_robust_sparse",
    _sparse_sql(
        f"SELECT feature_ix, {_AT} FROM (SELECT feature_ix, value, total, row_number() OVER w - 1 + CASE WHEN value > 0 "
        "THEN total - count(*) OVER (PARTITION BY feature_ix) ELSE 0 END AS r FROM feats, c WINDOW w AS (PARTITION BY feature_ix ORDER BY value)) "
        "GROUP BY feature_ix",
        "q1",
        "(q2 - q0)",
    ),
)
def scale_robust_sparse(spark, sf_dir):
    return _sparse_out(spark, sf_dir, scaling.sparse_robust)


@query(
    "ml_stages",
    f"""WITH {TERMS_SQL},
c AS (SELECT count(*) AS total FROM documents),
kept AS (SELECT term, max(tf) AS top FROM tf, c GROUP BY term
         HAVING (sum(tf * tf) - sum(tf) ** 2 / any_value(total)) / (any_value(total) - 1) > 0.25)
SELECT row_id, 'text : ' || term AS name, round(tf / top, 6) AS value FROM tf JOIN kept USING (term)""",
)
def ml_stages(spark, sf_dir):
    """Stages of ``pyspark.ml`` as extractor, selector and normalizer: counts, variance threshold, division by the maximum."""
    docs = documents(spark, sf_dir).withColumn("label_ix", F.lit(0))
    extractor = extractors.MLStages([CountVectorizer(vocabSize=1 << 30)], tokens=True).fit(docs, "text")
    rows = extractor.vector(docs, "features").select("row_id", "label_ix", "features").persist()
    selector = selection.MLSelector(VarianceThresholdSelector(varianceThreshold=0.25)).fit(rows)
    chosen = selector.transform(rows)
    scaled = classifiers.MLNormalizer(MaxAbsScaler()).fit(chosen).transform(chosen)
    names = spark.createDataFrame(list(enumerate(selector.names(extractor.names))), "feature_ix int, name string")
    return rounded(classifiers.entries(scaled).join(names, "feature_ix").select("row_id", "name", "value"))


SELECT_SQL = f"""
WITH {VOCAB_SQL.replace("toks AS (", "toks AS MATERIALIZED (").replace("tf AS (", "tf AS MATERIALIZED (").replace("vocab AS (", "vocab AS MATERIALIZED (")},
{_tfidf_sql('l2').replace("feats AS (", "feats AS MATERIALIZED (")},
n AS (SELECT count(*) AS n FROM documents),
var AS MATERIALIZED (SELECT feature_ix, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2 AS variance FROM feats, n GROUP BY feature_ix),
sup AS MATERIALIZED (SELECT feature_ix, CAST(row_number() OVER (ORDER BY feature_ix) - 1 AS INTEGER) AS new_ix FROM var WHERE variance > 0.0001)
"""


def _tfidf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = text.Tfidf.fit(docs)
    return docs.count(), model.transform(docs).persist(), model


@query("select_variance", SELECT_SQL + "SELECT row_id, new_ix AS feature_ix, round(value, 6) AS value FROM feats JOIN sup USING (feature_ix)")
def select_variance(spark, sf_dir):
    n, feats, _ = _tfidf(spark, sf_dir)
    return rounded(selection.apply_support(feats, selection.variance_support(feats, n, 0.0001)))


@query(
    "select_support",
    SELECT_SQL + "SELECT v.feature_ix, new_ix IS NOT NULL AS kept FROM vocab v LEFT JOIN sup USING (feature_ix)",
)
def select_support(spark, sf_dir):
    n, feats, model = _tfidf(spark, sf_dir)
    return selection.support_mask(selection.variance_support(feats, n, 0.0001), model.width())


@query(
    "select_chain",
    SELECT_SQL
    + ", sup2 AS (SELECT s.feature_ix, CAST(row_number() OVER (ORDER BY feature_ix) - 1 AS INTEGER) AS ix FROM sup s JOIN var USING (feature_ix) "
    "WHERE variance > 0.001) SELECT row_id, ix AS feature_ix, round(value, 6) AS value FROM feats JOIN sup2 USING (feature_ix)",
)
def select_chain(spark, sf_dir):
    n, feats, _ = _tfidf(spark, sf_dir)
    once = selection.apply_support(feats, selection.variance_support(feats, n, 0.0001))
    return rounded(selection.apply_support(once, selection.variance_support(once, n, 0.001)))


@query("select_tree")
def select_tree(spark, sf_dir):
    train, rows = _split(spark, sf_dir)
    vectors = train.withColumn("features", array_to_vector("features"))
    model = selection.TreeSelector(seed=1).fit(vectors)
    chosen = model.transform(rows.withColumn("features", array_to_vector("features")))
    return chosen.select("row_id", vector_to_array("features").alias("features"))
