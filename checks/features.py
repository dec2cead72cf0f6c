"""Feature extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import documents, orders
from checks.registry import query, rounded, table
from foldmeter.functions.text import tokens as split_tokens
from foldmeter.operators import features, splits, text

SPLIT = r"list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+'), lambda t: t <> '')"
TERMS_SQL = f"""
toks AS (SELECT doc_id AS row_id, unnest({SPLIT}) AS term FROM documents),
tf AS (SELECT row_id, term, count(*) AS tf FROM toks GROUP BY ALL)
"""
VOCAB_SQL = (
    TERMS_SQL
    + """,
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term COLLATE "C") - 1 AS INTEGER) AS feature_ix, df, n,
            ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf
          FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY term))
"""
).replace(' COLLATE "C"', "")


def norm_sql(source: str, norm: str, keys: str = "row_id") -> str:
    over = f"OVER (PARTITION BY {keys})"
    length = f"sum(abs(value)) {over}" if norm == "l1" else f"sqrt(sum(value * value) {over})"
    return f"SELECT * EXCLUDE (value), value / {length} AS value FROM {source}"


@query(
    "pass_features",
    "SELECT o_orderkey AS row_id, CAST(j - 1 AS INTEGER) AS feature_ix, CASE j WHEN 1 THEN o_totalprice ELSE CAST(o_custkey AS DOUBLE) END "
    "AS value FROM orders, range(1, 3) t(j) WHERE CASE j WHEN 1 THEN o_totalprice ELSE o_custkey END <> 0",
)
def pass_features(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("price", F.col("price").cast("string"))
    return features.to_long(features.pass_attributes(df, ["price", "cust"]))


@query(
    "tokens",
    f"SELECT doc_id AS row_id, CAST(len({SPLIT}) AS INTEGER) AS n_tokens, md5(array_to_string({SPLIT}, ' ')) AS digest FROM documents",
)
def tokens(spark, sf_dir):
    words = split_tokens(F.col("text"))
    return documents(spark, sf_dir).select(
        "row_id", F.size(words).alias("n_tokens"), F.md5(F.concat_ws(" ", words)).alias("digest")
    )


@query("tfidf_vocab", f"WITH {VOCAB_SQL} SELECT term, feature_ix, df, n, round(idf, 6) AS idf FROM vocab")
def tfidf_vocab(spark, sf_dir):
    return rounded(text.Tfidf.fit(documents(spark, sf_dir)).vocab)


def _tfidf_sql(norm: str, vocab: str = "vocab") -> str:
    return f"w AS (SELECT row_id, feature_ix, tf * idf AS value FROM tf JOIN {vocab} USING (term)), feats AS ({norm_sql('w', norm)})"


@query(
    "tfidf_features",
    f"WITH {VOCAB_SQL}, {_tfidf_sql('l2')} SELECT row_id, feature_ix, round(value, 6) AS value FROM feats",
)
def tfidf_features(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return rounded(text.Tfidf.fit(docs).transform(docs))


@query(
    "tfidf_max_features",
    f"WITH {VOCAB_SQL}, top AS (SELECT term, idf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS feature_ix FROM "
    f"(SELECT * FROM vocab ORDER BY n DESC, term LIMIT 500)), {_tfidf_sql('l1', 'top')} "
    "SELECT row_id, feature_ix, round(value, 6) AS value FROM feats",
)
def tfidf_max_features(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return rounded(text.Tfidf.fit(docs, max_features=500, norm="l1").transform(docs))


FOLD_VOCAB_SQL = (
    "doc AS (SELECT doc_id AS row_id, CAST(ntile(5) OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM documents), "
    + TERMS_SQL
    + """,
steps AS (SELECT CAST(range AS INTEGER) AS step FROM range(5)),
ntrain AS (SELECT step, count(*) AS n FROM doc, steps WHERE fold <> step GROUP BY step),
vocab AS (
  SELECT step, term, df, CAST(row_number() OVER (PARTITION BY step ORDER BY term) - 1 AS INTEGER) AS feature_ix,
         ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT step, term, count(*) AS df FROM tf JOIN doc USING (row_id), steps WHERE fold <> step GROUP BY ALL) JOIN ntrain USING (step)),
w AS (SELECT v.step, row_id, feature_ix, tf * idf AS value FROM tf JOIN doc USING (row_id) JOIN vocab v ON v.step = doc.fold AND v.term = tf.term)
"""
)


@query(
    "tfidf_cv_no_leak",
    f"WITH {FOLD_VOCAB_SQL}, feats AS ({norm_sql('w', 'l2')}) SELECT step, row_id, feature_ix, round(value, 6) AS value FROM feats",
)
def tfidf_cv_no_leak(spark, sf_dir):
    folded = splits.stratified_k_fold(documents(spark, sf_dir), 5)
    return rounded(text.tfidf_by_fold(folded, 5)[1])


@query("tfidf_cv_vocab", f"WITH {FOLD_VOCAB_SQL} SELECT step, term, feature_ix, df, round(idf, 6) AS idf FROM vocab")
def tfidf_cv_vocab(spark, sf_dir):
    folded = splits.stratified_k_fold(documents(spark, sf_dir), 5)
    return rounded(text.tfidf_by_fold(folded, 5)[0])


def hash_sql(signed: bool, n: int = 100) -> str:
    sign = "CASE WHEN CAST('0x' || substr(md5(term), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END" if signed else "1"
    return (
        f"{TERMS_SQL}, w AS (SELECT row_id, CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {n} AS INTEGER) AS feature_ix, "
        f"CAST(sum(tf * {sign}) AS DOUBLE) AS value FROM tf GROUP BY 1, 2 HAVING sum(tf * {sign}) <> 0)"
    )


@query(
    "hashing_features",
    f"WITH {hash_sql(True)}, feats AS ({norm_sql('w', 'l2')}) SELECT row_id, feature_ix, round(value, 6) AS value FROM feats",
)
def hashing_features(spark, sf_dir):
    return rounded(text.hashed_features(documents(spark, sf_dir), method="md5"))


@query(
    "hashing_non_negative",
    f"WITH {hash_sql(False)}, feats AS ({norm_sql('w', 'l1')}) SELECT row_id, feature_ix, round(value, 6) AS value FROM feats",
)
def hashing_non_negative(spark, sf_dir):
    return rounded(text.hashed_features(documents(spark, sf_dir), non_negative=True, norm="l1", method="md5"))


@query("feature_names", f"WITH {VOCAB_SQL} SELECT feature_ix, 'text' AS attr, 'text : ' || term AS name FROM vocab")
def feature_names(spark, sf_dir):
    return text.feature_names(text.Tfidf.fit(documents(spark, sf_dir)).vocab, "text")


STACK_SQL = (
    hash_sql(True)
    + f", feats AS ({norm_sql('w', 'l2')})"
    + ", num AS (SELECT doc_id AS row_id, CAST(n_chars AS DOUBLE) AS value FROM documents)"
)


def _stack_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    numeric = features.to_long(features.pass_attributes(docs, ["n_chars"]))
    hashed = text.hashed_features(docs, method="md5")
    return docs, numeric, hashed


@query(
    "feature_stack",
    f"WITH {STACK_SQL} SELECT row_id, 0 AS feature_ix, value FROM num WHERE value <> 0 UNION ALL "
    "SELECT row_id, feature_ix + 1, round(value, 6) FROM feats",
)
def feature_stack(spark, sf_dir):
    _, numeric, hashed = _stack_parts(spark, sf_dir)
    return rounded(features.stack([(numeric, 1), (hashed, 100)]))


def sd_sql(source: str, name: str, width: str) -> str:
    return (
        f"SELECT '{name}' AS attribute, CAST({width} AS BIGINT) AS n_features, round(sum(sqrt(greatest(sq, 0))) / {width}, 6) AS mean_sd FROM ("
        f"SELECT sum(value * value) / (SELECT count(*) FROM documents) - (sum(value) / (SELECT count(*) FROM documents)) ** 2 AS sq "
        f"FROM {source} GROUP BY feature_ix)"
    )


ATTRIBUTES_SQL = (
    VOCAB_SQL
    + f", {_tfidf_sql('l2')}"
    + ", num AS (SELECT doc_id AS row_id, 0 AS feature_ix, CAST(n_chars AS DOUBLE) AS value FROM documents)"
)


@query(
    "attribute_stats",
    f"WITH {ATTRIBUTES_SQL} {sd_sql('num', 'n_chars', '1')} UNION ALL {sd_sql('feats', 'text', '(SELECT count(*) FROM vocab)')}",
)
def attribute_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    n = docs.count()
    numeric = features.to_long(features.pass_attributes(docs, ["n_chars"]))
    model = text.Tfidf.fit(docs)
    rows = features.attribute_row(numeric, "n_chars", n, 1)
    return rounded(rows.unionAll(features.attribute_row(model.transform(docs), "text", n, model.width())))
