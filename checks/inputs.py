"""Labelled inputs shared by the queries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import table
from foldmeter.operators.splits import stratified_k_fold


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (row_id, label, label_ix, features)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("string").alias("label"),
        F.col("label").alias("label_ix"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def dense_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_k_fold(dense(spark, sf_dir), 5)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), "text"
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").cast("double").alias("cust"),
    )


# (row_id, label, label_ix, fold, feature_ix, v): one row per embedding number.
DENSE_SQL = """
base AS (
  SELECT vec_id AS row_id, label AS label_ix,
         CAST(ntile(5) OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS fold,
         CAST(embedding AS DOUBLE[]) AS features
  FROM embeddings),
long AS (
  SELECT row_id, label_ix, fold, CAST(j - 1 AS INTEGER) AS feature_ix, features[j] AS v
  FROM base, range(1, 65) t(j))
"""

# Deterministic predictions of two imaginary classifiers on orders.
PREDICTIONS_SQL = """
classes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS ix
            FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)),
raw AS (
  SELECT CAST(o_orderkey % 5 AS INTEGER) AS step, c.classifier, o_orderkey AS row_id,
         o_orderpriority AS real,
         CAST('0x' || substr(md5(c.classifier || ':' || CAST(o_orderkey AS VARCHAR)), 1, 6) AS BIGINT) AS h
  FROM orders, (VALUES ('alpha'), ('beta')) c(classifier)),
predictions AS (
  SELECT step, classifier, row_id, real,
         CASE WHEN h % 10 < CASE classifier WHEN 'alpha' THEN 6 ELSE 3 END
              THEN real ELSE k.label END AS predicted
  FROM raw JOIN classes k ON k.ix = h % (SELECT count(*) FROM classes))
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predictions: mostly right for ``alpha``, mostly wrong for ``beta``."""
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("real")
    )
    names = base.agg(F.sort_array(F.collect_set("real"))).scalar()
    h = F.conv(
        F.substring(F.md5(F.concat_ws(":", "classifier", F.col("row_id").cast("string"))), 1, 6), 16, 10
    ).cast("bigint")
    kept = F.when(F.col("classifier") == "alpha", 6).otherwise(3)
    return (
        base.select("*", F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("classifier"))
        .select("*", h.alias("h"), names.alias("names"))
        .select(
            F.pmod("row_id", F.lit(5)).cast("int").alias("step"),
            "classifier",
            "row_id",
            "real",
            F.when(F.pmod("h", F.lit(10)) < kept, F.col("real"))
            .otherwise(F.get("names", F.pmod("h", F.size("names")).cast("int")))
            .alias("predicted"),
        )
    )
