"""Validation splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import orders
from checks.registry import query, table
from foldmeter.operators import splits


@query("split_kfold", "SELECT o_orderkey AS row_id, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def split_kfold(spark, sf_dir):
    return splits.k_fold(orders(spark, sf_dir).select("row_id"), 7)


@query(
    "split_kfold_shuffled",
    "SELECT o_orderkey AS row_id, CAST(ntile(5) OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
)
def split_kfold_shuffled(spark, sf_dir):
    return splits.k_fold(orders(spark, sf_dir).select("row_id"), 5, shuffle=True, random_seed=42)


@query(
    "split_stratified_shuffled",
    "SELECT o_orderkey AS row_id, o_orderpriority AS label, CAST(ntile(5) OVER (PARTITION BY o_orderpriority "
    "ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
)
def split_stratified_shuffled(spark, sf_dir):
    df = orders(spark, sf_dir).select("row_id", "label")
    return splits.stratified_k_fold(df, 5, shuffle=True, random_seed=42)


@query(
    "split_prepared_sets",
    "WITH m AS (SELECT o_orderkey AS row_id, CAST(o_custkey % 4 + 1 AS DOUBLE) AS id, o_orderkey % 3 = 0 AS test FROM orders) "
    "SELECT CAST(dense_rank() OVER (ORDER BY id) - 1 AS INTEGER) AS step, row_id, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM m",
)
def split_prepared_sets(spark, sf_dir):
    mark = F.concat(
        (F.col("cust").cast("bigint") % 4 + 1).cast("string"),
        F.when(F.col("row_id") % 2 == 0, ".0").otherwise(""),
        F.when(F.col("row_id") % 3 == 0, "t").otherwise(""),
    )
    marked = orders(spark, sf_dir).withColumn("set", mark)
    steps = splits.prepared_sets(marked, "set")
    splits.check_steps(steps)
    return steps


@query(
    "split_prepared_cv",
    "SELECT e.event_id AS row_id, CAST(dense_rank() OVER (ORDER BY CAST(round(value) AS INTEGER) % 6) - 1 AS INTEGER) AS fold FROM events e",
)
def split_prepared_cv(spark, sf_dir):
    part = (F.round("value").cast("int") % 6).cast("string")
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), part.alias("part"))
    return splits.prepared_folds(df, "part").select("row_id", "fold")


@query("split_loo", "SELECT c_custkey AS row_id, row_number() OVER (ORDER BY c_custkey) - 1 AS fold FROM customer")
def split_loo(spark, sf_dir):
    return splits.leave_one_out(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id")))


@query(
    "split_steps",
    "SELECT 'k_fold' AS scheme, CAST(7 AS BIGINT) AS n_steps UNION ALL SELECT 'prepared_cv', count(DISTINCT o_custkey % 9) FROM orders "
    "UNION ALL SELECT 'leave_one_out', count(*) FROM orders",
)
def split_steps(spark, sf_dir):
    df = orders(spark, sf_dir)
    counted = {
        "k_fold": splits.k_fold(df.select("row_id"), 7),
        "prepared_cv": splits.prepared_folds(df.select("row_id", (F.col("cust") % 9).alias("part")), "part"),
        "leave_one_out": splits.leave_one_out(df.select("row_id")),
    }
    out = None
    for scheme, frame in counted.items():
        row = splits.number_of_steps(frame).select(F.lit(scheme).alias("scheme"), "n_steps")
        out = row if out is None else out.unionAll(row)
    return out


@query(
    "split_holdout",
    "SELECT o_orderkey AS row_id, o_orderpriority AS label, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority "
    "ORDER BY md5('7000023:' || o_orderkey), o_orderkey) <= floor(0.25 * count(*) OVER (PARTITION BY o_orderpriority) + 0.5) "
    "THEN 'test' ELSE 'train' END AS role FROM orders",
)
def split_holdout(spark, sf_dir):
    return splits.stratified_holdout(orders(spark, sf_dir).select("row_id", "label"), 0.25, seed=7, draw=2)
