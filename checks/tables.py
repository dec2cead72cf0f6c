"""Sources, sinks, subsets and class statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import orders
from checks.registry import query, rounded, table
from foldmeter.operators import class_stats, subset
from foldmeter.session import scratch_dir
from foldmeter.sources import checks, csv, identity

QUOTAS = {"1-URGENT": 100, "2-HIGH": 1_000_000, "5-LOW": 777}
QUOTA_SQL = "(VALUES ('1-URGENT', 100), ('2-HIGH', 1000000), ('5-LOW', 777)) q(label, quota)"
INACTIVE = ["2-HIGH", "4-NOT SPECIFIED"]
INACTIVE_SQL = "('2-HIGH', '4-NOT SPECIFIED')"


@query("sample_count", "SELECT count(*) AS n FROM lineitem")
def sample_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query(
    "csv_round_trip",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
    "CASE WHEN c_nationkey % 3 = 0 THEN '' WHEN c_nationkey % 3 = 1 THEN c_name || ' \"x\", ' || c_mktsegment ELSE '  ' || c_mktsegment || ' ' END "
    "AS remark FROM customer",
)
def csv_round_trip(spark, sf_dir):
    third = F.col("c_nationkey") % 3
    odd = (
        F.when(third == 0, "")
        .when(third == 1, F.concat("c_name", F.lit(' "x", '), "c_mktsegment"))
        .otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    )
    path = scratch_dir(spark)
    csv.write_csv(table(spark, sf_dir, "customer").withColumn("remark", odd), path, ["c_custkey", "c_nationkey", "remark"])
    return csv.read_csv(spark, path)


@query("row_position", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey, c_mktsegment FROM customer")
def row_position(spark, sf_dir):
    scan = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return identity.with_row_position(scan)


@query(
    "missing_cells",
    "SELECT count(*) FILTER (q IS NULL) AS quality, count(*) FILTER (t IS NULL) AS toxic, count(*) FILTER (x IS NULL) AS text FROM "
    "(SELECT l.quality AS q, l.toxic AS t, d.text AS x FROM documents d LEFT JOIN labels l USING (doc_id))",
)
def missing_cells(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return checks.missing_cells(joined.select("quality", "toxic", "text"))


@query(
    "project_lists",
    "SELECT o_orderkey AS row_id, o_totalprice, o_orderstatus FROM orders",
)
def project_lists(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "row_id")
    attributes, labels_ = checks.require_complete(df, [["o_totalprice"], ["o_orderstatus"]])
    return attributes.join(labels_, "row_id")


@query("project_attributes", "SELECT p_partkey, p_brand, p_size, p_type FROM part")
def project_attributes(spark, sf_dir):
    use = {"p_name": False, "p_retailprice": False, "p_type": False}
    return subset.project(table(spark, sf_dir, "part"), use, label="p_type")


@query(
    "subset_semi",
    "SELECT o_orderkey AS row_id, o_orderpriority AS label, o_totalprice AS price FROM orders "
    "WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)",
)
def subset_semi(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("row_id"))
    return subset.rows_at(orders(spark, sf_dir).select("row_id", "label", "price"), ids)


@query(
    "class_filter",
    f"SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders WHERE o_orderpriority NOT IN {INACTIVE_SQL}",
)
def class_filter(spark, sf_dir):
    return subset.without_classes(orders(spark, sf_dir).select("row_id", "label"), INACTIVE)


@query(
    "class_quota_subset",
    "SELECT row_id, label FROM (SELECT o_orderkey AS row_id, o_orderpriority AS label, "
    "row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) r "
    f"JOIN {QUOTA_SQL} USING (label) WHERE rn <= quota",
)
def class_quota_subset(spark, sf_dir):
    return subset.first_per_class(orders(spark, sf_dir).select("row_id", "label"), QUOTAS)


@query(
    "subset_export",
    "SELECT label, count(*) AS n, min(row_id) AS lo, max(row_id) AS hi, round(avg(price), 6) AS price FROM (SELECT o_orderkey AS row_id, "
    "o_orderpriority AS label, o_totalprice AS price, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn "
    f"FROM orders) r JOIN {QUOTA_SQL} USING (label) WHERE rn <= quota GROUP BY label",
)
def subset_export(spark, sf_dir):
    from foldmeter.plans.export import export_subset

    path = scratch_dir(spark)
    export_subset(orders(spark, sf_dir), path, use={"cust": False}, quotas=QUOTAS, label="label", keep=["row_id"])
    back = csv.read_csv(spark, path)
    return rounded(
        back.groupBy("label").agg(
            F.count("*").alias("n"),
            F.min(F.col("row_id").cast("bigint")).alias("lo"),
            F.max(F.col("row_id").cast("bigint")).alias("hi"),
            F.avg(F.col("price").cast("double")).alias("price"),
        )
    )


STATS_SQL = f"""
orig AS (SELECT o_orderpriority AS label, count(*) AS samples FROM orders GROUP BY 1),
fresh AS (SELECT o_orderpriority AS label, count(*) AS samples FROM orders
          WHERE o_orderpriority NOT IN {INACTIVE_SQL} AND o_totalprice > 100000 GROUP BY 1),
merged AS (SELECT o.label, coalesce(f.samples, o.samples) AS samples, o.samples AS samples_orig, f.samples IS NOT NULL AS active
           FROM orig o LEFT JOIN fresh f USING (label))
"""


def _merged(spark, sf_dir):
    df = orders(spark, sf_dir)
    fresh = subset.without_classes(df, INACTIVE).filter("price > 100000")
    return class_stats.merge_counts(class_stats.class_counts(df), class_stats.class_counts(fresh))


@query("class_counts", "SELECT l_returnflag AS label, count(*) AS samples FROM lineitem GROUP BY 1")
def class_counts(spark, sf_dir):
    return class_stats.class_counts(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("stats_merge", f"WITH {STATS_SQL} SELECT * FROM merged")
def stats_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


TOTALS_SQL = """
SELECT coalesce(CAST(sum(samples) AS BIGINT), 0) AS n_samples, count(*) AS n_classes, CAST(2 AS BIGINT) AS n_attributes,
  (SELECT samples FROM {t} ORDER BY samples DESC, label LIMIT 1) AS max_samples,
  (SELECT label FROM {t} ORDER BY samples DESC, label LIMIT 1) AS max_class,
  (SELECT samples FROM {t} ORDER BY samples, label LIMIT 1) AS min_samples,
  (SELECT label FROM {t} ORDER BY samples, label LIMIT 1) AS min_class,
  round(avg(samples), 6) AS mean_samples, round(coalesce(stddev_samp(samples), 0), 6) AS sd_samples FROM {t}
"""


@query(
    "class_stats_totals",
    f"WITH {STATS_SQL}, act AS (SELECT * FROM merged WHERE active) " + TOTALS_SQL.format(t="act"),
)
def class_stats_totals(spark, sf_dir):
    return rounded(class_stats.totals(_merged(spark, sf_dir), 2))


@query(
    "class_stats_totals_lineitem",
    "WITH t AS (SELECT l_returnflag AS label, count(*) AS samples FROM lineitem GROUP BY 1) " + TOTALS_SQL.format(t="t"),
)
def class_stats_totals_lineitem(spark, sf_dir):
    counts = class_stats.class_counts(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return rounded(class_stats.totals(counts, 2))


REQUEST_SQL = "(VALUES ('1-URGENT', 5), ('3-MEDIUM', 0), ('5-LOW', 999999999), ('2-HIGH', 5)) r(label, requested)"


@query(
    "class_stats_table",
    f"WITH {STATS_SQL} SELECT label AS class, CASE WHEN active THEN greatest(1, least(coalesce(requested, samples), samples_orig)) "
    f"ELSE 0 END AS samples, samples_orig AS original_samples, active AS use FROM merged LEFT JOIN {REQUEST_SQL} USING (label)",
)
def class_stats_table(spark, sf_dir):
    rows = [("1-URGENT", 5), ("3-MEDIUM", 0), ("5-LOW", 999999999), ("2-HIGH", 5)]
    requested = spark.createDataFrame(rows, "label string, requested bigint")
    return class_stats.class_table(_merged(spark, sf_dir), requested)


@query(
    "quota_clamp",
    "SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus <> 'F' THEN greatest(1, least(o_custkey - 20, o_orderkey)) ELSE 0 END AS n FROM orders",
)
def quota_clamp(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    n = subset.clamp_quota(F.col("o_custkey") - 20, F.col("o_orderkey"), F.col("o_orderstatus") != "F")
    return df.select(F.col("o_orderkey").alias("row_id"), n.alias("n"))
