"""Positions, ranks and borders; plans that move keys alone."""

import re

import pytest
from pyspark.sql import functions as F

from foldmeter.operators import splits, subset, text
from foldmeter.operators.order import cut_by_rank, first_rows, with_positions, with_ranks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_positions(spark, ranges):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("position__range"))
    got = with_positions(df, F.col("v").desc(), name="at", ranges=ranges).collect()
    assert sorted(r["at"] for r in got) == list(range(1000)) and all(r["at"] == 999 - r.v for r in got)
    assert with_positions(df.limit(0), "v").count() == 0


def test_common_prefix_spreads(spark):
    """A million terms that share their first ten bytes: no range is much larger than the others."""
    terms = spark.range(1_000_000).select(F.format_string("prefix1234%d", F.col("id") * 7919 % 1_000_000).alias("term"))
    placed = with_positions(terms, "term", ranges=16)
    sizes = sorted(r["n"] for r in placed.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
    assert sum(sizes) == 1_000_000 and sizes[-1] < 1.5 * sizes[len(sizes) // 2]
    sample = placed.filter("position % 99991 = 0").orderBy("position").collect()
    ordered = sorted(f"prefix1234{i}" for i in range(1_000_000))
    assert [r.term for r in sample] == ordered[::99991]


def test_ranks_in_groups_with_null(spark):
    rows = [(i, [None, "a", "b"][i % 3] if i < 90 else "a") for i in range(400)]
    got = with_ranks(spark.createDataFrame(rows, "row_id long, g string"), ["g"], F.col("row_id").desc()).collect()
    for g in (None, "a", "b"):
        ids = sorted((i for i, x in rows if x == g), reverse=True)
        assert [(r.row_id, r["rank"], r.group_n) for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == [
            (i, k, len(ids)) for k, i in enumerate(ids)
        ]


def test_cut_by_rank(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.lit("wide").alias("payload"), (F.col("id") % 2).alias("g"))
    got = cut_by_rank(df, ["g"], F.col("row_id"), lambda rank, n: F.floor(rank * 4 / n).cast("int"), "part").collect()
    assert all(r.part == (r.row_id // 2) * 4 // 25 for r in got) and len(got) == 50


def test_first_rows(spark):
    df = spark.range(1000).select((F.col("id") * 31 % 1000).alias("v"))
    assert sorted(r.v for r in first_rows(df, 300, "v").collect()) == list(range(300))


def test_folds_leave_wide_rows_where_they_are(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("label"), F.lit("w" * 50).alias("text")).write.parquet(
        str(tmp_path / "t")
    )
    df = spark.read.parquet(str(tmp_path / "t"))
    for folded in (
        splits.k_fold(df, 4, shuffle=True, random_seed=3),
        splits.stratified_k_fold(df, 4),
        splits.stratified_holdout(df, 0.3),
        subset.first_per_class(df, {"0": 10, "1": 600}),
    ):
        p = plan(folded)
        assert "hashpartitioning" not in p and "rangepartitioning" not in p and "Window" not in p, p


def test_text_counts_need_no_exchange(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("row_id"), F.lit("a b a c " * 20).alias("text")).repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # a table of more than one split per core
        assert not re.search("Exchange|Window", plan(text.hashed_features(df, n_features=16)))
        assert not re.search("Exchange|Window", plan(text.term_rows(df)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r.term, r.tf) for r in text.term_rows(df).collect()}
    assert got == {("a", 40), ("b", 20), ("c", 20)}
