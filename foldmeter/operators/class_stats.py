"""Statistics of the classes of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.operators.subset import clamp_quota


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, samples)."""
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("samples"))


def merge_counts(original: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh counts against original ones: (label, samples, samples_orig, active).

    A class without fresh rows comes back with its original count, inactive.
    """
    new = fresh.select("label", F.col("samples").alias("_new"))
    return original.join(new, "label", "left").select(
        "label",
        F.coalesce("_new", "samples").alias("samples"),
        F.col("samples").alias("samples_orig"),
        F.col("_new").isNotNull().alias("active"),
    )


def class_table(stats: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """The class statistics report: class, samples, original samples, use.

    ``requested`` (label, requested) applies edited class sizes.
    """
    wanted = F.col("samples")
    if requested is not None:
        stats = stats.join(requested, "label", "left")
        wanted = F.coalesce("requested", "samples")
    return stats.select(
        F.col("label").alias("class"),
        clamp_quota(wanted, F.col("samples_orig"), F.col("active")).alias("samples"),
        F.col("samples_orig").alias("original_samples"),
        F.col("active").alias("use"),
    )


def totals(stats: DataFrame, n_attributes: int) -> DataFrame:
    """One row over the active classes; ties go to the first class in sorted order."""
    active = stats.filter("active") if "active" in stats.columns else stats
    size = F.col("samples")
    largest = F.min_by(F.struct("samples", "label"), F.struct((-size).alias("n"), F.col("label")))
    smallest = F.min_by(F.struct("samples", "label"), F.struct(size.alias("n"), F.col("label")))
    zero = F.lit(0).cast("bigint")
    return active.agg(
        F.coalesce(F.sum("samples"), zero).alias("n_samples"),
        F.count("*").alias("n_classes"),
        largest.alias("_max"),
        smallest.alias("_min"),
        F.coalesce(F.avg("samples"), F.lit(0.0)).alias("mean_samples"),
        F.coalesce(F.stddev_samp("samples"), F.lit(0.0)).alias("sd_samples"),
    ).select(
        "n_samples",
        "n_classes",
        F.lit(n_attributes).cast("bigint").alias("n_attributes"),
        F.coalesce("_max.samples", zero).alias("max_samples"),
        F.coalesce("_max.label", F.lit("")).alias("max_class"),
        F.coalesce("_min.samples", zero).alias("min_samples"),
        F.coalesce("_min.label", F.lit("")).alias("min_class"),
        "mean_samples",
        "sd_samples",
    )
