"""Plain attributes, stacking and statistics of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foldmeter.functions.numbers import strict_double
from foldmeter.session import scratch_dir


def pass_attributes(df: DataFrame, attributes: Sequence[str], out: str = "features") -> DataFrame:
    """Cast attributes to numbers, side by side in one array; text that is no number stops the job."""
    types = dict(df.dtypes)
    numbers = [
        strict_double(F.col(a), a) if types[a] == "string" else F.col(a).cast("double") for a in attributes
    ]
    return df.withColumn(out, F.array(*numbers))


def to_long(df: DataFrame, features: str = "features", keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, keep..., feature_ix, value) of a dense array, zeros left out."""
    long = df.select("row_id", *keep, F.posexplode(features).alias("feature_ix", "value"))
    return long.filter("value <> 0")


def sparse_vectors(df: DataFrame, out: str, width: int) -> DataFrame:
    """``df`` with array columns ``_ix`` and ``_v`` replaced by a sparse vector ``out``.

    A vector is stored as a struct, so the struct is written and read back under the vector's type: no row passes Python.
    """
    none_ix, none_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    body = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(width).cast("int").alias("size"),
        F.coalesce("_ix", none_ix).alias("indices"),
        F.coalesce("_v", none_v).alias("values"),
    )
    plain = df.withColumn(out, body).drop("_ix", "_v")
    path = scratch_dir(df.sparkSession)
    plain.write.parquet(path)
    schema = StructType([StructField(out, VectorUDT()) if f.name == out else f for f in plain.schema.fields])
    return df.sparkSession.read.schema(schema).parquet(path)


def stack(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Put several attributes' long features side by side; each part is (features, width)."""
    out, offset = None, 0
    for features, width in parts:
        shifted = features.withColumn("feature_ix", (F.col("feature_ix") + F.lit(offset)).cast("int"))
        out = shifted if out is None else out.unionByName(shifted)
        offset += width
    return out


def stack_names(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """The same for (feature_ix, attr, name) tables."""
    return stack(parts)


def plain_names(spark, attribute: str, width: int = 1) -> DataFrame:
    """Names of an extractor that has none per feature: the attribute, or ``attribute : UNK`` when wide."""
    rows = spark.range(width).select(F.col("id").cast("int").alias("feature_ix"), F.lit(attribute).alias("attr"))
    return rows.withColumn("name", F.lit(attribute if width == 1 else f"{attribute} : UNK"))


def mean_feature_sd(features: DataFrame, n_rows: int, width: int) -> DataFrame:
    """One row ``mean_sd``: the mean over features of their population SD, absent entries being 0."""
    v = F.col("value")
    per_feature = features.groupBy("feature_ix").agg(F.sum(v * v).alias("sq"), F.sum(v).alias("s"))
    var = F.col("sq") / n_rows - (F.col("s") / n_rows) ** 2
    return per_feature.agg(
        (F.coalesce(F.sum(F.sqrt(F.greatest(var, F.lit(0.0)))), F.lit(0.0)) / max(width, 1)).alias("mean_sd")
    )


def attribute_row(features: DataFrame, attribute: str, n_rows: int, width: int) -> DataFrame:
    """(attribute, n_features, mean_sd)."""
    return mean_feature_sd(features, n_rows, width).select(
        F.lit(attribute).alias("attribute"), F.lit(width).cast("bigint").alias("n_features"), "mean_sd"
    )
