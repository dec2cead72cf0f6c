"""Label encoding: class names to codes 0..C-1 in sorted order, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldmeter.session import broadcast_if_small


def label_map(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_ix); the distinct classes are the only rows that get ordered."""
    classes = df.select(F.col(label).cast("string").alias("label")).distinct()
    return classes.withColumn(
        "label_ix", (F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("label")) - 1).cast("int")
    ).select("label", "label_ix")


def encode(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_ix``."""
    side = mapping.select(F.col("label").alias("_name"), "label_ix")
    return df.join(broadcast_if_small(side), df[label].cast("string") == F.col("_name")).drop("_name")


def decode(df: DataFrame, mapping: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add class names for code columns: ``{code column: new name column}``."""
    for code, name in columns.items():
        side = mapping.select(F.col("label_ix").alias(code), F.col("label").alias(name))
        df = df.join(broadcast_if_small(side), code, "left")
    return df


def class_names(mapping: DataFrame) -> list[str]:
    """Class names in code order, on the driver (one entry per class)."""
    return [r["label"] for r in mapping.orderBy("label_ix").collect()]
