"""Row positions as identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldmeter.session import broadcast_if_small


def with_row_position(scan: DataFrame, name: str = "row_id") -> DataFrame:
    """Add the 0-based position of each row, in file name and file order.

    ``scan`` is a file scan.  Rows of one file block are numbered consecutively
    inside their task, so only the blocks' row counts have to be summed up;
    the rows themselves are neither sorted nor shuffled.
    """
    columns = scan.columns
    marked = scan.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    blocks = marked.groupBy("_file", "_start").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    in_order = W.partitionBy(F.lit(0)).orderBy("_file", "_start")
    offsets = blocks.select(
        "_file", "_start", (F.sum("_n").over(in_order) - F.col("_n") - F.col("_first")).alias("_shift")
    )
    placed = marked.join(broadcast_if_small(offsets), ["_file", "_start"])
    return placed.select((F.col("_mid") + F.col("_shift")).alias(name), *columns)
