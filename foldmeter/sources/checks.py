"""Checks that run as one aggregate before a job starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_samples(df: DataFrame) -> int:
    return df.count()


def missing_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with the number of missing cells per column."""
    columns = list(columns or df.columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def require_complete(df: DataFrame, column_lists: Sequence[Sequence[str]], row_id: str = "row_id") -> list[DataFrame]:
    """Project the column lists; stop at the first missing cell, naming row and column."""
    columns = [c for cols in column_lists for c in cols]
    firsts = df.agg(*[F.min(F.when(F.col(c).isNull(), F.col(row_id))).alias(c) for c in columns]).first()
    bad = [(firsts[c], c) for c in columns if firsts[c] is not None]
    if bad:
        row, column = min(bad)
        raise ValueError(f"missing value in row {row}, column {column}")
    return [df.select(row_id, *cols) for cols in column_lists]


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("the data set has no rows")
