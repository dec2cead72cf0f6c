"""Column choice, row subsets, class filters and class quotas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.operators.order import cut_by_rank
from foldmeter.session import broadcast_if_small


def used_columns(columns: Iterable[str], use: Mapping[str, bool], label: str | None = None) -> list[str]:
    """Columns with ``use`` on, in table order; the label too when it is named."""
    return [c for c in columns if use.get(c, True) or c == label]


def project(df: DataFrame, use: Mapping[str, bool], label: str | None = None, keep: Iterable[str] = ()) -> DataFrame:
    keep = set(keep)
    chosen = set(used_columns(df.columns, use, label)) | keep
    return df.select([c for c in df.columns if c in chosen])


def rows_at(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the rows whose ``row_id`` is in ``ids``."""
    return df.join(ids.select("row_id"), "row_id", "left_semi")


def without_classes(df: DataFrame, inactive: Iterable[str], label: str = "label") -> DataFrame:
    """Rows of the active classes."""
    inactive = list(inactive)
    return df.filter(~F.col(label).isin(inactive)) if inactive else df


def quota_table(df: DataFrame, quotas: Mapping[str, int]) -> DataFrame:
    rows = [(str(c), int(n)) for c, n in quotas.items()]
    return df.sparkSession.createDataFrame(rows, "_class string, _quota bigint")


def first_per_class(df: DataFrame, quotas: Mapping[str, int] | DataFrame, label: str = "label") -> DataFrame:
    """The first ``quota`` rows of each class in ``row_id`` order; unlisted classes are dropped.

    A class is cut at the id of its quota-th row, so a quota may be as large as its class and only ids are put in order.
    """
    if not isinstance(quotas, DataFrame):
        quotas = quota_table(df, quotas)
    listed = df.join(broadcast_if_small(quotas), df[label].cast("string") == F.col("_class"))
    cut = cut_by_rank(listed, [label, "_quota"], F.col("row_id"), lambda rank, _: (rank >= F.col("_quota")).cast("int"), "_beyond")
    return cut.filter("_beyond = 0").select(df.columns)


def clamp_quota(requested: Column, original: Column, active: Column) -> Column:
    """A requested class size is held in 1..original; an inactive class has 0."""
    return F.when(active, F.greatest(F.lit(1).cast("bigint"), F.least(requested, original))).otherwise(
        F.lit(0).cast("bigint")
    )
