"""A new data set from chosen columns and class quotas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from foldmeter.operators.subset import first_per_class, project
from foldmeter.sources.csv import write_csv


def export_subset(
    df: DataFrame,
    path: str,
    use: Mapping[str, bool],
    label: str,
    quotas: Mapping[str, int] | None = None,
    keep: Iterable[str] = (),
) -> None:
    """Scan, keep the first rows of each class, project, write CSV.

    The label stays in the new data set even where its use is off.
    """
    rows = df if quotas is None else first_per_class(df, quotas, label)
    write_csv(project(rows, use, label, keep), path)
