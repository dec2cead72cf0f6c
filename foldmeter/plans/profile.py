"""Profile of a data set: class, attribute and total statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.operators import class_stats
from foldmeter.operators.features import attribute_row
from foldmeter.operators.subset import first_per_class, without_classes
from foldmeter.plans.config import Experiment
from foldmeter.sources.checks import require_complete, require_rows


@dataclass
class Profile:
    class_stats: DataFrame
    attribute_stats: DataFrame
    totals: DataFrame


def working_set(df: DataFrame, config: Experiment) -> DataFrame:
    """(row_id, label, attributes...): the active classes' rows within their quotas."""
    columns = [F.col(config.row_id).alias("row_id"), F.col(config.label).cast("string").alias("label")]
    extra = getattr(config.validator, "attribute", None)
    names = dict.fromkeys([*config.attributes, *([extra] if extra else [])])
    rows = df.select(*columns, *[F.col(a) for a in names if a not in ("row_id", "label")])
    rows = without_classes(rows, config.inactive)
    return rows if config.quotas is None else first_per_class(rows, config.quotas)


def profile(df: DataFrame, config: Experiment) -> Profile:
    """One aggregation for the classes, one per attribute for its features.  A missing cell of an attribute is an error."""
    original = class_stats.class_counts(df, config.label).persist()
    rows = working_set(df, config).persist()
    require_rows(rows)
    require_complete(rows, [list(config.attributes), ["label"]])
    stats = class_stats.merge_counts(original, class_stats.class_counts(rows)).persist()
    n = rows.count()
    attributes = None
    for name, extractor in config.attributes.items():
        fitted = extractor.fit(rows, name)
        row = attribute_row(fitted.long(rows), name, n, fitted.width)
        attributes = row if attributes is None else attributes.unionAll(row)
    return Profile(class_stats.class_table(stats), attributes, class_stats.totals(stats, len(config.attributes)))
