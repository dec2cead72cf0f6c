"""CSV data sets: every cell is text, an empty cell is not a missing one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RAW = "_raw_row"
_QUOTED = r'"(?:[^"]|"")*"'


def has_multi_line_cells(spark: SparkSession, path: str) -> bool:
    """True when a line leaves a quote open, so that lines cannot be parsed on their own."""
    quotes = F.length("value") - F.length(F.regexp_replace("value", '"', ""))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Read a headed UTF-8 CSV.

    Blank lines are skipped and cells beyond the header are ignored.  A cell
    that a short row lacks is null; an empty cell is ``''``.  Files are split
    among tasks unless some cell holds a line break (found by one scan when
    ``multi_line`` is None).
    """
    if multi_line is None:
        multi_line = has_multi_line_cells(spark, path)
    options = dict(header=True, multiLine=multi_line, quote='"', escape='"', encoding="UTF-8")
    columns = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _RAW]])
    rows = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW).schema(schema).csv(path)
    separators = F.regexp_replace(F.regexp_replace(_RAW, _QUOTED, ""), "[^,]", "")
    present = F.when(F.col(_RAW).isNull(), F.lit(len(columns))).otherwise(F.length(separators) + 1)
    return rows.select(
        *[F.when(present > i, F.coalesce(F.col(c), F.lit(""))).alias(c) for i, c in enumerate(columns)]
    )


def write_csv(df: DataFrame, path: str, columns: Iterable[str] | None = None) -> None:
    """Write the chosen columns with a header, as a folder of part files.

    White space stays as it is.  Empty and missing text is written as ``""``, so that no row becomes a blank line.
    """
    out = df.select(*columns) if columns is not None else df
    if len(out.columns) == 1:
        out = out.select(F.col(out.columns[0]).cast("string"))
    text = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in text}) if text else out
    options = dict(header=True, quote='"', escape='"', emptyValue='""')
    out.write.options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
