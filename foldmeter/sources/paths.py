"""Attributes whose cells are paths: the file's text or image replaces the cell."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.image import ImageSchema
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(path: Column, base: str) -> Column:
    """Absolute paths stay; relative ones start at the data set's folder."""
    full = F.when(path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), path).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, r"^\./", ""))
    )
    return _plain(full)


def _plain(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^file:(//)?", "")


def _referenced(df: DataFrame, attribute: str, base: str, folders: Sequence[str] | None) -> list[str]:
    """The files of the folders that some row names: names are listed without reading any content.

    Spark's own listing of the folders is on the driver already, and this is a part of it.
    """
    lister = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = lister.load(list(folders or [base])).select("path", _plain(F.col("path")).alias("_path"))
    named = df.select(resolve(F.col(attribute), base).alias("_path")).distinct()
    return [r["path"] for r in listed.join(named, "_path", "left_semi").select("path").collect()]


def _attach(df: DataFrame, attribute: str, base: str, files: DataFrame | None, what: str, kind: str) -> DataFrame:
    """Left join on the resolved path: one read of a file, however many rows share it."""
    wanted = df.withColumn("_path", resolve(F.col(attribute), base))
    missing = F.raise_error(F.concat(F.lit(f"attribute {attribute}: no readable {what} "), F.col("_path"))).cast(kind)
    if files is None:
        return wanted.select(*[missing.alias(c) if c == attribute else df[c] for c in df.columns])
    joined = wanted.join(files, F.col("_path") == F.col("_found"), "left")
    content = F.when(F.col("_found").isNotNull(), F.col("_content")).otherwise(missing)
    return joined.select(*[content.alias(c) if c == attribute else df[c] for c in df.columns])


def _files(df: DataFrame, kind: str, paths: list[str]) -> DataFrame | None:
    """Exactly these files; their names are no patterns."""
    reader = df.sparkSession.read.format(kind).option("dropInvalid", True).option("__globPaths__", "false")
    return reader.load(paths) if paths else None


def text_attribute(df: DataFrame, attribute: str, base: str, folders: Sequence[str] | None = None) -> DataFrame:
    """Replace paths by the files' UTF-8 text; files that no row names are not read."""
    files = _files(df, "binaryFile", _referenced(df, attribute, base, folders))
    if files is not None:
        files = files.select(_plain(F.col("path")).alias("_found"), F.decode("content", "UTF-8").alias("_content"))
    return _attach(df, attribute, base, files, "text file", "string")


def image_attribute(df: DataFrame, attribute: str, base: str, folders: Sequence[str] | None = None) -> DataFrame:
    """Replace paths by image structs (height, width, nChannels, data); files that no row names are not read."""
    files = _files(df, "image", _referenced(df, attribute, base, folders))
    if files is not None:
        files = files.select(_plain(F.col("image.origin")).alias("_found"), F.col("image").alias("_content"))
    return _attach(df, attribute, base, files, "image", ImageSchema.columnSchema.simpleString())


def _unpack(data: pd.Series) -> pd.Series:
    return data.map(lambda b: np.frombuffer(b, dtype="uint8").astype("float64"))


def image_pixels(data: Column) -> Column:
    """Unpack an image's bytes to numbers, row by row and channel by channel."""
    return F.pandas_udf(_unpack, "array<double>")(data)
