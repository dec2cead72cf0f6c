"""Normalizers of dense ``features`` arrays, fitted on training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.operators.lookup import frequent_join
from foldmeter.operators.quantiles import exact_quantiles, sparse_quantiles
from foldmeter.session import cut_lineage


def normalize_rows(df: DataFrame, norm: str = "l2", column: str = "features") -> DataFrame:
    """Rows of length 1; a zero row stays zero."""
    zero = F.lit(0.0)
    if norm == "l1":
        length = F.aggregate(column, zero, lambda a, x: a + F.abs(x))
    elif norm == "l2":
        length = F.aggregate(column, zero, lambda a, x: a + x * x, F.sqrt)
    else:
        raise ValueError("norm must be l1 or l2")
    return (
        df.withColumn("_len", length)
        .withColumn(column, F.transform(column, lambda x: F.when(F.col("_len") == 0, x).otherwise(x / F.col("_len"))))
        .drop("_len")
    )


def _long(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.posexplode(column).alias("feature_ix", "value"))


def _or_one(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


@dataclass
class Scaler:
    """Per-feature ``low + (x - shift) * gain / range``; ``params`` has one row per feature."""

    params: DataFrame
    column: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        row = F.sort_array(F.collect_list(F.struct("feature_ix", "shift", "gain", "range", "low")))
        p = self.params.agg(row).scalar()
        scaled = F.zip_with(self.column, F.col("_p"), lambda x, s: s["low"] + (x - s["shift"]) * s["gain"] / s["range"])
        return df.withColumn("_p", p).withColumn(self.column, scaled).drop("_p")


def _scaler(stats: DataFrame, shift: Column, spread: Column, gain: float = 1.0, low: float = 0.0, column="features") -> Scaler:
    params = stats.select(
        "feature_ix", shift.alias("shift"), F.lit(gain).alias("gain"), _or_one(spread).alias("range"), F.lit(low).alias("low")
    )
    return Scaler(params.persist(), column)


def min_max(train: DataFrame, min_v: int = 0, max_v: int = 1, column: str = "features") -> Scaler:
    if min_v >= max_v:
        raise ValueError("min_v must be below max_v")
    stats = _long(train, column).groupBy("feature_ix").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return _scaler(stats, F.col("lo"), F.col("hi") - F.col("lo"), float(max_v - min_v), float(min_v), column)


def standard(train: DataFrame, centering: bool = True, column: str = "features") -> Scaler:
    stats = _long(train, column).groupBy("feature_ix").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return _scaler(stats, F.col("m") if centering else F.lit(0.0), F.col("sd"), column=column)


def robust(train: DataFrame, centering: bool = True, column: str = "features") -> Scaler:
    stats = exact_quantiles(_long(train, column), [0.25, 0.5, 0.75])
    q = [F.get("q", F.lit(i)) for i in range(3)]
    return _scaler(stats, q[1] if centering else F.lit(0.0), q[2] - q[0], column=column)


@dataclass
class SparseScaler:
    """The scalers for long sparse features: what is stored is scaled, what is not has one value per feature.

    ``params`` is (feature_ix, shift, gain, range, low, zero, n) for features with ``n`` stored entries; ``default`` is the scaled
    zero of all other features.  No zero is ever written out: statistics of stored entries are merged with the count of the others.
    """

    params: DataFrame
    default: float

    def transform(self, entries: DataFrame) -> DataFrame:
        """``entries`` (..., feature_ix, value) scaled, with ``zero``, the scaled zero of the entry's feature.  Hand in a table."""
        p = self.params.select("feature_ix", F.struct("shift", "gain", "range", "low", "zero").alias("_p"), "n")
        joined = frequent_join(entries, p, "feature_ix", "n", "left")
        scaled = F.col("_p.low") + (F.col("value") - F.col("_p.shift")) * F.col("_p.gain") / F.col("_p.range")
        zero = F.coalesce("_p.zero", F.lit(self.default))
        return joined.select(*entries.columns, F.coalesce(scaled, "value").alias("_v"), zero.alias("zero")).drop("value").withColumnRenamed("_v", "value")

    def dense(self, width: int, column: str = "features") -> Scaler:
        """The same scaler for dense arrays of ``width`` features."""
        every = self.params.sparkSession.range(width).select(F.col("id").cast("int").alias("feature_ix"))
        usual = {"shift": 0.0, "gain": 1.0, "range": 1.0, "low": self.default}
        filled = every.join(self.params.drop("zero", "n"), "feature_ix", "left").fillna(usual)
        return Scaler(filled.select("feature_ix", *usual).persist(), column)


def _stored(entries: DataFrame) -> DataFrame:
    return entries.select("feature_ix", "value").filter("value <> 0")


def _sparse_scaler(stats: DataFrame, shift: Column, spread: Column, gain: float = 1.0, low: float = 0.0) -> SparseScaler:
    params = stats.select(
        "feature_ix", shift.alias("shift"), F.lit(gain).alias("gain"), _or_one(spread).alias("range"), F.lit(low).alias("low"), "n"
    )
    zero = F.col("low") - F.col("shift") * F.col("gain") / F.col("range")
    return SparseScaler(cut_lineage(params.withColumn("zero", zero)), low)


def sparse_min_max(entries: DataFrame, n_rows: int, min_v: int = 0, max_v: int = 1) -> SparseScaler:
    """``entries`` is long, (row_id, feature_ix, value), of ``n_rows`` rows."""
    if min_v >= max_v:
        raise ValueError("min_v must be below max_v")
    stats = _stored(entries).groupBy("feature_ix").agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
    some_zero = F.col("n") < n_rows
    lo = F.when(some_zero, F.least("a", F.lit(0.0))).otherwise(F.col("a"))
    hi = F.when(some_zero, F.greatest("b", F.lit(0.0))).otherwise(F.col("b"))
    return _sparse_scaler(stats, lo, hi - lo, float(max_v - min_v), float(min_v))


def sparse_standard(entries: DataFrame, n_rows: int, centering: bool = True) -> SparseScaler:
    """Means and spreads of stored entries, merged with ``n_rows - n`` zeros."""
    stats = _stored(entries).groupBy("feature_ix").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    mean = F.col("n") * F.col("m") / n_rows
    square = F.col("n") * F.col("v") + F.col("n") * (F.lit(n_rows) - F.col("n")) / n_rows * F.col("m") * F.col("m")
    return _sparse_scaler(stats, mean if centering else F.lit(0.0), F.sqrt(square / n_rows))


def sparse_robust(entries: DataFrame, n_rows: int, centering: bool = True) -> SparseScaler:
    stats = sparse_quantiles(entries, n_rows, [0.25, 0.5, 0.75])
    q = [F.get("q", F.lit(i)) for i in range(3)]
    return _sparse_scaler(stats, q[1] if centering else F.lit(0.0), q[2] - q[0])


@dataclass
class RowNormalizer:
    """Stateless counterpart of ``Scaler``."""

    norm: str = "l2"
    column: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        return normalize_rows(df, self.norm, self.column)
