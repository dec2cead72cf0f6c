"""Validation splits.

Schemes that partition the rows give a ``fold`` column.  Schemes where a row may
be idle or used several times give ``(step, row_id, role)`` with role ``train``
or ``test``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldmeter.functions.hashing import seeded_digest
from foldmeter.operators.order import cut_by_rank
from foldmeter.operators.ranks import rank_by_key
from foldmeter.session import broadcast_if_small
from foldmeter.sources.checks import require_complete


def _block(rank: Column, n: Column, k: int) -> Column:
    """Number of the contiguous block of ``rank``; the first ``n mod k`` blocks are one longer."""
    q, m = F.floor(n / F.lit(k)), F.pmod(n, F.lit(k))
    head = m * (q + 1)
    in_head = F.floor(rank / (q + 1))
    in_tail = m + F.floor((rank - head) / F.greatest(q, F.lit(1)))
    return F.when(rank < head, in_head).otherwise(in_tail).cast("int")


def _check_folds(k: int) -> None:
    if k < 2:
        raise ValueError("folds must be at least 2")


def _key(shuffle: bool, seed: int | None) -> Column:
    """What rows are ordered by: their id, or a seeded digest of it."""
    return F.struct(seeded_digest(0 if seed is None else seed, F.col("row_id")).alias("digest"), "row_id") if shuffle else F.col("row_id")


def k_fold(df: DataFrame, folds: int = 5, shuffle: bool = False, random_seed: int | None = None) -> DataFrame:
    """Contiguous blocks over all rows in ``row_id`` order (or seeded random order)."""
    _check_folds(folds)
    return cut_by_rank(df, [], _key(shuffle, random_seed), lambda rank, n: _block(rank, n, folds), "fold")


def stratified_k_fold(
    df: DataFrame, folds: int = 5, label: str = "label", shuffle: bool = False, random_seed: int | None = None
) -> DataFrame:
    """Contiguous blocks per class."""
    _check_folds(folds)
    return cut_by_rank(df, [label], _key(shuffle, random_seed), lambda rank, n: _block(rank, n, folds), "fold")


def leave_one_out(df: DataFrame) -> DataFrame:
    """Every row is its own fold.  Used by the closed-form leave-one-out models."""
    ranked = rank_by_key(df)
    return ranked.withColumn("fold", F.col("rank")).drop("rank", "group_n")


def _step_numbers(ids: DataFrame) -> DataFrame:
    """Distinct numeric step ids in ascending order get steps 0, 1, ..."""
    return ids.distinct().withColumn(
        "step", (F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("_id")) - 1).cast("int")
    )


def prepared_sets(df: DataFrame, attribute: str) -> DataFrame:
    """``7`` marks a train row and ``7t`` a test row of the step with number 7.  A row without a mark is an error."""
    if attribute not in df.columns:
        raise ValueError(f"no attribute {attribute}")
    require_complete(df, [[attribute]])
    mark = F.trim(F.col(attribute).cast("string"))
    is_test = mark.endswith("t")
    marked = df.select(
        "row_id",
        F.regexp_replace(mark, "t$", "").cast("double").alias("_id"),
        F.when(is_test, "test").otherwise("train").alias("role"),
    )
    steps = _step_numbers(marked.select("_id"))
    return marked.join(broadcast_if_small(steps), "_id").select("step", "row_id", "role")


def check_steps(splits: DataFrame) -> None:
    """Stop when a step has no train or no test rows."""
    bad = (
        splits.groupBy("step")
        .agg(F.count_if(F.col("role") == "train").alias("tr"), F.count_if(F.col("role") == "test").alias("te"))
        .filter("tr = 0 or te = 0")
        .orderBy("step")
        .first()
    )
    if bad is not None:
        raise ValueError(f"step {bad['step']}: {bad['tr']} train rows, {bad['te']} test rows")


def prepared_folds(df: DataFrame, attribute: str) -> DataFrame:
    """The attribute's distinct numbers are the folds, ascending.  A row without a number is an error."""
    if attribute not in df.columns:
        raise ValueError(f"no attribute {attribute}")
    require_complete(df, [[attribute]])
    keyed = df.withColumn("_id", F.col(attribute).cast("double"))
    steps = _step_numbers(keyed.select("_id")).withColumnRenamed("step", "fold")
    return keyed.join(broadcast_if_small(steps), "_id").drop("_id")


def stratified_holdout(df: DataFrame, size: float, seed: int = 0, draw: int = 0, label: str = "label") -> DataFrame:
    """Mark ``round(size * class rows)`` random rows of each class as ``test``."""
    if not 0.0 <= size <= 1.0:
        raise ValueError("size must be in 0..1")

    def is_train(rank: Column, n: Column) -> Column:
        return (rank >= F.floor(F.lit(float(size)) * n + F.lit(0.5))).cast("int")

    cut = cut_by_rank(df, [label], _key(True, seed * 1_000_003 + draw), is_train, "_train")
    return cut.withColumn("role", F.when(F.col("_train") == 0, "test").otherwise("train")).drop("_train")


def fold_roles(df: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one step of a fold column."""
    return df.filter(F.col("fold") != step), df.filter(F.col("fold") == step)


def number_of_steps(df: DataFrame, column: str = "fold") -> DataFrame:
    """One row ``n_steps``."""
    return df.agg(F.countDistinct(column).alias("n_steps"))
