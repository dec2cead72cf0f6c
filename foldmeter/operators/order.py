"""Exact order statistics of any size: positions, ranks in groups, and borders that replace ranks.

Spark samples range borders over the whole sort key, every range is sorted by itself, and a row's position is its place
in its range plus the rows of the earlier ranges.  The sorted ranges are written before they are counted, so counting
and numbering see the same ranges even after an executor is lost.  No window runs over a table or a group, so a hot
class or a common prefix of all keys spreads like any other key.

Where only a cut is wanted (folds, quotas, a k-th value), rows are not numbered at all: the keys alone are put in order,
the key at every cut becomes a border, and each row compares its own key with the few borders of its group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.session import cut_lineage, shuffle_width, write_and_broadcast

_ROW = (1 << 33) - 1


def with_positions(df: DataFrame, *order: Column | str, name: str = "position", ranges: int | None = None) -> DataFrame:
    """Add the 0-based position of every row under ``order``; equal keys are numbered in any order.

    Only one row count per range reaches the driver.  Keys should be unique or nearly so: rows with one equal key share
    a range.
    """
    n = ranges or shuffle_width(df.sparkSession)
    return numbered(df.repartitionByRange(n, *order).sortWithinPartitions(*order), name)


def numbered(df: DataFrame, name: str = "position") -> DataFrame:
    """Add consecutive numbers from 0 to the rows as they come, partition by partition, without moving them."""
    rng, at = f"{name}__range", f"{name}__at"
    placed = cut_lineage(
        df.withColumn(rng, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)))
    )
    before, total = [], 0
    for k, rows in sorted((r[rng], r["count"]) for r in placed.groupBy(rng).count().collect()):
        before += [total] * (k + 1 - len(before))
        total += rows
    if not before:
        return placed.withColumn(name, F.lit(0).cast("long")).drop(rng, at)
    earlier = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col(rng))
    return placed.withColumn(name, earlier + F.col(at)).drop(rng, at)


def _with_group(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a small table of groups; null is a group like any other."""
    renamed = groups.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], *[c for c in groups.columns if c not in by])
    same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    return df.join(write_and_broadcast(renamed), same or F.lit(True)).drop(*[f"_by{i}" for i in range(len(by))])


def with_ranks(df: DataFrame, by: Sequence[str], *order: Column | str, ranges: int | None = None) -> DataFrame:
    """Add the 0-based ``rank`` of every row in its group, and the group's rows ``group_n``."""
    placed = with_positions(df, *by, *order, name="_pos", ranges=ranges)
    groups = placed.groupBy(*by).agg(F.min("_pos").alias("_first"), F.count("*").alias("group_n"))
    return _with_group(placed, groups, by).withColumn("rank", F.col("_pos") - F.col("_first")).drop("_pos", "_first")


def cut_by_rank(
    df: DataFrame, by: Sequence[str], key: Column, part: Callable[[Column, Column], Column], name: str, ranges: int | None = None
) -> DataFrame:
    """Add ``part(rank, group_n)``, a number that never falls as the rank grows, without moving the rows.

    Only ``by`` and ``key`` are shuffled and sorted.  The smallest key of every (group, part) is its border: groups x parts
    rows.  Keys must be unique in their group.
    """
    ranked = with_ranks(df.select(*by, key.alias("_key")), by, "_key", ranges=ranges)
    firsts = ranked.groupBy(*by, part(F.col("rank"), F.col("group_n")).alias("_part")).agg(F.min("_key").alias("_from"))
    borders = firsts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_from", "_part"))).alias("_borders"))
    own = df.withColumn("_key", key)
    joined = _with_group(own, borders, by)
    last = F.element_at(F.filter("_borders", lambda b: b["_from"] <= F.col("_key")), -1)
    return joined.withColumn(name, last["_part"]).drop("_key", "_borders")


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows under ``order``, however many, gathered nowhere."""
    return with_positions(df, *order, name="_pos").filter(F.col("_pos") < n).drop("_pos")
