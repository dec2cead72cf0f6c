"""Exact interpolated quantiles per feature without gathering a feature's values.

A sketch gives a narrow bracket around each quantile.  One more aggregation
counts what lies below and above, keeping the values next to the bracket, and
counts the distinct values inside; the quantile is read off the running counts.  Equal
values are counted before the shuffle, so a value held by most rows is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldmeter.operators.order import with_positions
from foldmeter.session import broadcast_if_small, cut_lineage, write_and_broadcast

ACCURACY = 10_000


def exact_quantiles(values: DataFrame, probabilities: Sequence[float], key: str = "feature_ix") -> DataFrame:
    """(key, q array<double>) for a frame (key, value)."""
    pad = 3 / ACCURACY
    ends = [e for p in probabilities for e in (max(p - pad, 0.0), min(p + pad, 1.0))]
    brackets = values.groupBy(key).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("value", F.array(*[F.lit(e) for e in ends]), F.lit(ACCURACY)).alias("_e"),
    )
    spans = [
        {"lo": F.get("_e", F.lit(2 * i)), "hi": F.get("_e", F.lit(2 * i + 1))} for i in range(len(probabilities))
    ]
    v = F.col("value")
    placed = values.join(write_and_broadcast(brackets), key)

    def zone_of(span):
        return F.when(v < span["lo"], -1).when(v > span["hi"], 1).otherwise(0)

    # One row per combination of zones, plus one per distinct value inside a bracket.
    zones = F.array(*[zone_of(s) for s in spans])
    placed = placed.select(key, "value", "_n", zones.alias("zones"))
    inside = F.array_contains("zones", 0)
    counted = placed.groupBy(key, "_n", "zones", F.when(inside, v).alias("_in")).agg(
        F.count("*").alias("c"), F.min("value").alias("_min"), F.max("value").alias("_max")
    )
    wanted = [F.struct(F.lit(i).alias("q"), F.lit(p).alias("p"), F.get("zones", F.lit(i)).alias("zone")) for i, p in enumerate(probabilities)]
    counted = counted.select(key, "_n", "c", "_min", "_max", "_in", F.explode(F.array(*wanted)).alias("s")).select(
        key, "_n", "c", "_min", "_max", "s.q", "s.p", "s.zone", F.when(F.col("s.zone") == 0, F.col("_in")).alias("_in")
    )
    counted = counted.groupBy(key, "_n", "q", "p", "zone", "_in").agg(
        F.sum("c").alias("c"), F.min("_min").alias("_min"), F.max("_max").alias("_max")
    )
    # Below the bracket the largest value is the last one, above it the smallest is the first.
    counted = counted.withColumn("v", F.when(F.col("zone") < 0, F.col("_max")).otherwise(F.col("_min")))
    running = counted.withColumn("cum", F.sum("c").over(W.partitionBy(key, "q").orderBy("zone", "_in")))
    pos = (F.col("_n") - 1) * F.col("p")

    def at(position):
        return F.min(F.when(F.col("cum") > position, F.struct("cum", "v", "zone", (F.col("cum") - F.col("c")).alias("before"))))

    found = running.groupBy(key, "q").agg(
        at(F.floor(pos)).alias("a"), at(F.ceil(pos)).alias("b"), F.max(pos).alias("pos")
    )
    def outside(e: str, position):
        last_below = position == F.col(f"{e}.cum") - 1
        first_above = position == F.col(f"{e}.before")
        return F.when(F.col(f"{e}.zone") < 0, ~last_below).when(F.col(f"{e}.zone") > 0, ~first_above).otherwise(False)

    wrong = outside("a", F.floor("pos")) | outside("b", F.ceil("pos"))
    part = F.col("pos") - F.floor("pos")
    value = F.when(wrong, F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(
        F.col("a.v") + (F.col("b.v") - F.col("a.v")) * part
    )
    return (
        found.select(key, "q", value.alias("v"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("q", "v"))).alias("s"))
        .select(key, F.transform("s", lambda e: e["v"]).alias("q"))
    )


def sparse_quantiles(entries: DataFrame, n_rows: int, probabilities: Sequence[float]) -> DataFrame:
    """(feature_ix, q array<double>, n): interpolated quantiles over all ``n_rows`` rows of a long frame without its zeros, and
    the feature's stored entries.

    A feature's zeros stand between its negative and its positive values, so its counts tell whether any wanted rank falls on
    a stored value.  Only the values of such features, few where most entries are absent, are put in one global order of
    (feature, value); the quantiles of all others are 0.
    """
    stored = entries.select("feature_ix", "value").filter("value <> 0")
    at = [(n_rows - 1) * p for p in probabilities]
    lowest, highest = min(map(math.floor, at)), max(map(math.ceil, at))
    counts = cut_lineage(stored.groupBy("feature_ix").agg(F.count_if(F.col("value") < 0).alias("_below"), F.count_if(F.col("value") > 0).alias("_above")))
    reached = counts.filter((F.col("_below") > lowest) | (F.col("_above") >= n_rows - highest)).select("feature_ix")
    placed = with_positions(stored.join(broadcast_if_small(reached), "feature_ix"), "feature_ix", "value", name="_pos")
    groups = placed.groupBy("feature_ix").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    ranked = placed.join(write_and_broadcast(groups), "feature_ix")
    zeros = F.lit(n_rows) - F.col("_n")
    rank = F.col("_pos") - F.col("_first") + F.when(F.col("value") > 0, zeros).otherwise(0)

    def value_at(i: int) -> Column:
        return F.coalesce(F.max(F.when(rank == i, F.col("value"))), F.lit(0.0))

    low = [value_at(math.floor(x)) for x in at]
    high = [value_at(math.ceil(x)) for x in at]
    q = F.array(*[a + (b - a) * (x - math.floor(x)) for a, b, x in zip(low, high, at)])
    found = ranked.groupBy("feature_ix").agg(q.alias("q"))
    n = (F.col("_below") + F.col("_above")).alias("n")
    found = write_and_broadcast(found)
    return counts.join(found, "feature_ix", "left").select("feature_ix", F.coalesce("q", F.array(*[F.lit(0.0) for _ in at])).alias("q"), n)
