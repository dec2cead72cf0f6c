"""Equi-join of a large frame with a keyed table of unknown size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, fits_broadcast, row_bytes

#: Aim for at most this many joined rows per salt, and at most this many hot keys.
ROWS_PER_SALT = 5_000_000
HOT_KEYS = 10_000

#: Where a whole table is too large to broadcast, so many of its most frequent keys are.
FREQUENT_KEYS = BROADCAST_ROWS // 4


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    spread_by: str = "row_id",
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Inner join; ``table`` has unique ``keys`` and knows how often each occurs (``weight``).

    A table measured as small, in rows and bytes, is broadcast.  Otherwise frequent keys are salted by
    their known frequency: the table repeats a hot key's row once per salt, and
    the big side spreads over the salts.
    """
    if fits_broadcast(table, broadcast_rows):
        return big.join(F.broadcast(table), keys)
    total = table.agg(F.sum(weight)).first()[0] or 0
    per_salt = max(rows_per_salt, total // HOT_KEYS, 1)
    copies = F.ceil(F.col(weight) / F.lit(per_salt)).cast("int")
    salted = table.withColumn("_copies", F.greatest(copies, F.lit(1)))
    hot = salted.filter("_copies > 1").select(*keys, "_copies")  # at most HOT_KEYS rows
    right = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    left = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_copies", F.lit(1))).cast("int")
    )
    return left.drop("_copies").join(right, [*keys, "_salt"]).drop("_salt")


def frequent_join(big: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner or left join; ``table`` has unique ``key`` and ``weight``, above 0: about how often each occurs, left out of the result.

    Where few keys hold most rows, as words do, only the rows of rare keys are shuffled: the others meet the most frequent keys'
    part of the table where they are.  Both sides are then read twice: hand in tables.
    """
    right = table.drop(weight)
    if fits_broadcast(right, broadcast_rows):
        return big.join(F.broadcast(right), key, how)
    power = F.floor(F.log2(weight))
    sizes = table.groupBy(power.alias("k")).agg(F.count("*").alias("n"), F.sum(row_bytes(right)).alias("size")).collect()  # one row per power of two
    least, n, size = 64, 0, 0
    for r in sorted(sizes, key=lambda r: -r["k"]):
        n, size = n + r["n"], size + r["size"]
        if n > FREQUENT_KEYS or size > BROADCAST_BYTES:
            break
        least = r["k"]
    frequent = table.filter(power >= least).drop(weight)
    here = big.join(F.broadcast(frequent), key)
    others = big.join(F.broadcast(frequent.select(key)), key, "left_anti")
    return here.unionByName(others.join(broadcast_if_small(table.filter(power < least).drop(weight)), key, how))
