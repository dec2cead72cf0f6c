"""Seeded, partition-independent hash orders and bucket functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_prefix(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hexadecimal characters of ``digest`` from 1-based ``start``, as bigint."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def seeded_digest(seed: int, *keys: Column) -> Column:
    """md5 over seed and keys: a reproducible random order any SQL engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def term_bucket(term: Column, n_buckets: int, method: str = "xxhash64") -> Column:
    if method == "md5":
        return F.pmod(hex_prefix(F.md5(term), 1, 8), F.lit(n_buckets)).cast("int")
    return F.pmod(F.xxhash64(term), F.lit(n_buckets)).cast("int")


def term_sign(term: Column, method: str = "xxhash64") -> Column:
    """+1.0 or -1.0, independent of the bucket bits."""
    if method == "md5":
        bit = F.pmod(hex_prefix(F.md5(term), 9, 1), F.lit(2))
    else:
        bit = F.pmod(F.shiftright(F.xxhash64(F.lit("sign"), term), 17), F.lit(2))
    return F.when(bit == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
