"""Exact 0-based ranks by number, by text and in seeded random order (see ``operators.order``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.functions.hashing import seeded_digest
from foldmeter.operators.order import with_ranks


def rank_by_key(df: DataFrame, key: str = "row_id", by: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Add ``rank`` by ascending ``key`` inside each ``by`` group, and ``group_n``."""
    return with_ranks(df, list(by), key, ranges=n_buckets)


def rank_shuffled(df: DataFrame, seed: int, key: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """Rank in the seeded random order of ``key``."""
    return with_ranks(df.withColumn("_digest", seeded_digest(seed, F.col(key))), list(by), "_digest", key).drop("_digest")


def rank_by_text(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank by ascending UTF-8 bytes of a text."""
    return with_ranks(df, list(by), key)
