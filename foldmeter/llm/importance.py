"""Importance resampling towards a target: weights from hashed word features, Gumbel-top-k draw.

Bit-sliced aggregation.  A document's bucket counts are held as bit planes, plane j having bit b set where bit j of the
count of bucket b is set.  The gains of all buckets are held the same way, in two's complement.  The sum of count times
gain over all buckets is then a sum of popcounts, each of the AND of a count plane with a gain plane, times a power of
two; it is exact, and needs no multiplication per feature.

Corpus counts are one row per bucket and task before the shuffle, so their size is bounded by the number of buckets.  The
text is read twice (counts, weights) and never shuffled; only ids and scores are, for the global order of the draw.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.words import spans, text_bytes
from foldmeter.operators.order import with_positions
from foldmeter.session import cut_lineage

BUCKETS = 10_000
#: Documents whose planes are in memory at once: 64 planes of 10000 bits each are 41 MB.
BLOCK = 512
#: Bytes of a word hashed for all words of a chunk at once; what is longer is hashed word by word.
STEPS = 48

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _feed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes ``start`` to ``end`` of each word, longest words first."""
    order = np.argsort(start - end, kind="stable")
    s, at, size = state[order], start[order], (end - start)[order]
    longest = int(size[0]) if len(size) else 0
    for k in range(min(longest, STEPS)):
        n = int(np.searchsorted(-size, -k))  # the words longer than k
        s[:n] = _CRC[(s[:n] ^ data[at[:n] + k]) & 255] ^ (s[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -STEPS))):
        rest = data[at[i] + STEPS : at[i] + size[i]].tobytes()
        s[i] = zlib.crc32(rest, int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def _features(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of every word and word pair of some texts, and the words per text."""
    data = _FOLD[data]
    n = len(data)
    inside = _INSIDE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    words = np.diff(np.searchsorted(start, at))
    doc = np.repeat(np.arange(len(at) - 1), words)
    data = data.astype(np.uint32)
    one = _feed(np.full(len(start), 0xFFFFFFFF, np.uint32), data, start, end)
    left = np.flatnonzero(doc[1:] == doc[:-1])
    two = _CRC[(one[left] ^ np.uint32(32)) & 255] ^ (one[left] >> np.uint32(8))
    two = _feed(two, data, start[left + 1], end[left + 1])
    crc = np.concatenate([one, two]) ^ np.uint32(0xFFFFFFFF)
    return np.concatenate([doc, doc[left]]), (crc % np.uint32(buckets)).astype(np.int64), words


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int):
    """Per chunk of texts: batch, row range, words per text, and the (document, bucket) features."""
    for batch in batches:
        data, at = text_bytes(batch.column(0))
        for i, j in spans(at):
            doc, bucket, words = _features(data[at[i] : at[j]], at[i : j + 1] - at[i], buckets)
            yield batch, i, j, words, doc, bucket


def bucket_counts(texts: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, _, _, _, bucket in _chunks(batches, buckets):
            total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = texts.select(F.col(text_column)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # one row per bucket at most
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source share, smoothed by one, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((int(t) + 1) * (s_all + n) / ((int(s) + 1) * (t_all + n)))) for s, t in zip(source, target)], np.int64
    )


def _bits(set_at: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    width = -(-buckets // 64)
    flags = np.zeros((len(set_at), width * 64), bool)
    flags[:, :buckets] = set_at
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the gains in two's complement, and what a bit of each plane is worth."""
    k = max(int(np.abs(gains).max(initial=0)).bit_length(), 1)
    planes = np.stack([(gains >> j) & 1 for j in range(k + 1)]).astype(bool)
    worth = 1 << np.arange(k + 1, dtype=np.int64)
    worth[k] = -worth[k]
    return _bits(planes, len(gains)), worth


def count_planes(doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, docs: int, buckets: int) -> Iterator[np.ndarray]:
    """Bit planes of the counts of ``docs`` documents, lowest first; (doc, bucket) ascending and distinct."""
    width = -(-buckets // 64)
    word, bit = doc * width + (bucket >> 6), np.uint64(1) << (bucket & 63).astype(np.uint64)
    for j in range(int(count.max(initial=0)).bit_length()):
        has = np.flatnonzero((count >> j) & 1)
        plane = np.zeros(docs * width, np.uint64)
        if len(has):
            w = word[has]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            plane[w[first]] = np.bitwise_or.reduceat(bit[has], first)
        yield plane.reshape(docs, width)


def gain_sums(doc: np.ndarray, bucket: np.ndarray, docs: int, planes: np.ndarray, worth: np.ndarray, buckets: int) -> np.ndarray:
    """Per document the sum of the gains of its features."""
    keys, counts = np.unique(doc * buckets + bucket, return_counts=True)
    out = np.zeros(docs, np.int64)
    for a in range(0, docs, BLOCK):
        b = min(a + BLOCK, docs)
        i, j = np.searchsorted(keys, [a * buckets, b * buckets])
        of, at = np.divmod(keys[i:j], buckets)
        for level, plane in enumerate(count_planes(of - a, at, counts[i:j], b - a, buckets)):
            for gain, value in zip(planes, worth):
                out[a:b] += np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) * (int(value) << level)
    return out


def importance_weights(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of its features.

    Features are words (runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased) and pairs
    of neighbouring words.  Null, empty and wordless texts have no feature and weight 0; an empty target or table leaves
    smoothed shares only.  Repeated rows count and are scored each; other columns are ignored, whatever their names.
    """
    gains = bucket_gains(bucket_counts(docs, text_column, buckets), bucket_counts(target, target_text, buckets))
    planes, worth = gain_planes(gains)

    def weigh(batches):
        for batch, i, j, words, doc, bucket in _chunks(batches, buckets):
            sums = gain_sums(doc, bucket, j - i, planes, worth, buckets)
            features = words + np.maximum(words - 1, 0)
            weight = np.floor_divide(sums, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i), pa.array(words.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight)],
                names=["id", "n_words", "n_features", "weight"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(text_column), F.col(id_column).alias("id"))
    return rows.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_column: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw that depends on seed and id alone; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text: str = "text",
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``least_words`` words, without replacement, by importance.

    Returns every row's id, ``n_features``, ``weight``, ``score`` (weight plus seeded Gumbel noise) and ``rank``: 1, 2, 3...
    by falling score, then rising id (null last), for the drawn rows and null for the others.  The same rows give the same
    result in any order and partitioning.
    """
    weighed = importance_weights(docs, target, id_column, text_column, target_text, buckets)
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    of = F.col("n_words") >= least_words
    drawn = percent * scored.filter(of).count() // 100
    placed = with_positions(scored, (~of).asc(), F.col("score").desc(), F.col("id").asc_nulls_last(), name="position")
    rank = F.when(F.col("position") < drawn, F.col("position") + 1)
    return placed.select(F.col("id").alias(id_column), "n_features", "weight", "score", rank.alias("rank"))
