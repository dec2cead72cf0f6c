"""Quality scores by nearest labelled neighbours in a latent-semantic space.

Texts become counts of hashed byte trigrams and of trigrams of character classes.  A bounded sample of labelled texts gives
term weights and a truncated decomposition; its vectors and labels are broadcast, every text is projected and compared with
all of them by matrix products, and the labels of the nearest are averaged by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.words import mix, spans, text_bytes
from foldmeter.session import broadcast_if_small, cut_lineage

TEXT_TERMS, CLASS_TERMS = 2048, 512
TERMS = TEXT_TERMS + CLASS_TERMS
#: Labelled texts the model is fitted on, at most.
SAMPLE = 3000

_CLASS = np.full(256, 7, np.uint8)  # other bytes of longer characters count as letters
_CLASS[: ord("a")] = 0
for _c, _chars in enumerate([range(97, 123), range(65, 91), range(48, 58), [32], [10], [9, 11, 12, 13]], 1):
    _CLASS[list(_chars)] = _c
for _c, _chars in enumerate(["#*$%&", "|<>", "!?", ".,;:"], 8):
    _CLASS[[ord(x) for x in _chars]] = _c
_PLACES = (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(53)).astype(np.int32)  # 11 bits
_CLASS_PLACES = (mix(np.arange(1 << 12, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(55)).astype(np.int32)  # 9 bits


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) for the texts of a column, chunk by chunk."""
    data, at = text_bytes(column)
    for i, j in spans(at, 1 << 19):
        own = data[at[i] : at[j]]
        n = j - i
        out = np.zeros((n, TERMS), np.float32)
        if len(own) > 2:
            doc = np.repeat(np.arange(n), np.diff(at[i : j + 1]))
            whole = doc[2:] == doc[:-2]
            b = own.astype(np.int32)
            three = _PLACES[(b[:-2] << 8 ^ b[1:-1] << 4 ^ b[2:] * 257) & 0xFFFF]
            c = _CLASS[own].astype(np.int32)
            kinds = TEXT_TERMS + _CLASS_PLACES[c[:-2] << 8 | c[1:-1] << 4 | c[2:]]
            base = doc[:-2][whole] * TERMS
            out = np.bincount(np.concatenate([base + three[whole], base + kinds[whole]]), minlength=n * TERMS)
            out = out.reshape(n, TERMS).astype(np.float32)
        yield i, out


@dataclass
class Space:
    """Term weights, projection, and the sample's unit vectors and labels."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray, labels: np.ndarray, dims: int) -> Space:
        weight = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        x = unit(np.sqrt(counts) * weight)
        _, basis = np.linalg.eigh(x.T @ x)
        basis = np.ascontiguousarray(basis[:, ::-1][:, :dims], dtype=np.float32)
        return Space(weight, basis, unit(x @ basis), labels.astype(np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def vote(counts: np.ndarray, weight, basis, vectors, labels, k: int, prior: float) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest; ``prior`` where nothing is similar."""
    x = unit(unit(np.sqrt(counts) * weight) @ basis)
    out = np.empty(len(x))
    k = min(k, len(vectors))
    for i in range(0, len(x), 256):
        alike = x[i : i + 256] @ vectors.T
        near = np.argpartition(-alike, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(alike, near, 1), 0) ** 4
        total = w.sum(1)
        out[i : i + 256] = np.where(total > 0, (w * labels[near]).sum(1) / np.where(total > 0, total, 1), prior)
    return np.clip(out, 0, 1)


def neighbour_quality(
    docs: DataFrame,
    labelled: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = SAMPLE,
    dims: int = 64,
    k: int = 15,
) -> DataFrame:
    """(id, score) for every row of ``docs``: how likely label 1 is, 0 to 1.

    ``labelled`` (id, label 0 or 1) says what may be learnt from; at most ``sample`` of its texts, those with the smallest
    hashes of the id, are used.  Null and very short texts have no terms and get the sample's mean label, as do all if there
    is nothing to learn from (0.5 then).  Rows repeating an id are scored one by one.
    """
    spark = docs.sparkSession
    chosen = labelled.filter("label is not null and id is not null").dropDuplicates(["id"])
    chosen = cut_lineage(chosen.orderBy(F.xxhash64("id"), "id").limit(sample))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in term_counts(batch.column("text")):
                lists = pa.array(list(x), pa.list_(pa.float32()))
                yield pa.record_batch([batch.column("label").slice(first, len(x)), lists], ["label", "terms"])

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    train = texts.join(broadcast_if_small(chosen), "id").dropDuplicates(["id"]).select("label", "text")
    got = train.mapInArrow(counted, "label int, terms array<float>").toArrow()
    if got.num_rows:
        terms = got.column("terms").combine_chunks()
        counts = np.asarray(terms.values if hasattr(terms, "values") else terms.chunk(0).values).reshape(-1, TERMS)
        labels = np.asarray(got.column("label").combine_chunks())
        order = np.lexsort((*counts[:, :3].T, counts.sum(1)))  # a fixed order, whatever the tasks' order was
        s = Space.fit(counts[order], labels[order], dims)
        arrays, prior = (s.weight, s.basis, s.vectors, s.labels), float(labels.mean())
    else:
        arrays, prior = None, 0.5
    shared = spark.sparkContext.broadcast(arrays)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, x in term_counts(batch.column("text")):
                y = np.full(len(x), prior) if model is None else vote(x, *model, k, prior)
                yield pa.record_batch([batch.column("id").slice(first, len(x)), pa.array(y)], ["id", "score"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_column)
