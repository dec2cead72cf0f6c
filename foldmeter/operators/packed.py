"""Term counts of texts, packed by chunks of rows.

A chunk is a bounded number of (row, term) entries of neighbouring rows.  Its terms are listed once, with the counts of the chunk;
its rows keep places in that list.  Vocabularies are summed from the lists, and weights found by term go back to the lists, so
only the different terms of a chunk meet the vocabulary, not every term of every row.  Rows and weights of a chunk then meet
in one small group, which writes the entries out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.session import cut_lineage, has_at_most, spread_small

#: A chunk is closed once it holds so many entries.
CHUNK_ENTRIES = 1 << 19
#: Texts of a batch that are Python strings at a time.
TEXTS = 64


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One list of ``values`` per size."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _bytes(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The same as the bytes of int32 numbers: nothing is converted number by number on the way."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of such a column, and how many each row has."""
    sizes, parts = [], []
    for c in column.chunks:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
        sizes.append(np.diff(ends) // 4)
        if ends[-1] > ends[0]:
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.int32))
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *parts]), np.concatenate([none, *sizes])


class _Chunk:
    """Rows gathered so far, their terms and counts."""

    def __init__(self):
        self.places: defaultdict[str, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.ix, self.tf, self.sizes, self.kept = [], [], [], []
        self.entries = 0

    def add(self, text: str) -> bool:
        # str.split knows the blanks of ``functions.text.tokens``: Unicode white space and 0x1c-0x1f
        counts = Counter(text.split())
        if counts:
            self.ix.append(np.fromiter(map(self.places.__getitem__, counts), np.int32, len(counts)))
            self.tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
            self.sizes.append(len(counts))
            self.entries += len(counts)
        return bool(counts)

    def batches(self, number: int, folds: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The chunk's rows, then its terms."""
        ix, tf, sizes = np.concatenate(self.ix), np.concatenate(self.tf), np.array(self.sizes)
        kept = pa.concat_tables(self.kept)
        n = len(self.places)
        fold = kept.column("fold").to_numpy() if folds else np.zeros(len(sizes), np.int64)
        per_entry = np.repeat(fold, sizes).astype(np.int64)
        k = max(folds, 1)
        known = (per_entry >= 0) & (per_entry < k)
        dfs = np.bincount(ix[known] * k + per_entry[known], minlength=n * k).astype(np.int64)
        total = np.bincount(ix, weights=tf, minlength=n).astype(np.int64)
        rows = {"ix": _bytes(ix, sizes), "tf": _bytes(tf, sizes), **{c: kept.column(c).combine_chunks() for c in kept.column_names}}
        terms = {"at": pa.array(np.arange(n, dtype=np.int32)), "term": pa.array(list(self.places)), "dfs": _lists(dfs, np.full(n, k)), "n": pa.array(total)}
        for part, size in ((rows, len(sizes)), (terms, n)):
            columns = [pa.array(np.full(size, number)), *[part[f.name].cast(f.type) if f.name in part else pa.nulls(size, f.type) for f in list(schema)[1:]]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class PackedTerms:
    """``rows`` is (chunk, row_id, keep..., ix, tf), ``terms`` (chunk, at, term, dfs, n) with the chunk's rows per fold that hold
    the term, and its occurrences.  ``unique``: no row_id comes twice among the rows that have terms."""

    rows: DataFrame
    terms: DataFrame
    keep: tuple[str, ...]
    unique: bool

    @staticmethod
    def of(df: DataFrame, text: str, lowercase: bool = False, keep: Sequence[str] = (), folds: int = 0) -> PackedTerms:
        """Read the texts once and write them packed.  ``folds`` wants ``fold`` among ``keep``."""
        words = F.coalesce(F.col(text).cast("string"), F.lit(""))
        words = F.make_valid_utf8(F.lower(words) if lowercase else words)
        source = spread_small(df.select("row_id", *keep, words.alias("_words")))
        kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
        names = ["row_id", *keep]
        limit = CHUNK_ENTRIES

        def packed(batches):
            part, done, chunk, schema = TaskContext.get().partitionId() << 32, 0, _Chunk(), None
            for batch in batches:
                fixed = batch.select(names)
                if schema is None:
                    lists = [("ix", pa.binary()), ("tf", pa.binary()), ("at", pa.int32()), ("term", pa.string())]
                    counts = [("dfs", pa.list_(pa.int64())), ("n", pa.int64())]
                    schema = pa.schema([("chunk", pa.int64()), *[(f.name, f.type) for f in fixed.schema], *lists, *counts])
                for start in range(0, len(batch), TEXTS):
                    some = batch.column(len(names)).slice(start, TEXTS).to_pylist()
                    used = [start + i for i, t in enumerate(some) if chunk.add(t)]
                    if used:
                        chunk.kept.append(pa.Table.from_batches([fixed]).take(pa.array(used)))
                    if chunk.entries >= limit:
                        yield from chunk.batches(part + done, folds, schema)
                        done, chunk = done + 1, _Chunk()
            if chunk.entries:
                yield from chunk.batches(part + done, folds, schema)

        fixed = ", ".join(f"`{c}` {kinds[c]}" for c in names)
        shape = f"chunk long, {fixed}, ix binary, tf binary, at int, term string, dfs array<long>, n long"
        table = cut_lineage(source.mapInArrow(packed, shape), "zstd")
        rows = table.filter("term IS NULL").select("chunk", *names, "ix", "tf")
        repeated = rows.groupBy("row_id").count().filter("count > 1")
        return PackedTerms(rows, table.filter("term IS NOT NULL").select("chunk", "at", "term", "dfs", "n"), tuple(keep), has_at_most(repeated, 0))

    def totals(self, folds: int = 1) -> DataFrame:
        """(term, dfs, n): rows per fold holding the term, and its occurrences."""
        dfs = F.array(*[F.sum(F.get("dfs", F.lit(f))) for f in range(folds)])
        return self.terms.groupBy("term").agg(dfs.alias("dfs"), F.sum("n").alias("n"))

    def entries(self, weights: DataFrame, build: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``build(rows, weights)`` of every chunk; ``weights`` is (chunk, at, ...)."""
        rows = self.rows.select(*[F.col(c).alias(c) for c in self.rows.columns])  # columns of its own beside those of the same table
        return rows.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(build, schema)

    def kind(self, name: str) -> str:
        return self.rows.schema[name].dataType.simpleString()


def flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, place and count of every entry of packed rows."""
    ix, sizes = _numbers(rows.column("ix"))
    return np.repeat(np.arange(len(rows)), sizes), ix, _numbers(rows.column("tf"))[0]


def scaled(values: np.ndarray, row: np.ndarray, n_rows: int, norm: str | None) -> np.ndarray:
    """Values (entries, ...) brought to length 1 per row; a row of zeros stays."""
    if norm is None or not len(values):
        return values
    columns = values.reshape(len(values), -1)
    out = np.empty_like(columns)
    for j in range(columns.shape[1]):
        v = columns[:, j]
        size = np.bincount(row, weights=np.abs(v) if norm == "l1" else v * v, minlength=n_rows)
        size = size if norm == "l1" else np.sqrt(size)
        out[:, j] = v / np.where(size == 0, 1.0, size)[row]
    return out.reshape(values.shape)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()
