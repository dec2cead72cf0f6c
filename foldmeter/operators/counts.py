"""Counts of a text's terms as vectors over a vocabulary that no machine holds whole.

``pyspark.ml``'s ``CountVectorizer`` gathers its vocabulary on the driver, sends it to every task and writes an attribute per
term into the column.  Here the vocabulary stays a table; only the different terms of a chunk of rows meet it (see
``operators.packed``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.operators.features import sparse_vectors
from foldmeter.operators.order import first_rows, with_positions
from foldmeter.operators.packed import PackedTerms, _lists, flat, numbers
from foldmeter.session import broadcast_if_small, cut_lineage, has_at_most


@dataclass
class Terms(Sequence):
    """The terms of a vocabulary in feature order, read from its table when asked for; ``prefix`` stands before each."""

    table: DataFrame
    size: int
    prefix: str = ""

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[str]:
        return (self.prefix + r["term"] for r in self.table.orderBy("feature_ix").select("term").toLocalIterator())

    def __getitem__(self, i):
        return self.pick(range(self.size)[i]) if isinstance(i, slice) else self.pick([range(self.size)[i]])[0]

    def pick(self, indices: Sequence[int]) -> list[str]:
        """The terms of these features alone."""
        wanted = self.table.sparkSession.createDataFrame([(int(i),) for i in {*indices}], "feature_ix int")
        found = dict(self.table.join(F.broadcast(wanted), "feature_ix").select("feature_ix", "term").collect())
        return [self.prefix + found[i] for i in indices]


@dataclass
class WideCounts:
    """What a fitted ``CountVectorizer`` is, for any width; terms of one count are in the order of their bytes."""

    vocab: DataFrame
    width: int
    attribute: str
    lowercase: bool
    min_tf: float
    binary: bool
    train: DataFrame
    keyed: DataFrame
    packed: PackedTerms

    @staticmethod
    def fit(stage: CountVectorizer, train: DataFrame, attribute: str, lowercase: bool, least: int) -> WideCounts | None:
        """None where the vocabulary has at most ``least`` terms."""
        size = stage.getVocabSize()
        if size <= least:
            return None
        keyed, packed = _packed(train, attribute, lowercase)
        totals = packed.totals().select("term", F.get("dfs", F.lit(0)).alias("df"), "n")
        n_rows = keyed.count()
        low, high = (limit if limit >= 1.0 else limit * n_rows for limit in (stage.getMinDF(), stage.getMaxDF()))
        totals = cut_lineage(totals.filter((F.col("df") >= F.lit(float(low))) & (F.col("df") <= F.lit(float(high)))))
        if has_at_most(totals, least):
            return None
        order = (F.col("n").desc(), "term")
        if not has_at_most(totals, size):
            totals = first_rows(totals, size, *order)
        ranked = with_positions(totals, *order, name="at")
        vocab = ranked.select("term", F.col("at").cast("int").alias("feature_ix"))
        return WideCounts(vocab, vocab.count(), attribute, lowercase, stage.getMinTF(), stage.getBinary(), train, keyed, packed)

    @property
    def vocabulary(self) -> Terms:
        return Terms(self.vocab, self.width)

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with a sparse vector ``out`` per row."""
        keyed, packed = (self.keyed, self.packed) if df is self.train else _packed(df, self.attribute, self.lowercase)
        weights = packed.terms.select("chunk", "at", "term").join(broadcast_if_small(self.vocab), "term").drop("term")
        least, binary = self.min_tf, self.binary

        def build(rows: pa.Table, found: pa.Table) -> pa.Table:
            row, ix, tf = flat(rows)
            at = numbers(found, "at")
            slot = np.full(max(int(ix.max(initial=-1)), int(at.max(initial=-1))) + 1, -1)
            slot[at] = numbers(found, "feature_ix")
            feature = slot[ix]
            limit = least if least >= 1.0 else least * np.bincount(row, weights=tf, minlength=len(rows))[row]
            there = (feature >= 0) & (tf >= limit)
            row, feature, tf = row[there], feature[there], tf[there]
            order = np.lexsort((feature, row))
            value = np.ones(len(tf)) if binary else tf[order].astype(np.float64)
            sizes = np.bincount(row, minlength=len(rows))
            return pa.table({"_at": rows.column("row_id"), "_ix": _lists(feature[order].astype(np.int32), sizes), "_v": _lists(value, sizes)})

        parts = packed.entries(weights, build, "_at long, _ix array<int>, _v array<double>")
        found = sparse_vectors(keyed.select("_at").join(parts, "_at", "left"), out, self.width)
        return keyed.join(found, "_at").drop("_at")


def _packed(df: DataFrame, attribute: str, lowercase: bool) -> tuple[DataFrame, PackedTerms]:
    """``df`` with a key ``_at`` of its own, as row ids may repeat, and its terms under that key."""
    keyed = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
    return keyed, PackedTerms.of(keyed.select(F.col("_at").alias("row_id"), F.col(attribute).alias("_text")), "_text", lowercase)
