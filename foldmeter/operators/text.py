"""Text features in long form: (row_id, feature_ix, value), zeros left out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldmeter.functions.hashing import term_bucket, term_sign
from foldmeter.functions.text import tokens
from foldmeter.operators.bayes import SMOOTHING, step_sum
from foldmeter.operators.lookup import frequent_join
from foldmeter.operators.order import first_rows, numbered
from foldmeter.operators.packed import PackedTerms, flat, numbers, scaled
from foldmeter.operators.ranks import rank_by_text
from foldmeter.session import broadcast_if_small, cut_lineage, spread_small

NORMS = (None, "l1", "l2")


def _runs(items: Column, key, build) -> Column:
    """Sort an array and build one element per run of equal keys: ``build(sorted, from, to)``."""

    def over(s: Column) -> Column:
        n = F.size(s)
        at = lambda i: key(F.get(s, i))
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (at(i) != at(i - 1)))

        def measured(b: Column) -> Column:
            ends = F.concat(F.slice(b, 2, F.greatest(F.size(b), F.lit(1))), F.array(n))
            return F.zip_with(b, ends, lambda lo, hi: F.when(lo.isNotNull(), build(s, lo, hi)))

        return F.filter(_bind(starts, measured), lambda e: e.isNotNull())

    return _bind(F.sort_array(items), over)


def hashed_counts(words: Column, n_features: int, non_negative: bool, norm: str | None, method: str) -> Column:
    """array<struct<feature_ix, value>> of one row in bucket order, zeros left out, normalized.

    Each token is coded as ``2 * bucket + (1 if its sign is negative)``.
    """

    def code(t: Column) -> Column:
        doubled = term_bucket(t, n_features, method) * 2
        return doubled if non_negative else F.when(term_sign(t, method) < 0, doubled + 1).otherwise(doubled)

    def total(s: Column, lo: Column, hi: Column) -> Column:
        value = F.aggregate(F.slice(s, lo + 1, hi - lo), F.lit(0), lambda a, c: a + 1 - 2 * (c % 2))
        return F.struct(F.shiftright(F.get(s, lo), 1).alias("feature_ix"), value.cast("double").alias("value"))

    sums = _runs(F.transform(words, code), lambda c: F.shiftright(c, 1), total)
    sums = F.filter(sums, lambda e: e["value"] != 0)
    if norm is None:
        return sums
    power, root = (F.abs, None) if norm == "l1" else (lambda x: x * x, F.sqrt)

    def scaled(a: Column) -> Column:
        size = F.aggregate(a, F.lit(0.0), lambda t, e: t + power(e["value"]), root)
        return _bind(
            size,
            lambda n: F.transform(a, lambda e: F.struct(e["feature_ix"].alias("feature_ix"), (e["value"] / n).alias("value"))),
        )

    return _bind(sums, scaled)


def dense_array(entries: Column, width: int) -> Column:
    """array<double> of ``width`` from entries in index order: the gaps are filled with zeros."""

    def parts(a: Column) -> Column:
        before = F.transform(
            a,
            lambda e, i: F.concat(
                F.array_repeat(
                    F.lit(0.0), e["feature_ix"] - F.when(i == 0, -1).otherwise(F.get(a, i - 1)["feature_ix"]) - 1
                ),
                F.array(e["value"]),
            ),
        )
        last = F.when(F.size(a) == 0, -1).otherwise(F.get(a, F.size(a) - 1)["feature_ix"])
        return F.concat(F.flatten(before), F.array_repeat(F.lit(0.0), F.lit(width - 1) - last))

    return _bind(entries, parts)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted_terms(words: Column) -> Column:
    """array<struct<term, tf>> of one row, in term order."""
    return _runs(
        words, lambda t: t, lambda s, lo, hi: F.struct(F.get(s, lo).alias("term"), (hi - lo).cast("bigint").alias("tf"))
    )


def term_rows(df: DataFrame, text: str = "text", lowercase: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, keep..., term, tf), counted inside the row: no count is shuffled."""
    rows = spread_small(df.select("row_id", *keep, text))
    return rows.select("row_id", *keep, F.inline(counted_terms(tokens(F.col(text), lowercase))))


def term_totals(terms: DataFrame) -> DataFrame:
    """(term, df, n): rows holding the term, and its occurrences."""
    return terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def idf(n_rows: Column, df: Column) -> Column:
    return F.log((1 + n_rows) / (1 + df)) + 1


def vocabulary(counts: DataFrame, n_rows: int, max_features: int | None = None) -> DataFrame:
    """(term, feature_ix, df, n, idf) in term order, from ``term_totals``.

    ``max_features`` keeps the terms with the highest corpus count, ties by term.
    """
    if max_features is not None:
        counts = first_rows(counts, max_features, F.col("n").desc(), "term")
    return rank_by_text(counts, "term").select(
        "term", F.col("rank").cast("int").alias("feature_ix"), "df", "n", idf(F.lit(n_rows), F.col("df")).alias("idf")
    )


def normalized(features: DataFrame, norm: str | None, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Scale each row's values to length 1; a row of zeros stays."""
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {NORMS}")
    if norm is None:
        return features
    v = F.col("value")
    row = W.partitionBy(*keys)
    length = F.sum(F.abs(v)).over(row) if norm == "l1" else F.sqrt(F.sum(v * v).over(row))
    return features.withColumn("_len", length).withColumn(
        "value", F.when(F.col("_len") == 0, v).otherwise(v / F.col("_len"))
    ).drop("_len")


def _weighed(packed: PackedTerms, weights: DataFrame, norm: str | None, step: bool = False) -> DataFrame:
    """(step, row_id, keep..., feature_ix, value) of packed rows; ``weights`` is (chunk, at, feature_ix, idf).

    With ``step``, weights have a step too and a row takes those of its fold, as its step.  Rows are normalized where they are
    if every row_id is one row, else over all rows of their row_id.
    """
    keys = ["row_id"] + [c for c in packed.keep if not (step and c == "fold")]
    own = norm if packed.unique else None

    def build(rows: pa.Table, found: pa.Table) -> pa.Table:
        row, ix, tf = flat(rows)
        at = numbers(found, "at").astype(np.int64)
        size = max(int(ix.max(initial=-1)), int(at.max(initial=-1))) + 1
        place = ix.astype(np.int64)
        if step:
            at, place = at + size * numbers(found, "step"), place + size * numbers(rows, "fold")[row].astype(np.int64)
        slot = np.full(int(max(place.max(initial=-1), at.max(initial=-1))) + 1, -1)
        slot[at] = np.arange(len(at))
        there = slot[place] >= 0
        row, tf, slot = row[there], tf[there], slot[place[there]]
        value = scaled(tf * numbers(found, "idf")[slot], row, len(rows), own)
        parts = {c: rows.column(c).take(pa.array(row)) for c in keys} | ({"step": rows.column("fold").take(pa.array(row)).cast(pa.int32())} if step else {})
        parts |= {"feature_ix": pa.array(numbers(found, "feature_ix")[slot].astype(np.int32)), "value": pa.array(value)}
        return pa.table(parts).select(names)

    names = (["step"] if step else []) + keys + ["feature_ix", "value"]
    kinds = {c: packed.kind(c) for c in keys} | {"step": "int", "feature_ix": "int", "value": "double"}
    out = packed.entries(weights, build, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    return out if own == norm else normalized(out, norm)


@dataclass
class Tfidf:
    """TF-IDF fitted on a training frame; the training rows' terms are kept packed for their own transformation."""

    vocab: DataFrame
    norm: str | None
    text: str
    lowercase: bool
    train: DataFrame | None = None
    packed: PackedTerms | None = None

    @staticmethod
    def fit(
        train: DataFrame,
        text: str = "text",
        max_features: int | None = None,
        case_sensitive: bool = True,
        norm: str | None = "l2",
    ) -> Tfidf:
        if norm not in NORMS:
            raise ValueError(f"norm must be one of {NORMS}")
        if max_features is not None and max_features < 1:
            raise ValueError("max_features must be at least 1")
        packed = PackedTerms.of(train, text, not case_sensitive)
        totals = packed.totals().select("term", F.get("dfs", F.lit(0)).alias("df"), "n")
        vocab = cut_lineage(vocabulary(totals, train.count(), max_features))
        return Tfidf(vocab, norm, text, not case_sensitive, train, packed)

    def width(self) -> int:
        return self.vocab.count()

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """(row_id, keep..., feature_ix, value); terms outside the vocabulary are ignored."""
        packed = self.packed if df is self.train and not keep else PackedTerms.of(df, self.text, self.lowercase, keep)
        weights = frequent_join(packed.terms.select("chunk", "at", "term"), self.vocab.select("term", "feature_ix", "idf", "df"), "term", "df").drop("term")
        return _weighed(packed, weights, self.norm)


def tfidf_by_fold(df: DataFrame, folds: int, text: str = "text", norm: str | None = "l2") -> tuple[DataFrame, DataFrame]:
    """Vocabulary and test features of every step of a ``fold`` column, in one pass each.

    Document counts are kept per fold; the vocabulary of step ``s`` uses the
    other folds only, so no term of a test row alone gets in.
    Returns (step, term, feature_ix, df, idf) and (step, row_id, feature_ix, value).
    """
    packed = PackedTerms.of(df, text, keep=("fold",), folds=folds)
    total = F.aggregate("dfs", F.lit(0).cast("bigint"), lambda a, b: a + b)
    sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}  # one row per fold
    all_rows = sum(sizes.values())
    n_train = F.array(*[F.lit(all_rows - sizes.get(f, 0)) for f in range(folds)])
    by_step = (
        packed.totals(folds).select("term", total.alias("all"), F.posexplode("dfs").alias("step", "own"))
        .select("step", "term", (F.col("all") - F.col("own")).alias("df"), F.get(n_train, F.col("step")).alias("n"))
        .filter("df > 0")
    )
    vocab = rank_by_text(by_step, "term", by=["step"]).select(
        "step", "term", F.col("rank").cast("int").alias("feature_ix"), "df", idf(F.col("n"), F.col("df")).alias("idf")
    )
    vocab = cut_lineage(vocab)
    held = packed.terms.select("chunk", "at", "term", F.posexplode("dfs").alias("step", "own")).filter("own > 0").drop("own")
    weights = held.join(broadcast_if_small(vocab.select("step", "term", "feature_ix", "idf")), ["step", "term"]).drop("term")
    return vocab, _weighed(packed, weights, norm, step=True)


@dataclass
class TfidfFolds:
    """TF-IDF of all steps of a ``fold`` column at once: one vocabulary with a weight per step.

    The text is read once, for the packed counts.  A term's weight at step ``s`` comes from the document counts of the other
    folds and is 0 where none of them has it.
    """

    packed: PackedTerms
    weights: DataFrame
    widths: list[int]
    norm: str | None

    @staticmethod
    def fit(df: DataFrame, folds: int, text: str, norm: str | None = "l2", lowercase: bool = False) -> TfidfFolds:
        """``df`` has row_id, fold, label_ix and the text."""
        packed = PackedTerms.of(df, text, lowercase, ("fold", "label_ix"), folds)
        sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}  # one row per fold
        total = F.aggregate("dfs", F.lit(0).cast("bigint"), lambda a, b: a + b)
        counts = packed.totals(folds).withColumn("df", total)
        others = [F.col("df") - F.get("dfs", F.lit(f)) for f in range(folds)]
        n_train = [sum(sizes.values()) - sizes.get(f, 0) for f in range(folds)]
        weights = F.array(*[F.when(o > 0, idf(F.lit(n), o)).otherwise(F.lit(0.0)) for o, n in zip(others, n_train)])
        vocab = numbered(counts.select("term", "df", weights.alias("idfs")), "feature")  # in no order: steps share the numbers, not ranks
        seen = vocab.agg(*[F.count_if(F.get("idfs", F.lit(f)) > 0).alias(str(f)) for f in range(folds)]).first()
        found = frequent_join(packed.terms.select("chunk", "at", "term", "dfs"), vocab, "term", "df").drop("term")
        return TfidfFolds(packed, cut_lineage(found), [seen[str(f)] for f in range(folds)], norm)  # the weights serve both sides

    def _entries(self, test: bool, names: list[str], kinds: dict[str, str]) -> DataFrame:
        """Entries of every chunk with their values at all steps, or at the step that tests the row."""
        steps, own = len(self.widths), self.norm if self.packed.unique else None

        def build(rows: pa.Table, found: pa.Table) -> pa.Table:
            row, ix, tf = flat(rows)
            at = numbers(found, "at")
            slot = np.full(max(int(ix.max(initial=-1)), int(at.max(initial=-1))) + 1, -1)
            slot[at] = np.arange(len(at))
            there = slot[ix] >= 0
            row, tf, slot = row[there], tf[there], slot[ix[there]]
            idfs = found.column("idfs").combine_chunks().flatten().to_numpy().reshape(len(found), steps)
            if test:
                value = tf * idfs[slot, numbers(rows, "fold")[row]]
                row, slot, value = row[value > 0], slot[value > 0], value[value > 0]
                value = pa.array(scaled(value, row, len(rows), own))
            else:
                value = scaled(tf[:, None] * idfs[slot], row, len(rows), own)
                value = pa.ListArray.from_arrays(pa.array(np.arange(len(value) + 1, dtype=np.int32) * steps), pa.array(value.ravel()))
            kept = {c: rows.column(c).take(pa.array(row)) for c in ("row_id", "fold", "label_ix")}
            return pa.table(kept | {"feature": pa.array(numbers(found, "feature")[slot]), names[-1]: value}).select(names)

        return self.packed.entries(self.weights, build, ", ".join(f"`{c}` {kinds.get(c) or self.packed.kind(c)}" for c in names))

    @property
    def own_rows(self) -> bool:
        """Rows are normed where they are: sums and scores need no entry outside its chunk."""
        return self.norm is None or self.packed.unique

    def sums(self, n_classes: int) -> DataFrame:
        """(label_ix, feature, s0.., w0..): a chunk's values by class and term, added up for every step that trains on them, and
        the rows with the term that the step tests."""
        steps, own = len(self.widths), self.norm

        def build(rows: pa.Table, found: pa.Table) -> pa.Table:
            row, ix, tf = flat(rows)
            at = numbers(found, "at")
            slot = np.full(max(int(ix.max(initial=-1)), int(at.max(initial=-1))) + 1, -1)
            slot[at] = np.arange(len(at))
            there = slot[ix] >= 0
            row, tf, slot = row[there], tf[there], slot[ix[there]]
            idfs = found.column("idfs").combine_chunks().flatten().to_numpy().reshape(len(found), steps)
            fold = numbers(rows, "fold")[row]
            cell, place = np.unique(slot.astype(np.int64) * n_classes + numbers(rows, "label_ix")[row], return_inverse=True)
            parts = {"label_ix": pa.array((cell % n_classes).astype(np.int32)), "feature": pa.array(numbers(found, "feature")[cell // n_classes])}
            for s in range(steps):
                value = np.where(fold == s, 0.0, scaled(tf * idfs[slot, s], row, len(rows), own))
                parts[f"s{s}"] = pa.array(np.bincount(place, weights=value, minlength=len(cell)).astype(np.float64))
                parts[f"w{s}"] = pa.array(np.bincount(place[fold == s], minlength=len(cell)).astype(np.int64))
            return pa.table(parts).select(names)

        names = ["label_ix", "feature", *[f"s{s}" for s in range(steps)], *[f"w{s}" for s in range(steps)]]
        kinds = ["int", "long", *["double"] * steps, *["long"] * steps]
        weights = self.weights.select("chunk", "at", "feature", "idfs")
        return self.packed.entries(weights, build, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))

    def scores(self, table: DataFrame, n_classes: int) -> DataFrame:
        """(row_id, size, l0..) of every row with a feature of the step that tests it (see ``bayes.fold_scores``); of a chunk's
        terms only those of its own steps meet ``table``."""
        own = self.norm
        held = self.weights.select("chunk", "at", "feature", "idfs", F.posexplode("dfs").alias("step", "_own")).filter("_own > 0")
        held = held.select("chunk", "at", "feature", "step", F.get("idfs", F.col("step")).alias("idf")).filter("idf > 0")
        found = frequent_join(held, table.drop(*[f"w{s}" for s in range(len(self.widths))]), "feature", "n")
        sums = [step_sum(F.col("step"), c, len(self.widths)).alias(f"s{c}") for c in range(n_classes)]

        def build(rows: pa.Table, found: pa.Table) -> pa.Table:
            row, ix, tf = flat(rows)
            at = numbers(found, "at").astype(np.int64)
            size = max(int(ix.max(initial=-1)), int(at.max(initial=-1))) + 1
            at, place = at + size * numbers(found, "step"), ix + size * numbers(rows, "fold")[row].astype(np.int64)
            slot = np.full(int(max(place.max(initial=-1), at.max(initial=-1))) + 1, -1)
            slot[at] = np.arange(len(at))
            there = slot[place] >= 0
            row, tf, slot = row[there], tf[there], slot[place[there]]
            value = scaled(tf * numbers(found, "idf")[slot], row, len(rows), own)
            some = np.flatnonzero(np.bincount(row, minlength=len(rows)))
            add = lambda v: pa.array(np.bincount(row, weights=v, minlength=len(rows))[some])
            parts = {"row_id": rows.column("row_id").take(pa.array(some)), "size": add(value)}
            return pa.table(parts | {f"l{c}": add(value * np.log(numbers(found, f"s{c}") + SMOOTHING)[slot]) for c in range(n_classes)})

        shape = f"row_id {self.packed.kind('row_id')}, size double, " + ", ".join(f"l{c} double" for c in range(n_classes))
        return self.packed.entries(found.select("chunk", "at", "step", "idf", *sums), build, shape)

    def train(self) -> DataFrame:
        """(row_id, fold, label_ix, feature, values): a value per step, 0 where the step lacks the term."""
        found = self._entries(False, ["row_id", "fold", "label_ix", "feature", "values"], {"feature": "long", "values": "array<double>"})
        if self.norm is None or self.packed.unique:
            return found
        row, values = W.partitionBy("row_id"), [F.get("values", F.lit(s)) for s in range(len(self.widths))]
        sizes = [F.sum(v).over(row) if self.norm == "l1" else F.sqrt(F.sum(v * v).over(row)) for v in values]
        values = [F.when(n == 0, F.lit(0.0)).otherwise(v / n) for v, n in zip(values, sizes)]
        return found.select("row_id", "fold", "label_ix", "feature", F.array(*values).alias("values"))

    def test(self) -> DataFrame:
        """(row_id, fold, feature, value) by the weights of the step that tests the row."""
        found = self._entries(True, ["row_id", "fold", "feature", "value"], {"feature": "long", "value": "double"})
        return found if self.packed.unique else normalized(found, self.norm)


def hashed_features(
    df: DataFrame,
    text: str = "text",
    n_features: int = 100,
    non_negative: bool = False,
    norm: str | None = "l2",
    case_sensitive: bool = True,
    method: str = "xxhash64",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Term counts summed into ``n_features`` signed (or plain) buckets, inside the row: no count is shuffled."""
    check_hashing(n_features, norm)
    entries = hashed_counts(tokens(F.col(text), not case_sensitive), n_features, non_negative, norm, method)
    return spread_small(df.select("row_id", *keep, text)).select("row_id", *keep, F.inline(entries))


def check_hashing(n_features: int, norm: str | None) -> None:
    if n_features < 1:
        raise ValueError("n_features must be at least 1")
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {NORMS}")


def feature_names(vocab: DataFrame, attribute: str) -> DataFrame:
    """(feature_ix, attr, name) with ``attribute : term``."""
    return vocab.select(
        "feature_ix", F.lit(attribute).alias("attr"), F.format_string("%s : %s", F.lit(attribute), "term").alias("name")
    )
