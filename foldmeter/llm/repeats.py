"""Removal of long passages that an earlier document has too, found by recompression.

The words of every text are named by hashes; then rounds rename the symbols of all texts alike.  The first round replaces each
run of equal symbols by one symbol, and every round replaces pairs of a left and a right symbol (the side is a bit of the
name's hash) by one.  A name is a hash of what it replaces, so equal names mean equal words everywhere, and no table of names
is needed.  What a round does at a place depends only on the symbols next to it; each symbol carries the interval of words it
depends on, and equal passages give equal symbols wherever that interval lies inside.

A window that occurs in two documents therefore has only symbols that two documents share.  Symbols are grouped by name to
find the shared ones; windows with an unshared symbol inside are ruled out; the others (also those too repetitive to hold any
symbol) are verified by the hash of the whole window and the smallest document that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.text import beside, word_array
from foldmeter.llm.words import Words, mix, salted, signed, words
from foldmeter.session import broadcast_if_small, cut_lineage

ROUNDS = 7


def recompress(w: Words, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Final symbols of the texts of a chunk: text, name, and the words each depends on (from, to).

    An interval that reaches beyond its text marks a symbol that depends on where the text begins or ends.
    """
    name, doc = w.hash, w.doc
    lo = np.arange(len(name))
    hi = lo + 1
    for r in range(rounds):
        if len(name) == 0:
            break
        if r == 0:
            same = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
            first = np.flatnonzero(np.r_[True, ~same])
            last = np.r_[first[1:], len(name)] - 1
            # a run ends where its neighbours differ: it depends on them
            before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
            low = np.where((first > 0) & (doc[before] == doc[first]), lo[before], w.at[doc[first]] - 1)
            high = np.where((last < len(name) - 1) & (doc[after] == doc[last]), hi[after], w.at[doc[last] + 1] + 1)
            length = (last - first + 1).astype(np.uint64)
            name = np.where(length > 1, mix(name[first] + length * salted(r, 1)), name[first])
            doc, lo, hi = doc[first], low, high
        right = (mix(name + salted(r, 2)) >> np.uint64(63)).astype(bool)
        next_same = np.r_[doc[1:] == doc[:-1], False]
        starts = ~right & np.r_[right[1:], False] & next_same
        second = np.r_[False, starts[:-1]]
        following = np.r_[hi[1:], 0]
        preceding = np.r_[0, lo[:-1]]
        high = np.where(starts, np.maximum(hi, following), hi)
        alone = ~right & ~starts
        high = np.where(alone, np.where(next_same, np.maximum(hi, following), w.at[doc + 1] + 1), high)
        alone = right & ~second
        low = np.where(alone, np.where(np.r_[False, next_same[:-1]], np.minimum(lo, preceding), w.at[doc] - 1), lo)
        low = np.where(starts, np.minimum(lo, np.r_[lo[1:], 0]), low)
        pair = mix(name * np.uint64(0x9E3779B97F4A7C15) + np.r_[name[1:], name[:1]] + salted(r, 3))
        kept = ~second
        name, doc, lo, hi = np.where(starts, pair, name)[kept], doc[kept], low[kept], high[kept]
    return doc, name, lo, hi


def _fitting(w: Words, window: int, rounds: int):
    doc, name, lo, hi = recompress(w, rounds)
    fits = (lo >= w.at[doc]) & (hi <= w.at[doc + 1]) & (hi - lo <= window)
    return doc[fits], name[fits], lo[fits], hi[fits]


def _holding(n: int, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """For each word whether the window that starts there holds one of the intervals."""
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(hi - window, 0), 1)
    np.add.at(edge, lo + 1, -1)
    return np.cumsum(edge[: n + 1])[:n] > 0


def _sketch(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text")):
                n = len(w.at) - 1
                doc, name, lo, hi = _fitting(w, window, rounds)
                held = np.zeros(len(w.hash), bool)
                held[:] = _holding(len(w.hash), lo, hi, window)
                pos, _ = w.windows(window)
                bare = np.zeros(n, bool)
                bare[np.unique(w.doc[pos[~held[pos]]])] = True
                ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))].astype(np.int32)
                ab = signed(w.whole())
                yield pa.record_batch(
                    [
                        batch.column("id").slice(w.first, n),
                        batch.column("mark").slice(w.first, n),
                        pa.array(np.diff(w.at), pa.int64()),
                        pa.array(np.ascontiguousarray(ab[:, 0])),
                        pa.array(np.ascontiguousarray(ab[:, 1])),
                        pa.array(bare),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(name))),
                    ],
                    ["id", "mark", "n", "a", "b", "bare", "names"],
                )

    return run


def _windows(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column("shared").fill_null(pa.scalar([], pa.list_(pa.int64())))
            at, names = np.asarray(shared.offsets), np.asarray(shared.values).view(np.uint64)
            row = np.asarray(batch.column("row"))
            order = np.asarray(batch.column("id"))
            for w in words(batch.column("text")):
                doc, name, lo, hi = _fitting(w, window, rounds)
                ends = np.searchsorted(doc, np.arange(len(w.at)))
                unshared = np.ones(len(name), bool)
                for i in range(len(w.at) - 1):
                    own = slice(ends[i], ends[i + 1])
                    unshared[own] = ~np.isin(name[own], names[at[w.first + i] : at[w.first + i + 1]])
                blocked = _holding(len(w.hash), lo[unshared], hi[unshared], window)
                pos, value = w.windows(window)
                open_ = ~blocked[pos]
                pos, value = pos[open_], value[open_]
                of = w.doc[pos]
                yield pa.record_batch(
                    [
                        pa.array(row[w.first + of]),
                        pa.array(order[w.first + of]),
                        pa.array((pos - w.at[of]).astype(np.int32)),
                        pa.array(signed(value)),
                    ],
                    ["row", "id", "pos", "value"],
                )

    return run


def runs_of(window: int):
    """Sorted, joined [from, to) pairs of the words that windows at the given places cover."""

    def run(places: pd.Series) -> pd.Series:
        out = []
        for p in places:
            p = np.unique(np.asarray(p, np.int64))
            cut = np.flatnonzero(np.diff(p) > window)
            first, last = p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]] + window
            out.append(np.stack([first, last], axis=1).ravel().astype(np.int32))
        return pd.Series(out)

    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the words of ``_runs`` and the white space after each."""
    for batch in batches:
        runs = batch.column("_runs")
        texts = [None] * len(batch)
        for w in words(batch.column("text")):
            data = w.data.tobytes()
            begin = np.r_[w.start, len(data)]
            for i in range(len(w.at) - 1):
                first, last = w.at[i], w.at[i + 1]
                bounds = runs[w.first + i].as_py()
                out, kept_from, hi = [], int(w.byte_at[i]), int(w.byte_at[i + 1])
                for a, b in zip(bounds[::2], bounds[1::2]):
                    out.append(data[kept_from : int(begin[first + a])])
                    kept_from = hi if first + b >= last else int(begin[first + b])
                out.append(data[kept_from:hi])
                texts[w.first + i] = b"".join(out).decode()
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(
            [f.name for f in batch.schema if f.name != "_runs"]
        )


def _prepared(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    order = F.coalesce(F.col(id_column), F.lit((1 << 63) - 1)).cast("long")
    return docs.select(order.alias("id"), F.xxhash64(text_column).alias("mark"), F.col(text_column).alias("text"))


def repeated_words(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 50, rounds: int = ROUNDS
) -> DataFrame:
    """The words that a window shares with a document of smaller id: (id, mark, n, runs).

    ``mark`` is the text's hash, ``n`` its number of words, ``runs`` an array of word positions from, to, from, to, ...
    Only documents with such words are returned.  Ids are integers; null counts as larger than all others, and rows of equal
    id never count as earlier than each other.
    """
    source = _prepared(docs, id_column, text_column)
    sketch = source.mapInArrow(_sketch(window, rounds), "id long, mark long, n long, a long, b long, bare boolean, names array<long>")
    sketch = cut_lineage(sketch.filter(F.col("n") >= window).select(F.monotonically_increasing_id().alias("row"), "*"))

    # equal word sequences: all but those of the smallest id go as a whole and need no further work
    named = sketch.select("row", "id", "mark", "n", "a", "b")
    classes = cut_lineage(named.groupBy("a", "b").agg(F.min("id").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m"))
    copies = cut_lineage(named.join(broadcast_if_small(classes), ["a", "b"]).filter("id > least").select("row", "id", "mark", "n"))
    rest = sketch.join(broadcast_if_small(copies.select("row")), "row", "left_anti")

    entries = rest.select("row", "id", F.explode(F.array_distinct("names")).alias("name"))
    shared = entries.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("name")
    # tables that grow with the corpus: always joined by shuffling, so that the plan is the same at every size
    shared = cut_lineage(shared)
    known = cut_lineage(entries.select("row", "name").join(shared, "name").groupBy("row").agg(F.collect_list("name").alias("shared")))
    wanted = rest.select("row", "id", "mark", "bare").join(known, "row", "left")
    wanted = cut_lineage(wanted.filter("bare or shared is not null").drop("bare").dropDuplicates(["id", "mark"]))

    again = source.join(broadcast_if_small(wanted), ["id", "mark"]).select("row", "id", "text", "shared")
    found = cut_lineage(again.mapInArrow(_windows(window, rounds), "row long, id long, pos int, value long"))
    least = found.groupBy("value").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    least = cut_lineage(least.select("value", "least"))
    hits = found.join(least, "value").filter("id > least").select("row", "pos")
    covered = hits.groupBy("row").agg(F.collect_list("pos").alias("places"))
    to_runs = F.pandas_udf(runs_of(window), "array<int>")
    partly = covered.select("row", to_runs("places").alias("runs")).join(named.select("row", "id", "mark", "n"), "row")
    wholly = copies.dropDuplicates(["id", "mark"]).select("id", "mark", "n", F.array(F.lit(0), F.col("n").cast("int")).alias("runs"))
    return cut_lineage(partly.select("id", "mark", "n", "runs").unionByName(wholly))


def removed_words(runs: Column) -> Column:
    odd = F.filter(runs, lambda x, i: i % 2 == 1)
    even = F.filter(runs, lambda x, i: i % 2 == 0)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return total(odd) - total(even)


def substring_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 50, rounds: int = ROUNDS
) -> DataFrame:
    """``docs`` without the words that :func:`repeated_words` finds, and with two more columns, n_words and n_removed.

    A removed word takes the white space after it along; what stays is unchanged.  All rows come back, a wholly repeated text
    as an empty one.  Null and short texts are left alone.  Columns of ``docs`` named n_words or n_removed are replaced.
    """
    return beside(docs, [id_column, text_column], lambda d: _substring_dedup(d, id_column, text_column, window, rounds))


def _substring_dedup(
    docs: DataFrame, id_column: str, text_column: str, window: int, rounds: int
) -> DataFrame:
    found = repeated_words(docs, id_column, text_column, window, rounds)
    found = found.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("runs").alias("_runs"))
    order = F.coalesce(F.col(id_column), F.lit((1 << 63) - 1)).cast("long")
    docs = docs.drop("n_words", "n_removed").withColumns({"_id": order, "_mark": F.xxhash64(text_column)})
    columns = [c for c in docs.columns if c not in ("_id", "_mark")]
    count = F.size(word_array(F.col(text_column))).cast("long").alias("n_words")
    side = broadcast_if_small(found)
    same = docs.join(side, ["_id", "_mark"], "left_anti").select(*columns, count, F.lit(0).cast("long").alias("n_removed"))
    hit = docs.join(side, ["_id", "_mark"]).select(*columns, count, removed_words(F.col("_runs")).alias("n_removed"), "_runs")
    hit = hit.withColumnRenamed(text_column, "text")
    stripped = hit.mapInArrow(_strip, hit.drop("_runs").schema).withColumnRenamed("text", text_column)
    return same.unionByName(stripped)
