"""Removal of byte strings that an earlier document has too, by run-compressed Burrows-Wheeler indexes of bounded blocks.

An index of a whole corpus has no owner on a cluster, so documents are cut by content first.  The anchor of a window is the
smallest hash of the short strings inside it: equal windows have equal anchors wherever they stand, and neighbouring windows
of one anchor form a segment.  Only segments of one anchor can share a window.  Hashes of all segments go once, packed, to
buckets of anchors (``buckets.py``), which settle equal segments.  Anchors with different segments of two documents or more are
dealt into blocks; there the segments of an anchor meet in the block's index (``runindex.py``): the earlier ones are indexed, the
later ones streamed over it, and matches of a window's length are marked.  An anchor with more than ``VARIANTS`` different
segments is spread further, by the windows themselves.  Copies of a whole text are settled before by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.buckets import PACKED, buckets_of, packed, unpacked
from foldmeter.llm.repeats import _prepared, removed_words
from foldmeter.llm.runindex import earlier_matches
from foldmeter.llm.words import _BYTES, _VALUE, mix, signed, spans, text_bytes
from foldmeter.session import BROADCAST_BYTES, broadcast_if_small, cut_lineage, shuffle_width

#: Bytes of the strings that anchors are chosen from.  Longer ones give more anchors, but fewer that unrelated texts share.
GRAM = 24
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Windows of a segment at most: a longer one, as periodic texts have, is cut from its start on.
LONGEST = 64
#: Different segments of one anchor that one block takes; the windows of the others are compared one by one.
VARIANTS = 32
#: Bytes of the rows that one block indexes and streams, about.
BLOCK = 4 << 20
#: Bytes of a segment's id, mark, anchor, value and place that are sent.  Anchors that agree in the bucket and in five bytes are
#: treated as one, which only makes a block compare more; values decide and are sent whole.
ENTRY = [8, 8, 5, 8, 5]
#: A place is a position times this, plus the number of windows after the first.
PLACE = 2 * LONGEST


class Chunk:
    """Windows of the texts of one chunk: where they start, their anchors, and hashes of any byte range."""

    def __init__(self, first: int, data: np.ndarray, at: np.ndarray, window: int, anchors: bool):
        self.first, self.at, n = first, at, len(data)
        up, self.down = _BYTES.of(n + 1)
        self.data = data
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[:n], out=self.sums[1:])
        if not anchors:
            return
        end = np.repeat(at[1:], np.diff(at))
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(n)
        low = np.full(n, LAST)
        own = np.flatnonzero(place + GRAM <= end)
        low[own] = self.range_hash(own, own + GRAM)
        width, have = window - GRAM + 1, 1
        while have < width:  # minima of ever longer stretches
            step = min(have, width - have)
            np.minimum(low[:-step], low[step:], out=low[:-step])
            have += step
        self.pos = np.flatnonzero(place + window <= end)
        self.anchor = low[self.pos]

    def range_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last index (in pos) of the neighbouring windows of one anchor."""
        if not len(self.pos):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = (np.diff(self.pos) != 1) | (self.anchor[1:] != self.anchor[:-1]) | (np.diff(self.doc[self.pos]) != 0)
        first = np.r_[0, np.flatnonzero(new) + 1]
        size = np.diff(np.r_[first, len(self.pos)])
        parts = -(-size // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + nth * LONGEST
        return first, np.r_[first[1:], len(self.pos)] - 1


def chunks(column: pa.Array, window: int, anchors: bool = True) -> Iterator[Chunk]:
    data, at = text_bytes(column)
    for i, j in spans(at):
        yield Chunk(i, data[at[i] : at[j]], at[i : j + 1] - at[i], window, anchors)


def _segments(window: int, buckets: int):
    """All segments with their ids, packed by the buckets of their anchors."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            ids, marks = (np.asarray(batch.column(c)).view(np.uint64) for c in ("id", "mark"))
            for c in chunks(batch.column("text"), window):
                first, last = c.segments()
                doc = c.doc[c.pos[first]]
                value = c.range_hash(c.pos[first], c.pos[last] + window) + (last - first).astype(np.uint64)
                place = (c.pos[first] - c.at[doc]) * PLACE + last - first
                # low minima are not evenly spread
                yield [ids[c.first + doc], marks[c.first + doc], mix(c.anchor[first]), value, place.view(np.uint64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(parts(batches), 2, ENTRY, buckets)

    return run


def _settled(table: pa.Table) -> pa.Table:
    """The bucket's segments of anchors that two documents have: those that an earlier document has as well with m = 0, and of
    each of several different ones of an anchor the earliest, with their number m."""
    own, mark, anchor, value, place = unpacked(table, ENTRY)
    own = own.view(np.int64)
    order = np.argsort(anchor)
    first = np.flatnonzero(np.diff(anchor[order], prepend=~anchor[order[:1]]))
    if len(first):
        ids = own[order]
        shared = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        order = order[np.repeat(shared, np.diff(np.r_[first, len(order)]))]
    own, mark, anchor, value, place = (c[order] for c in (own, mark, anchor, value, place))
    order = np.lexsort((own, value, anchor))
    own, mark, anchor, value, place = (c[order] for c in (own, mark, anchor, value, place))
    opens = np.ones(len(own), bool)
    opens[1:] = anchor[1:] != anchor[:-1]
    new = opens.copy()
    new[1:] |= value[1:] != value[:-1]
    nth = np.cumsum(new)
    least = own[new][nth - 1]
    several = np.add.reduceat(new, np.flatnonzero(opens), dtype=np.int64) if len(own) else np.zeros(0, np.int64)
    m = np.where(own > least, 0, several[np.cumsum(opens) - 1])
    kept = m != 1
    name = anchor[kept].view(np.int64) | np.int64(table.column("bucket")[0].as_py() << 40)
    pos, n = (x.astype(np.int32) for x in np.divmod(place[kept].view(np.int64), PLACE))
    columns = {"id": own[kept], "mark": mark[kept].view(np.int64), "anchor": name, "pos": pos, "n": n + 1, "m": m[kept].astype(np.int32)}
    return pa.table({k: pa.array(v) for k, v in columns.items()})


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, lengths = batch.column("places"), batch.column("lengths")
            ends = np.asarray(places.offsets)
            begin, length = np.asarray(places.values).astype(np.int64), np.asarray(lengths.values).astype(np.int64)
            for c in chunks(batch.column("text"), window, anchors=False):
                n = len(c.at) - 1
                e = ends[c.first : c.first + n + 1]
                doc = np.repeat(np.arange(n), np.diff(e))
                lo, k = begin[e[0] : e[-1]] + c.at[doc], length[e[0] : e[-1]]
                pos = np.repeat(lo - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
                doc = np.repeat(doc, k)
                of = pa.array(c.first + doc)
                yield pa.record_batch(
                    [
                        batch.column("id").take(of),
                        batch.column("mark").take(of),
                        pa.array((pos - c.at[doc]).astype(np.int32)),
                        pa.array(signed(c.range_hash(pos, pos + window))),
                    ],
                    ["id", "mark", "pos", "value"],
                )

    return run


def _strings(window: int):
    """The bytes of chosen segments, equal ones of a row once with all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ends = batch.column("places"), np.asarray(batch.column("places").offsets)
            begin, length = np.asarray(places.values).astype(np.int64), np.asarray(batch.column("lengths").values).astype(np.int64)
            anchor = np.asarray(batch.column("anchors").values)
            for c in chunks(batch.column("text"), window, anchors=False):
                n = len(c.at) - 1
                e = ends[c.first : c.first + n + 1]
                own = slice(e[0], e[-1])
                doc = np.repeat(np.arange(n), np.diff(e))
                lo, size, name = begin[own] + c.at[doc], length[own] + window - 1, anchor[own]
                value = c.range_hash(lo, lo + size)
                order = np.lexsort((lo, size, value, name, doc))
                doc, lo, size, name, value = (x[order] for x in (doc, lo, size, name, value))
                new = np.ones(len(lo), bool)
                new[1:] = np.any([x[1:] != x[:-1] for x in (doc, size, name, value)], axis=0)
                first = np.flatnonzero(new)
                edge = np.r_[first, len(lo)]
                for i in range(0, len(first), 1 << 18):  # a piece stays far below 2 GB
                    f, upto = first[i : i + (1 << 18)], edge[i : i + (1 << 18) + 1]
                    k = size[f]
                    at = np.r_[0, np.cumsum(k)]
                    cut = c.data[np.repeat(lo[f] - at[:-1], k) + np.arange(at[-1])]
                    where = (lo - c.at[doc])[upto[0] : upto[-1]].astype(np.int32)
                    of = pa.array(c.first + doc[f])
                    yield pa.record_batch(
                        [
                            pa.array(name[f]),
                            batch.column("id").take(of),
                            batch.column("mark").take(of),
                            pa.ListArray.from_arrays(pa.array((upto - upto[0]).astype(np.int32)), pa.array(where)),
                            pa.BinaryArray.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(cut)]),
                        ],
                        ["anchor", "id", "mark", "places", "bytes"],
                    )

    return run


def _block(table: pa.Table, window: int) -> pa.RecordBatch:
    """(id, mark, pos, n) of windows of the block's segments that an earlier document has, the rows ordered by anchor and id."""
    anchor, ids = np.asarray(table["anchor"].combine_chunks()), np.asarray(table["id"].combine_chunks())
    data, at = text_bytes(table["bytes"].combine_chunks(), pa.large_binary())
    places = table["places"].combine_chunks()
    opens = np.ones(len(anchor), bool)
    opens[1:] = anchor[1:] != anchor[:-1]
    rises = opens.copy()
    rises[1:] |= ids[1:] != ids[:-1]
    nth = np.cumsum(rises)
    rank = nth - np.repeat(nth[opens], np.diff(np.r_[np.flatnonzero(opens), len(anchor)]))
    s, p = earlier_matches(anchor, rank, data, at[:-1], np.diff(at), window)
    order = np.lexsort((p, s))
    s, p = s[order], p[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (p[1:] > p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(s)] - 1
    s, lo, n = s[first], p[first], p[last] - p[first] + 1
    ends, values = np.asarray(places.offsets).astype(np.int64), np.asarray(places.values).astype(np.int64)
    many = np.diff(ends)[s]
    of = np.repeat(np.arange(len(s)), many)
    which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    pos = values[ends[s[of]] + which] + lo[of]
    rows = pa.array(s[of])
    return pa.record_batch(
        [
            table["id"].combine_chunks().take(rows),
            table["mark"].combine_chunks().take(rows),
            pa.array(pos.astype(np.int32)),
            pa.array(n[of].astype(np.int32)),
        ],
        ["id", "mark", "pos", "n"],
    )


def _blocks(window: int):
    """Blocks of about ``BLOCK`` bytes from rows ordered by anchor; an anchor is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = np.asarray(table["anchor"].combine_chunks())
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    yield _block(table.slice(0, cut), window)
                held = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if sum(b.num_rows for b in held):
            yield _block(pa.Table.from_batches(held), window)

    return run


def _joined(window: int):
    def run(places: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for p, n in zip(places, lengths):
            p, n = np.asarray(p, np.int64), np.asarray(n, np.int64)
            order = np.argsort(p, kind="stable")
            lo, hi = p[order], np.maximum.accumulate((p + n - 1 + window)[order])
            cut = np.flatnonzero(lo[1:] > hi[:-1])
            out.append(np.stack([lo[np.r_[0, cut + 1]], hi[np.r_[cut, len(lo) - 1]]], axis=1).ravel().astype(np.int32))
        return pd.Series(out)

    return run


def repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 50) -> DataFrame:
    """(id, mark, runs): byte ranges from, to, ... of each text that windows shared with a smaller id cover.

    Ids are integers, null the largest; texts are UTF-8, null is empty; rows of equal id are never earlier than each other.
    """
    source = _prepared(docs, id_column, text_column).filter(F.octet_length("text") >= window)
    named = cut_lineage(source.select("id", "mark", F.xxhash64(F.lit(1), "text").alias("other"), F.octet_length("text").alias("size")).distinct())
    least = named.groupBy("mark", "other").agg(F.min("id").alias("least"), F.count("*").alias("m")).filter("m > 1")
    copies = cut_lineage(named.join(cut_lineage(least.drop("m")), ["mark", "other"]).filter("id > least").select("id", "mark", "size"))
    rest = source.join(broadcast_if_small(copies.select("id", "mark")), ["id", "mark"], "left_anti")

    expected = int(named.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) * 2 // (window - GRAM + 2)
    buckets = buckets_of(expected, shuffle_width(docs.sparkSession))
    segments = rest.select("id", "mark", "text").mapInArrow(_segments(window, buckets), PACKED)
    schema = "id long, mark long, anchor long, pos int, n int, m int"
    judged = cut_lineage(segments.groupBy("bucket").applyInArrow(_settled, schema))
    whole = judged.filter("m = 0").select("id", "mark", "pos", "n")
    open_ = judged.filter("m > 0")

    def with_texts(part: DataFrame) -> DataFrame:
        chosen = part.groupBy("id", "mark").agg(F.collect_list(F.struct("pos", "n", "anchor")).alias("s"))
        chosen = cut_lineage(chosen.select("id", "mark", F.col("s.pos").alias("places"), F.col("s.n").alias("lengths"), F.col("s.anchor").alias("anchors")))
        side = broadcast_if_small(chosen, size=3 * BROADCAST_BYTES)  # a place takes 16 bytes in these arrays, not 48
        return rest.join(side, ["id", "mark"]).select("id", "mark", "text", "places", "lengths", "anchors")

    strings = with_texts(open_.filter(F.col("m") <= VARIANTS)).mapInArrow(
        _strings(window), "anchor long, id long, mark long, places array<int>, bytes binary"
    )
    blocks = strings.repartition("anchor").sortWithinPartitions("anchor", "id")
    part = cut_lineage(blocks.mapInArrow(_blocks(window), "id long, mark long, pos int, n int"))
    crowded = with_texts(open_.filter(F.col("m") > VARIANTS))
    found = cut_lineage(crowded.mapInArrow(_windows(window), "id long, mark long, pos int, value long"))
    first = found.groupBy("value").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    spread = found.join(cut_lineage(first.select("value", "least")), "value").filter("id > least")
    hits = whole.unionByName(part).unionByName(spread.select("id", "mark", "pos", F.lit(1).alias("n")))
    hits = hits.groupBy("id", "mark").agg(F.collect_list(F.struct("pos", "n")).alias("s"))
    join_up = F.pandas_udf(_joined(window), "array<int>")
    runs = hits.select("id", "mark", join_up("s.pos", "s.n").alias("runs"))
    wholly = copies.distinct().select("id", "mark", F.array(F.lit(0), F.col("size").cast("int")).alias("runs"))
    return cut_lineage(runs.unionByName(wholly))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist()):
            raw = text.as_py().encode()
            edges = [0, *runs, len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield batch.append_column("kept", pa.array(kept, pa.binary())).drop_columns(["text"])


def byte_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 50) -> DataFrame:
    """Every row of ``docs``: id, n_bytes, n_removed, n_spans, and ``kept``, the remaining bytes (they may cut a character)."""
    order = F.coalesce(F.col(id_column), F.lit((1 << 63) - 1)).cast("long")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column), order.alias("id"), F.xxhash64(text_column).alias("mark"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    side = broadcast_if_small(repeated_bytes(docs, id_column, text_column, window))
    none = F.lit(0).cast("long")
    same = rows.join(side, ["id", "mark"], "left_anti")
    same = same.select(id_column, "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    hit = rows.join(side, ["id", "mark"]).select(
        id_column, "n_bytes", removed_words(F.col("runs")).alias("n_removed"), (F.size("runs") / 2).cast("long").alias("n_spans"), "runs", "text"
    )
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, runs array<int>, kept binary"
    return same.unionByName(hit.mapInArrow(_strip, schema).drop("runs"))
