"""Runs of periodic words, found per octave of the period in overlapping tiles and stitched.

A run is a stretch of words with smallest period q, at least ``max(6, 4q)`` words long, that neither neighbour extends.
Seen as places i where words i and i + q agree it is one interval of at least 3q places.

Tiles.  For the periods of one octave [Q, 2Q) any 4q neighbouring words fit in fewer than 8Q, so tiles of 16Q words that
overlap by half hold every such stretch whole.  A text is exploded into such tiles, one set per band of octaves; a text
of no more than one tile is a tile of its own and solved where it is read, tiles of longer ones are dealt out over the
cluster.

A tile.  Boundaries stand every Q/2 words.  The first boundary inside an interval is followed by at least 2.5Q places of
it, so it shows as two equal windows at distance q; equal window hashes only propose.  A proposal is settled by the words
themselves: the Z-function forward from the boundary and the one backward from it give, for all periods of the octave at
once, how far the words agree.  Of neighbouring boundaries proposed for one period only the first is settled: they share an
interval, which keeps texts of one repeated word linear.

Stitching.  Fragments are shuffled by (document, period); those that overlap or touch are one interval.  Of equal
stretches the smallest period stays, which is the smallest period of the words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldmeter.llm.words import Powers, mix
from foldmeter.session import broadcast_if_small, cut_lineage, shuffle_width

#: Words of the smallest tiles.
TILE_WORDS = 4096
#: Octaves in a band are those from one Q to 16 Q, so a text has few sets of tiles.
BAND = 16
#: Bytes of short texts worked on together, and pairs of windows compared at once.
CHUNK, PAIRS = 1 << 20, 1 << 18

_POWERS = Powers(np.uint64(0x9E3779B97F4A7C15))
FRAGMENTS = "array<struct<period:int,start:int,stop:int>>"
RUNS = "array<struct<start:int,length:int,period:int>>"


def least_places(q: int) -> int:
    """Agreeing places of a run of period q."""
    return max(6, 4 * q) - q


def z_function(x: list, n: int) -> list:
    """For the first ``n`` places how many items from there on equal those from the start."""
    size = len(x)
    z = [0] * min(n, size)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < size and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _around(x: list, b: int, q0: int, back: int) -> tuple[list, list]:
    """Per period of the octave of ``q0``: agreeing places from boundary ``b`` on, and, up to ``back``, before it."""
    ahead = z_function(x[b:], 2 * q0)
    ahead += [0] * (2 * q0 - len(ahead))
    head = x[b - back : b][::-1]
    stop = min(b + 2 * q0 - 1, len(x))
    tail = x[b - back : stop][::-1]
    z = z_function([*head, None, *tail], back + 1 + len(tail))
    # place b + q - 1 is item stop - b - q of the tail
    behind = [z[back + 1 + stop - b - q] if b + q <= stop else 0 for q in range(q0, 2 * q0)]
    return ahead[q0:], behind


def _proposals(hashes: np.ndarray, places: np.ndarray, room: np.ndarray, q0: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Boundaries and periods with equal windows; ``room`` is the largest period that stays inside the text."""
    q = np.arange(q0, 2 * q0)
    step = max(1, PAIRS // q0)
    for i in range(0, len(places), step):
        b = places[i : i + step]
        at = b[:, None] + q[None, :]
        same = (hashes[np.minimum(at, len(hashes) - 1)] == hashes[b][:, None]) & (q[None, :] <= room[i : i + step, None])
        r, c = np.nonzero(same)
        if len(r):
            yield b[r], q[c]


def solve(codes: np.ndarray, at: np.ndarray, lowest: int = 1, highest: int | None = None) -> list[tuple[int, int, int, int]]:
    """(text, period, first place, end of places) of all intervals inside single texts, or tiles, laid end to end.

    ``at`` holds where each text begins and the end; ``lowest`` and ``highest`` are the first and last Q.
    """
    n, sizes, out = len(codes), np.diff(at), []
    if n == 0:
        return out
    up, down = _POWERS.of(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=c[1:])
    q0 = lowest
    while (highest is None or q0 <= highest) and max(6, 4 * q0) <= sizes.max():
        step = max(1, q0 // 2)
        window = least_places(q0) - step + 1
        hashes = (c[window:] - c[:-window]) * down[: n + 1 - window]
        long = np.flatnonzero(sizes >= max(6, 4 * q0))
        counts = (sizes[long] - q0 - window) // step + 1
        text = np.repeat(long, counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = at[text] + nth * step
        room = at[text + 1] - places - window
        found = list(_proposals(hashes, places, room, q0))
        if found:
            b, q = (np.concatenate(x) for x in zip(*found))
            out += _settle(codes, at, b, q, q0, step)
        q0 *= 2
    return out


def _settle(codes: np.ndarray, at: np.ndarray, b: np.ndarray, q: np.ndarray, q0: int, step: int) -> list[tuple[int, int, int, int]]:
    """Exact intervals around the proposed boundaries."""
    order = np.lexsort((b, q))
    b, q = b[order], q[order]
    text = np.searchsorted(at, b, side="right") - 1
    # neighbouring boundaries proposed for one period lie in one interval: the first of them finds it
    first = np.ones(len(b), bool)
    first[1:] = (q[1:] != q[:-1]) | (text[1:] != text[:-1]) | (b[1:] != b[:-1] + step)
    b, q, text = b[first], q[first], text[first]
    order = np.argsort(b, kind="stable")
    b, q, text = b[order].tolist(), q[order].tolist(), text[order].tolist()
    out, i, of, x = [], 0, -1, []
    while i < len(b):
        t, start = text[i], int(at[text[i]])
        if t != of:
            of, x = t, codes[start : int(at[t + 1])].tolist()
        place, j = b[i] - start, i
        while j < len(b) and b[j] == b[i]:
            j += 1
        ahead, behind = _around(x, place, q0, min(step, place))
        for p in q[i:j]:
            a, z = place - behind[p - q0], place + ahead[p - q0]
            if z - a >= least_places(p):
                out.append((t, p, a, z))
        i = j
    return out


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], bytes]]:
    """Row, words and key of every text of a batch of (id, text); bytes.split cuts at space and bytes 9 to 13."""
    ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
    for i in range(len(batch)):
        text, own = texts[i].as_py(), ids[i].as_py()
        key = hashlib.sha256(b"%d\0%d\0%s\0" % (own is None, text is None, str(own).encode()) + (text or b"")).digest()
        yield i, (text or b"").split(), key


def _coded(texts: list[list[bytes]]) -> np.ndarray:
    """Equal numbers for equal words."""
    names = defaultdict(count().__next__)
    return np.fromiter(map(names.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))


def _scan_short(batches):
    """Whole texts as tiles of their own: key, id, words joined by one space, and fragments."""

    def flush(batch, rows):
        at = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int64)
        codes = _coded([r[1] for r in rows])
        fragments: list[list] = [[] for _ in rows]
        for t, p, start, stop in solve(codes, at):
            fragments[t].append({"period": p, "start": start, "stop": stop})
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array([r[0] for r in rows])),
                pa.array([r[2] for r in rows], pa.binary()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([b" ".join(r[1]) for r in rows], pa.binary()).cast(pa.string()),
                pa.array(fragments, pa.list_(pa.struct([("period", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))),
            ],
            names=["id", "key", "n_words", "text", "fragments"],
        )

    for batch in batches:
        rows, size = [], 0
        for row in _words(batch):
            rows.append(row)
            size += sum(map(len, row[1])) + 1
            if size >= CHUNK:
                yield flush(batch, rows)
                rows, size = [], 0
        if rows:
            yield flush(batch, rows)


def tiles_of(n: int, tile_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(first Q, last Q, start, end) of the tiles of a text of ``n`` words."""
    lowest, highest = 1, max(1, tile_words // 16)
    while max(6, 4 * lowest) <= n:
        size = 16 * highest
        for start in range(0, n, size // 2):
            yield lowest, highest, start, min(start + size, n)
            if start + size >= n:
                break
        lowest, highest = 2 * highest, BAND * highest


def _explode_long(tile_words: int):
    """One row for the text itself (lowest 0) and one for every tile, its words as 32-bit numbers."""

    def explode(batches):
        for batch in batches:
            for i, words, key in _words(batch):
                own = batch.column(0).slice(i, 1)
                yield _long_rows(own, key, 0, 0, 0, len(words), b" ".join(words).decode(), None)
                codes = _coded([words]).astype(np.int32)
                for lowest, highest, start, stop in tiles_of(len(words), tile_words):
                    yield _long_rows(own, key, lowest, highest, start, len(words), None, codes[start:stop].tobytes())

    return explode


def _long_rows(own, key, lowest, highest, start, n, text, codes):
    return pa.RecordBatch.from_arrays(
        [
            own,
            pa.array([key], pa.binary()),
            pa.array([lowest], pa.int32()),
            pa.array([highest], pa.int32()),
            pa.array([start], pa.int32()),
            pa.array([n], pa.int64()),
            pa.array([text], pa.string()),
            pa.array([codes], pa.binary()),
        ],
        names=["id", "key", "lowest", "highest", "start", "n_words", "text", "codes"],
    )


def _solve_tiles(batches):
    names = ["key", "period", "start", "stop"]
    for batch in batches:
        for row in batch.to_pylist():
            codes = np.frombuffer(row["codes"], np.int32).astype(np.int64)
            found = solve(codes, np.array([0, len(codes)]), row["lowest"], row["highest"])
            _, p, a, b = np.array(found, np.int32).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(p), pa.binary()), *map(pa.array, (p, a + row["start"], b + row["start"]))], names=names)


def stitch(fragments: DataFrame) -> DataFrame:
    """Runs per key, sorted by start and period, from (key, period, start, stop); repeated fragments count once."""
    by = W.partitionBy("key", "period").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    opened = fragments.distinct().withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    whole = opened.withColumn("part", F.sum("opens").over(by)).groupBy("key", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = whole.withColumn("length", F.col("stop") - F.col("start") + F.col("period")).filter("length >= greatest(6, 4 * period)")
    runs = runs.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    return runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))


def _collapse(batches):
    """Keep the first period of every run."""
    for batch in batches:
        kept = []
        for text, runs in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
            words = text.split()
            stays = np.ones(len(words), bool)
            for r in runs or ():
                stays[r["start"] + r["period"] : r["start"] + r["length"]] = False
            kept.append(b" ".join(words[i] for i in np.flatnonzero(stays)) if runs else text)
        yield batch.set_column(2, "text", pa.array(kept, pa.binary()).cast(pa.string()))


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tile_words: int = TILE_WORDS) -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``runs`` (start, length, period; sorted) and ``text`` without the repeats.

    Words are cut at space and bytes 9 to 13; ``text`` holds the kept ones joined by one space, a word being dropped where
    any run holds it after that run's first period.  Null, empty and blank texts have no words, no runs and an empty text.
    Repeated rows, also of null ids, are each returned; rows of one id with different texts are kept apart.  Other columns
    are ignored, whatever their names.  ``tile_words`` changes the work, never the result.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > 8 * tile_words, F.lit(False))
    scanned = rows.filter(~is_long).mapInArrow(_scan_short, f"id {kind}, key binary, n_words long, text string, fragments {FRAGMENTS}")
    # only rows with a fragment are written; the others are read again at the end, so no whole text is kept or shuffled
    marked = cut_lineage(scanned.filter(F.size("fragments") > 0))
    schema = f"id {kind}, key binary, lowest int, highest int, start int, n_words long, text string, codes binary"
    long = cut_lineage(rows.filter(is_long).mapInArrow(_explode_long(tile_words), schema))
    tiles = long.filter("lowest > 0").select("key", "lowest", "highest", "start", "codes")
    dealt = tiles.repartition(shuffle_width(docs.sparkSession), "key", "lowest", "start")
    pieces = dealt.mapInArrow(_solve_tiles, "key binary, period int, start int, stop int")
    own = marked.select("key", F.inline("fragments"))
    runs = cut_lineage(stitch(own.unionByName(pieces)))
    texts = marked.select("id", "n_words", "text", "key").unionByName(long.filter("lowest = 0").select("id", "n_words", "text", "key"))
    joined = texts.join(broadcast_if_small(runs), "key", "left").select("id", "n_words", "text", "runs")
    collapsed = joined.mapInArrow(_collapse, f"id {kind}, n_words long, text string, runs {RUNS}")
    clean = scanned.filter(F.size("fragments") == 0).select("id", "n_words", "text", F.array().cast(RUNS).alias("runs"))
    out = clean.unionByName(collapsed)
    return out.select(F.col("id").alias(id_column), "n_words", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), "text")
