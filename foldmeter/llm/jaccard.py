"""Similarity join of word-shingle sets by universe partition.

Two sets whose Jaccard similarity reaches the bound differ in at most ``d`` tokens, where ``d`` follows from their size band.
Hashing every token of a band into ``d + 1`` segments leaves, by the pigeonhole principle, one segment in which the two sets
are equal.  A segment that is empty in both is equal too, but an index of empty segments would gather unrelated sets: it costs
much and tells nothing.  Such a segment gets no key of its own; its share of the allowance goes to the next segment, which is
then indexed with its one-deletion neighbourhood.  Two sets that are empty in segments E have, without two neighbours both in
E, ``d + 1 - |E|`` segments looked up exactly, |E| of them also within one deletion, which again is more than ``d`` in all;
with two neighbours both in E they share the key of an empty segment that follows an empty one.  So no pair is lost.

Keys go once, packed, to buckets that find the shared ones (``buckets.py``).  Sets that share a key meet at the smallest set of
that key (its leader).  Most sets only share a common passage there, so the
sets of a leader are first compared by the parities of their hashed tokens, a few bits for each token: no fewer tokens differ
than bits do, which rules pairs out without ever losing one.  Only sets that have a possible partner send their tokens.  These
are compared in blocks of bounded size, exactly; a pair that meets under several leaders counts under the smallest.  A block
pair returns link counts and a spanning forest, never its links, so a large group of near copies stays linear in rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.buckets import PACKED, buckets_of, packed, unpacked
from foldmeter.llm.graph import components
from foldmeter.llm.words import Words, mix, salted, signed, words
from foldmeter.session import broadcast_if_small, cut_lineage, shuffle_width

#: Tokens of one block; two blocks are compared at a time.
BLOCK_TOKENS = 40_000
#: Sets of one block, and how much larger blocks of parities may be.
BLOCK_SETS, PARITY_BLOCKS = 2_000, 8
#: Bytes of a row and of a key that are sent to the key's bucket; six bytes and the bucket tell keys apart well enough, as
#: sets that meet by chance are compared like all others.
ENTRY = [8, 6]


class Bands:
    """Size bands: sets of similarity ``num / den`` or more lie in the same or in neighbouring bands."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.parts = [1], []

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Lowest sizes, and the number of segments for pairs whose smaller set is of the band."""
        while self.low[-1] <= size:
            low = self.low[-1]
            high = max(low, low * self.den // self.num)
            differ = (self.den - self.num) * (high + high * self.den // self.num) // (self.den + self.num)
            self.parts.append(differ + 1)
            self.low.append(high + 1)
        return np.array(self.low), np.array(self.parts)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles, text after text, and where each text begins; a text of fewer words is one shingle."""
    pos, grams = w.windows(k)
    at = np.searchsorted(pos, w.at)
    whole, short = None, np.diff(w.at)
    out = []
    for i in range(len(at) - 1):
        if 0 < short[i] < k:
            whole = w.whole()[:, 0] if whole is None else whole
            out.append(whole[i : i + 1])
        else:
            x = np.sort(grams[at[i] : at[i + 1]])
            out.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x)
    sizes = np.array([len(x) for x in out])
    return (np.concatenate(out) if out else grams[:0]), np.r_[0, np.cumsum(sizes)]


def set_hashes(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two hashes for each set (n, 2)."""
    out = []
    for salt in (3, 4):
        c = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens + salted(salt)), out=c[1:])
        out.append(mix(c[at[1:]] - c[at[:-1]] + np.diff(at).astype(np.uint64)))
    return np.stack(out, axis=1)


def parities(tokens: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each set a bitmap of at least two bits a token: whether an odd number of tokens is hashed to the bit."""
    sizes = np.diff(at)
    bits = np.left_shift(1, np.maximum(8, np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64)))
    base = np.r_[0, np.cumsum(bits)]
    place = (mix(tokens + salted(6)) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(base[:-1], sizes) + place, minlength=base[-1]) & 1
    data = np.packbits(odd.astype(np.uint8))
    offsets = (base // 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def keys(tokens: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of all sets of a chunk and the set of each key."""
    sizes = np.diff(at)
    low, parts = bands.upto(int(sizes.max(initial=0)) + 1)
    band = np.searchsorted(low, sizes, side="right") - 1
    value = mix(tokens)
    found, owners = [], []
    for back in (0, 1):
        mine = (sizes > 0) & (band >= back)
        if back:  # only a set that is not too large for the band before
            mine &= (sizes * bands.num + bands.den - 1) // bands.den < low[band]
        group = np.where(mine, band - back, 0)
        m = np.where(mine, parts[group], 0)
        base = np.r_[0, np.cumsum(m)]
        of = np.repeat(np.arange(len(sizes)), sizes)
        chosen = mine[of]
        own, v = of[chosen], value[chosen]
        seg = ((v >> np.uint64(33)) * m[own].astype(np.uint64) >> np.uint64(31)).astype(np.int64)
        flat = base[own] + seg
        filled = np.bincount(flat, minlength=base[-1])
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, flat, mix(v))
        owner = np.repeat(np.arange(len(sizes)), m)
        index = np.arange(base[-1]) - base[owner]
        place = mix((group[owner].astype(np.uint64) << np.uint64(32)) + index.astype(np.uint64))
        full = filled > 0
        found.append(mix(content + place)[full])
        owners.append(owner[full])
        # the segment after an empty one: exactly, and with each token left out
        empty = np.flatnonzero(~full)
        if len(empty):
            after = base[owner[empty]] + (index[empty] + 1) % m[owner[empty]]
            tag = mix(place[empty] + salted(5))
            found.append(mix(content[after] + tag))
            owners.append(owner[empty])
            order = np.argsort(flat, kind="stable")
            first = np.r_[0, np.cumsum(filled)]
            reps = filled[after]
            which = np.repeat(first[after] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
            found.append(mix(np.repeat(content[after], reps) - mix(v[order[which]]) + np.repeat(tag, reps)))
            owners.append(np.repeat(owner[empty], reps))
    return np.concatenate(found), np.concatenate(owners)


def _sketch(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            for w in words(batch.column("text"), fold=True):
                tokens, at = shingles(w, k)
                n = len(at) - 1
                ab = signed(set_hashes(tokens, at))
                key, owner = keys(tokens, at, bands)
                order = np.argsort(owner, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column("id").slice(w.first, n),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(np.ascontiguousarray(ab[:, 0])),
                        pa.array(np.ascontiguousarray(ab[:, 1])),
                        parities(tokens, at),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(key[order]))),
                        pa.array(np.diff(ends), pa.int32()),
                    ],
                    ["id", "n", "a", "b", "odd", "keys", "m"],
                )

    return run


def _entries(buckets: int):
    """The keys of sets with their rows, packed by the buckets of the keys."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            ends = np.asarray(batch.column("keys").offsets)
            key = np.asarray(batch.column("keys").values)[ends[0] : ends[-1]]
            row = np.repeat(np.asarray(batch.column("row")), np.diff(ends))
            yield [row.view(np.uint64), np.ascontiguousarray(key).view(np.uint64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(parts(batches), 1, ENTRY, buckets)

    return run


def _met(table: pa.Table) -> pa.Table:
    """(node, leader): the sets that share a key of the bucket with another, and the smallest set of that key."""
    row, key = unpacked(table, ENTRY)
    if not len(row):
        return pa.table({"node": pa.array([], pa.int64()), "leader": pa.array([], pa.int64())})
    order = np.argsort(key)
    row, key = row[order].view(np.int64), key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    leader, last = np.minimum.reduceat(row, first), np.maximum.reduceat(row, first)
    size = np.diff(np.r_[first, len(row)])
    shared = np.repeat(leader < last, size)
    node, leader = row[shared], np.repeat(leader, size)[shared]
    order = np.lexsort((leader, node))
    node, leader = node[order], leader[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (leader[1:] != leader[:-1])
    return pa.table({"node": pa.array(node[new]), "leader": pa.array(leader[new])})


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text"), fold=True):
                tokens, at = shingles(w, k)
                n = len(at) - 1
                ab = signed(set_hashes(tokens, at))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(tokens)))
                yield pa.record_batch(
                    [
                        batch.column("id").slice(w.first, n),
                        pa.array(np.ascontiguousarray(ab[:, 0])),
                        pa.array(np.ascontiguousarray(ab[:, 1])),
                        lists,
                    ],
                    ["id", "a", "b", "tokens"],
                )

    return run


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A parity bitmap as one of ``width`` bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)


def _possible(num: int, den: int):
    """The sets of two blocks that sizes and parities leave a partner."""
    reach = 1 << int(np.ceil(np.log2(den / num)))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        side, n = block["side"].to_numpy(), block["n"].to_numpy()
        bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in block["odd"]]
        widths = np.array([len(x) for x in bits])
        across = block["i"].iloc[0] != block["j"].iloc[0]
        alive = np.zeros(len(n), bool)
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            other = np.flatnonzero((widths >= width) & (widths <= reach * width))
            x = np.stack([bits[p] for p in own]).astype(np.float32)
            y = np.stack([_folded(bits[p], width) for p in other]).astype(np.float32)
            differ = x.sum(1)[:, None] + y.sum(1)[None, :] - 2 * (x @ y.T)
            a, b = n[own][:, None], n[other][None, :]
            fits = (differ * (den + num) <= (den - num) * (a + b)) & (den * np.minimum(a, b) >= num * np.maximum(a, b))
            fits &= own[:, None] != other[None, :]
            if across:
                fits &= side[own][:, None] != side[other][None, :]
            alive[own] |= fits.any(1)
            alive[other] |= fits.any(0)
        return block.loc[alive, ["node", "leader"]]

    return run


def _in_blocks(members: DataFrame, tokens: int) -> DataFrame:
    """``members`` (node, leader, n, ...), each row once for every pair of blocks (i, j) of its leader that its own is in."""
    share = F.greatest(F.sum("n") / tokens, F.count("*") / BLOCK_SETS)
    blocks = cut_lineage(members.groupBy("leader").agg(F.ceil(share).cast("int").alias("blocks")))
    placed = members.join(broadcast_if_small(blocks), "leader")
    placed = placed.withColumn("side", F.pmod(F.xxhash64("node", "leader"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("blocks", "other")


def overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    common = times > 1
    new = np.cumsum(common) - 1
    kept = common[column]
    row, col = of[kept], new[column[kept]]
    total = np.zeros((len(lists), len(lists)), np.float32)
    width = max(1, (16 << 20) // max(1, len(lists)))  # columns at a time: 64 MB
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for begin in range(0, int(common.sum()), width):
        i, j = np.searchsorted(col, [begin, begin + width])
        table = np.zeros((len(lists), min(width, int(common.sum()) - begin)), np.float32)
        table[row[i:j], col[i:j] - begin] = 1
        total += table @ table.T
    return total.astype(np.int64)


def _verify(num: int, den: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        node, side, copies = block["node"].to_numpy(), block["side"].to_numpy(), block["copies"].to_numpy()
        lists = block["tokens"].tolist()
        size, leader = np.array([len(x) for x in lists]), block["leader"].iloc[0]
        both = overlaps(lists)
        alike = den * both >= num * (size[:, None] + size[None, :] - both)
        if block["i"].iloc[0] != block["j"].iloc[0]:
            alike &= side[:, None] != side[None, :]
        x, y = np.nonzero(np.triu(alike, 1))
        leaders = [set(v) for v in block["leaders"]]
        several = np.array([len(v) > 1 for v in leaders])
        mine = np.ones(len(x), bool)
        for p in np.flatnonzero(several[x] & several[y]):
            mine[p] = min(leaders[x[p]] & leaders[y[p]]) == leader
        x, y = x[mine], y[mine]
        weight = np.bincount(x, copies[y], len(node)) + np.bincount(y, copies[x], len(node))
        top = np.arange(len(node))
        for p, q in zip(x.tolist(), y.tolist()):
            while top[p] != p:
                top[p] = p = top[top[p]]
            while top[q] != q:
                top[q] = q = top[top[q]]
            top[max(p, q)] = min(p, q)
        for p in range(len(top)):
            top[p] = top[top[p]]
        order = np.lexsort((node, top))
        joined = top[order][1:] == top[order][:-1]
        u, v = node[order][:-1][joined], node[order][1:][joined]
        linked = weight > 0
        return pd.DataFrame(
            {
                "u": np.r_[node[linked], u],
                "v": pd.array(np.r_[node[linked], v], "int64"),
                "links": np.r_[weight[linked].astype(np.int64), np.zeros(len(u), np.int64)],
            }
        )

    return run


def ngram_jaccard(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    k: int = 5,
    num: int = 80,
    den: int = 100,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, n_links.

    Sets of k-word shingles (A-Z lower-cased) link when ``den * intersection >= num * union``.  component_id is the smallest id
    that links lead to, n_links the number of other rows linked directly, equal texts included.  A text without words, or null,
    has no shingles, links to nothing and is its own component; one of fewer than k words is a single shingle.  Rows that
    repeat an id stay separate rows (equal texts link them); a null id is never a component id unless the whole component has
    none.  Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    sketch = source.mapInArrow(_sketch(k, num, den), f"id {kind}, n long, a long, b long, odd binary, keys array<long>, m int")
    sketch = cut_lineage(sketch.select(F.monotonically_increasing_id().alias("row"), "*"))

    named = sketch.filter("n > 0").select("row", "id", "n", "a", "b")
    classes = named.groupBy("a", "b").agg(
        F.min("row").alias("node"), F.min("id").alias("class_id"), F.count("*").alias("copies"), F.max("n").alias("n")
    )
    classes = cut_lineage(classes)
    copies = named.select("row", "a", "b").join(classes.select("a", "b", "node"), ["a", "b"]).filter("row <> node").select("row")
    first = sketch.filter("n > 0").select("row", "keys").join(broadcast_if_small(cut_lineage(copies)), "row", "left_anti")
    buckets = buckets_of(sketch.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0], shuffle_width(spark))
    entries = first.select("row", "keys").mapInArrow(_entries(buckets), PACKED)
    members = cut_lineage(entries.groupBy("bucket").applyInArrow(_met, "node long, leader long").distinct())

    sizes = classes.select("node", "n", "copies", "class_id", "a", "b")
    marks = sketch.select(F.col("row").alias("node"), "n", "odd")
    pairs = _in_blocks(cut_lineage(members.join(marks, "node")), PARITY_BLOCKS * block_tokens)
    members = pairs.groupBy("leader", "i", "j").applyInPandas(_possible(num, den), "node long, leader long")
    members = cut_lineage(members.distinct())

    leaders = members.groupBy("node").agg(F.sort_array(F.collect_list("leader")).alias("leaders"))
    wanted = cut_lineage(leaders.join(sizes, "node"))
    # equal texts under one id stand for their class together; only they need to be made one
    twins = named.groupBy("id", "a", "b").agg(F.count("*").alias("m")).filter("m > 1").select("a", "b").distinct()
    match = wanted.select("a", "b", "class_id", "node").join(cut_lineage(twins).withColumn("twin", F.lit(True)), ["a", "b"], "left")
    match = broadcast_if_small(cut_lineage(match))
    again = source.mapInArrow(_sets(k), f"id {kind}, a long, b long, tokens array<long>")
    sets = again.join(match, ["a", "b"]).filter(F.col("id").eqNullSafe(F.col("class_id")))
    sets = cut_lineage(sets.select("node", "tokens", "twin"))
    twice = sets.filter("twin").dropDuplicates(["node"])
    sets = sets.filter("twin is null").unionByName(twice).drop("twin")
    sent = _in_blocks(cut_lineage(members.join(sizes.select("node", "n"), "node")), block_tokens)
    sent = sent.drop("n").join(wanted.select("node", "copies", "leaders"), "node").join(sets, "node")
    checked = cut_lineage(sent.groupBy("leader", "i", "j").applyInPandas(_verify(num, den), "u long, v long, links long"))

    degrees = checked.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(checked.filter("u <> v"))
    labelled = classes.join(roots, "node", "left").join(degrees, "node", "left")
    labelled = cut_lineage(labelled.withColumn("root", F.coalesce("root", "node")))
    lowest = labelled.groupBy("root").agg(F.min("class_id").alias("component_id"))
    grouped = labelled.join(cut_lineage(lowest), "root").select(
        "a", "b", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    rows = sketch.select("id", "n", "a", "b").join(cut_lineage(grouped), ["a", "b"], "left")
    return rows.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
