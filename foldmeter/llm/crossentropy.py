"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Both are bigram models over one vocabulary with the same smoothing, the target counted on the documents marked as such, the
background on all.  Every word and every bigram of the corpus is in the models.

Words with at least ``least_share`` of all tokens and, of the bigrams of two words with at least ``HEAVY_SHARE``, those with
``least_share`` are broadcast, at most ``1 / least_share`` of each; their tokens are scored in place.  All other bigrams are
sent once, with the row they are from, to buckets in which they are counted and scored together; the bucket of a bigram with
a rare word is that of the word, where its counts lie.  A bucket gives one sum per document; these come back packed by blocks
of documents.  No key of a bucket holds ``HEAVY_SHARE`` of the tokens, buckets hold about ``BUCKET_TOKENS`` at every size, and
where the borders lie changes no score.  Buckets and blocks follow the corpus, not the number of partitions: every bucket packs
one row for each bucket or block it has something for, so small inputs are not cut finer than ``LEAST_TOKENS`` and ``LEAST_ROWS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.words import Words, mix, signed, words
from foldmeter.session import broadcast_if_small, cut_lineage, shuffle_width

LEAST_SHARE = 1e-6
HEAVY_SHARE = 1e-4
BUCKET_TOKENS, LEAST_TOKENS = 2_000_000, 200_000
BLOCK_ROWS, LEAST_ROWS = 100_000, 2_000
KEPT = 0.7  # weight of the bigram's own estimate
START = -1  # predecessor of a text's first word

#: What a packed row holds: bigrams (a, b, row, mark); bigrams of two rare words, under the first one; the same under the
#: second one, with the counts of the first; counts of rare words (code, n, t); sums of gains (row, bits of the sum).  ``mark``
#: is the number of times, doubled, plus 1 in target documents.
TEXT, PAIRS, BOTH, HALF, RARE, SUMS = range(6)
WIDTH = {PAIRS: 4, BOTH: 4, HALF: 6, RARE: 3, SUMS: 2}
PACKED = "kind int, bucket int, n int, packed binary"
PACKED_AT = 1 << 19  # entries held before they are packed
SUMMED_AT = 1 << 18  # entries unpacked and added up at a time


def _codes(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A word's index in the sorted table of frequent words, else its hash as a number below ``START``."""
    rare = np.minimum(hashes | np.int64(-1 << 63), START - 1)
    if len(vocabulary) == 0:
        return rare
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, rare)


def _pairs(w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: the code of its predecessor and its own."""
    codes = _codes(vocabulary, signed(w.hash))
    before = np.full(len(codes), START, np.int64)
    before[1:] = codes[:-1]
    before[w.at[:-1][w.at[:-1] < len(codes)]] = START
    return before, codes


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys``, the first one leading, and where in it each group begins (one more entry at the end)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    return order, np.r_[np.flatnonzero(new), len(order)]


def _counter(shared):
    """Counts as (key, n, t), n in all and t in target documents: of words, or of bigrams if given the heavy words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = np.asarray(batch.column("target").cast(pa.int8()))
            for w in words(batch.column("text"), fold=True):
                if shared is None:
                    key, of = signed(w.hash), w.doc
                else:
                    vocabulary, heavy = shared.value
                    a, b = _pairs(w, vocabulary)
                    inner = np.flatnonzero((a >= 0) & (b >= 0))
                    inner = inner[heavy[a[inner]] & heavy[b[inner]]]
                    key, of = a[inner] << 32 | b[inner], w.doc[inner]
                order, at = _grouped(key)
                mine = np.r_[0, np.cumsum(chosen[w.first + of][order] > 0)]
                yield pa.record_batch(
                    {
                        "key": pa.array(key[order[at[:-1]]]),
                        "n": pa.array(np.diff(at).astype(np.int64)),
                        "t": pa.array(np.diff(mine[at]).astype(np.int64)),
                    }
                )

    return run


def _collected(df: DataFrame) -> list[np.ndarray]:
    """The columns, ordered by the first."""
    got = df.toArrow()
    columns = [np.asarray(got.column(c).combine_chunks()) for c in df.columns]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def _pieces(size: int, most: int, least: int, tasks: int) -> int:
    """Pieces for ``tasks``, none of fewer than ``least``; more of them where they would hold over ``most``."""
    return max(1, min(tasks, -(-size // least)), -(-size // most))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(np.ascontiguousarray(key).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _packed(kind: int, by: np.ndarray, columns: list[np.ndarray], buckets: int) -> list[tuple]:
    """Rows (kind, bucket, n, packed), one for every bucket of ``by``: the columns in order, the first one as differences."""
    bucket = _bucket(by, buckets)
    order = np.lexsort((columns[1], columns[0], bucket))
    bucket, columns = bucket[order], [np.asarray(c, np.int64)[order] for c in columns]
    at = np.r_[np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)]
    rows = []
    for i, j in zip(at[:-1], at[1:]):
        whole = np.stack([np.diff(columns[0][i:j], prepend=0), *(c[i:j] for c in columns[1:])])
        # bytes of one rank together: most of the high ones are alike
        planes = np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8).T)
        rows.append((kind, int(bucket[i]), int(j - i), pa.compress(planes, codec="zstd", asbytes=True)))
    return rows


def _unpacked(table: pa.Table | pa.RecordBatch, kind: int) -> np.ndarray:
    """All columns (width, n) of the packed rows of one kind."""
    width, parts = WIDTH[kind], [np.zeros((WIDTH[kind], 0), np.int64)]
    for k, n, data in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "packed"))):
        if k == kind:
            planes = np.frombuffer(pa.decompress(data, 8 * width * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1)
            whole = np.ascontiguousarray(planes.T).view(np.int64).reshape(width, n)
            whole[0] = np.cumsum(whole[0])
            parts.append(whole)
    return np.concatenate(parts, axis=1)


def _batch(rows: list[tuple]) -> dict[str, pa.Array]:
    kind, bucket, n, data = zip(*rows) if rows else ((), (), (), ())
    ints = {"kind": kind, "bucket": bucket, "n": n}
    return {c: pa.array(x, pa.int32()) for c, x in ints.items()} | {"packed": pa.array(data, pa.binary())}


def _rare_words(buckets: int):
    """Counts of rare words, (key, n, t), packed under their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, t = (np.asarray(batch.column(c)) for c in ("key", "n", "t"))
            if len(key):
                code = np.minimum(key | np.int64(-1 << 63), START - 1)
                yield pa.record_batch(_batch(_packed(RARE, code, [code, n, t], buckets)))

    return run


def _scorer(shared, buckets: int):
    """Per text a row (id, row, n_tokens, gain) with the gain of the tokens scored in place; the others' bigrams, packed."""

    def packed(held: dict[int, list[np.ndarray]]) -> list[tuple]:
        rows = []
        for kind, parts in held.items():
            if parts:
                a, b, row, mark = np.concatenate(parts, axis=1)
                frequent = np.where(a >= 0, a << 32 | b, b)
                by = a if kind == BOTH else np.where(b < START, b, np.where(a < START, a, frequent))
                rows += _packed(kind, by, [a, b, row, mark], buckets)
                parts.clear()
        pa.default_memory_pool().release_unused()
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, word_gain, pair_keys, pair_gain = shared.value
        held, size, kind_of_id = {PAIRS: [], BOTH: []}, 0, None

        def rest() -> pa.RecordBatch:
            out = _batch(packed(held))
            k = len(out["kind"])
            out |= {"id": pa.nulls(k, kind_of_id), "row": pa.nulls(k, pa.int64())}
            return pa.record_batch(out | {"n_tokens": pa.nulls(k, pa.int64()), "gain": pa.nulls(k, pa.float64())})

        for batch in batches:
            kind_of_id = batch.schema.field("id").type
            row_ids = np.asarray(batch.column("row"))
            chosen = np.asarray(batch.column("target").cast(pa.int8())).astype(np.int64)
            for w in words(batch.column("text"), fold=True):
                a, b = _pairs(w, vocabulary)
                gain, done = np.zeros(len(b)), np.zeros(len(b), bool)
                here = np.flatnonzero((a == START) & (b >= 0))
                gain[here], done[here] = word_gain[b[here]], True
                if len(pair_keys):
                    here = np.flatnonzero((a >= 0) & (b >= 0))
                    keys = a[here] << 32 | b[here]
                    at = np.minimum(np.searchsorted(pair_keys, keys), len(pair_keys) - 1)
                    hit = pair_keys[at] == keys
                    gain[here[hit]], done[here[hit]] = pair_gain[at[hit]], True
                total = np.r_[0.0, np.cumsum(gain)]
                of, a, b = w.doc[~done], a[~done], b[~done]
                order, at = _grouped(of, a, b)
                first = order[at[:-1]]
                of, a, b = of[first] + w.first, a[first], b[first]
                entries = np.stack([a, b, row_ids[of], np.diff(at) << 1 | chosen[of]])
                both = (a < START) & (b < START)
                held[BOTH].append(entries[:, both])
                held[PAIRS].append(entries[:, ~both])
                size += len(a)
                count = np.diff(w.at)
                k = len(count)
                yield pa.record_batch(
                    {
                        "kind": pa.array(np.full(k, TEXT, np.int32)),
                        "bucket": pa.nulls(k, pa.int32()),
                        "n": pa.nulls(k, pa.int32()),
                        "packed": pa.nulls(k, pa.binary()),
                        "id": batch.column("id").slice(w.first, k),
                        "row": batch.column("row").slice(w.first, k),
                        "n_tokens": pa.array(count, pa.int64()),
                        "gain": pa.array(total[w.at[1:]] - total[w.at[:-1]]),
                    }
                )
                if size >= PACKED_AT:
                    yield rest()
                    size = 0
        if size:
            yield rest()

    return run


def _rare_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the bucket's rare words in order, n and t; words of one code are one."""
    code, n, t = _unpacked(table, RARE)
    code, at = np.unique(code, return_inverse=True)
    return code, np.bincount(at, n, len(code)).astype(np.int64), np.bincount(at, t, len(code)).astype(np.int64)


def _half_counted(buckets: int):
    """Bigrams of two rare words get the counts of the first and go on to the bucket of the second."""

    def run(table: pa.Table) -> pa.Table:
        code, n, t = _rare_counts(table)
        a, b, row, mark = _unpacked(table, BOTH)
        if len(a) == 0:
            return pa.table(_batch([]))
        at = np.searchsorted(code, a)
        return pa.table(_batch(_packed(HALF, b, [a, b, row, mark, n[at], t[at]], buckets)))

    return run


def _bucket_gains(shared, size: int, all_n: int, all_t: int, blocks: int):
    """One sum per row of the gains of a bucket's bigrams, which are all there; packed by blocks of rows."""

    def share(c: np.ndarray, total: int) -> np.ndarray:
        return (c + 1) / (total + size)

    def run(table: pa.Table) -> pa.Table:
        frequent = shared.value
        code, *rare = _rare_counts(table)
        given = _unpacked(table, HALF)
        own = _unpacked(table, PAIRS)
        a, b, row, mark = np.concatenate([own, given[:4]], axis=1)
        first = np.concatenate([np.zeros((2, own.shape[1]), np.int64), given[4:]], axis=1)
        del own, given
        order, at = _grouped(a, b)
        if len(order) == 0:
            return pa.table(_batch([]))
        lead = order[at[:-1]]
        a, b, first, row, mark = a[lead], b[lead], first[:, lead], row[order], mark[order]
        del order
        times = mark >> 1
        n = np.add.reduceat(times, at[:-1])
        t = np.add.reduceat(times * (mark & 1), at[:-1])

        def counts(c: np.ndarray, i: int) -> np.ndarray:
            """Counts of the words ``c``: 0 for those that are neither frequent nor here."""
            out = np.zeros(len(c), np.int64)
            out[c >= 0] = frequent[i][c[c >= 0]]
            if len(code):
                k = np.minimum(np.searchsorted(code, c), len(code) - 1)
                out = np.where(code[k] == c, rare[i][k], out)
            return out

        p = []
        for i, (pair, total) in enumerate(((n, all_n), (t, all_t))):
            alone = share(counts(b, i), total)
            before = np.where((a < START) & (b < START), first[i], counts(a, i))
            p.append(np.where(a == START, alone, KEPT * pair / np.maximum(before, 1) + (1 - KEPT) * alone))
        gain = np.repeat(np.log(p[0] / p[1]), np.diff(at)) * times
        rows, at = np.unique(row, return_inverse=True)
        pa.default_memory_pool().release_unused()  # a worker is used again, and kept, by Spark
        return pa.table(_batch(_packed(SUMS, rows, [rows, np.bincount(at, gain, len(rows)).view(np.int64)], blocks)))

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, more): the sums over all buckets for the rows of a partition, which holds whole blocks; one entry a row is kept."""
    row, more = np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        upto = np.cumsum(np.asarray(batch.column("n"))) // SUMMED_AT
        for part in np.unique(upto):
            i, j = np.searchsorted(upto, [part, part + 1])
            rows, bits = _unpacked(batch.slice(i, j - i), SUMS)
            row, at = np.unique(np.r_[row, rows], return_inverse=True)
            more = np.bincount(at, np.r_[more, bits.view(np.float64)], len(row))
    yield pa.record_batch({"row": pa.array(row), "more": pa.array(more)})


def cross_entropy_difference(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """(id, n_tokens, score) for every row: mean loss difference of its tokens, below 0 if the target model predicts it better.

    ``target`` (id) names the target documents.  Words are cut at white space, A-Z lower-cased.  Null and empty texts have no
    tokens and a null score.  Repeated rows count and are scored one by one; without any target document both models differ
    only by their smoothing.  ``least_share`` only decides which words and bigrams are broadcast.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    marks = broadcast_if_small(cut_lineage(target.select(F.col("id").alias("_t")).filter("_t is not null").distinct()))
    marked = texts.join(marks, F.col("id") == F.col("_t"), "left").select("id", "text", F.col("_t").isNotNull().alias("target"))

    def totals(counter, least: float = 0) -> DataFrame:
        counted = marked.select("text", "target").mapInArrow(counter, "key long, n long, t long")
        return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(F.col("n") >= least)

    unigrams = cut_lineage(totals(_counter(None)))
    size, all_n, all_t = unigrams.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    least = max(2.0, least_share * all_n)  # at most 1 / least_share entries reach it
    vocabulary, n, t = _collected(unigrams.filter(F.col("n") >= least))
    heavy = spark.sparkContext.broadcast((vocabulary, n >= max(least, HEAVY_SHARE * all_n)))
    keys, pair_n, pair_t = _collected(totals(_counter(heavy), least))

    def share(c: np.ndarray, total: int) -> np.ndarray:
        return (c + 1) / (total + size)

    def loss(pair: np.ndarray, count: np.ndarray, total: int) -> np.ndarray:
        return KEPT * pair / np.maximum(count[keys >> 32], 1) + (1 - KEPT) * share(count[keys & 0xFFFFFFFF], total)

    pair_gain = np.log(loss(pair_n, n, all_n) / loss(pair_t, t, all_t))
    model = spark.sparkContext.broadcast((vocabulary, np.log(share(n, all_n) / share(t, all_t)), keys, pair_gain))
    buckets = _pieces(all_n, BUCKET_TOKENS, LEAST_TOKENS, 2 * shuffle_width(spark))

    schema = f"{PACKED}, id {kind}, row long, n_tokens long, gain double"
    rows = marked.withColumn("row", F.monotonically_increasing_id())
    scored = cut_lineage(rows.mapInArrow(_scorer(model, buckets), schema))
    packed = scored.select("kind", "bucket", "n", "packed")
    rare = unigrams.filter(F.col("n") < least).mapInArrow(_rare_words(buckets), PACKED)
    both = packed.filter(F.col("kind") == BOTH).unionByName(rare)
    half = both.groupBy("bucket").applyInArrow(_half_counted(buckets), PACKED)
    parts = packed.filter(F.col("kind") == PAIRS).unionByName(rare).unionByName(half)
    counts = spark.sparkContext.broadcast((n, t))
    texts_in = scored.filter(F.col("kind") == TEXT).select("row", "id", "n_tokens", "gain")
    blocks = _pieces(texts_in.count(), BLOCK_ROWS, LEAST_ROWS, 2 * shuffle_width(spark))
    gains = parts.groupBy("bucket").applyInArrow(_bucket_gains(counts, size, all_n, all_t, blocks), PACKED)
    sums = gains.repartition(blocks, "bucket").mapInArrow(_summed, "row long, more double")
    mean = F.when(F.col("n_tokens") > 0, (F.col("gain") + F.coalesce("more", F.lit(0.0))) / F.col("n_tokens"))
    out = texts_in.join(sums, "row", "left")
    return out.select(F.col("id").alias(id_column), "n_tokens", mean.alias("score"))
