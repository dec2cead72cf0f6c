"""Benchmark decontamination: word windows of benchmark items, looked up in every window of the training texts.

Everything is a column expression, a grouping or a join.  The benchmark's windows are broadcast as a hash table, in blocks of
bounded size; training texts are not shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.text import beside, fold_ascii
from foldmeter.session import broadcast_if_small, cut_lineage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Benchmark windows broadcast at a time.
BLOCK = 500_000


def plain_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and characters beyond ASCII; null has none."""
    parts = F.split(fold_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def item_windows(items: DataFrame, item_column: str, text_column: str, k: int) -> DataFrame:
    """(item, length, key, gram): all k-word windows of the items; a shorter item is one window, one without words none."""
    words = items.select(F.col(item_column).cast("string").alias("item"), plain_words(F.col(text_column)).alias("words"))
    words = words.withColumn("length", F.least(F.size("words"), F.lit(k))).filter("length > 0")
    starts = words.select("item", "words", "length", F.explode_outer(F.sequence(F.lit(1), F.expr("size(words) - length + 1"))).alias("at"))
    gram = F.slice("words", F.col("at"), F.col("length"))
    return starts.select("item", "length", window_key(gram).alias("key"), F.array_join(gram, " ").alias("gram")).distinct()


def window_key(words: Column) -> Column:
    return F.xxhash64(words)


def _window_at(length: int):
    return lambda i: window_key(F.slice("words", i, length))


def contaminated_windows(docs: DataFrame, grams: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, mark, n_words, at, length, key, gram): each place of each window, and one row at 0 for every text.

    A window is found by its hash and verified by its words.
    """
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most as many as a window has words
    blocks = max(1, -(-grams.count() // BLOCK))
    words = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text_column).alias("mark"), plain_words(F.col(text_column)).alias("words")
    )
    words = words.withColumn("n_words", F.size("words").cast("long"))
    found = []
    for length in lengths or [1]:
        starts = F.sequence(F.lit(1), F.size("words") - (length - 1))
        keys = F.transform(starts, _window_at(length))
        none = F.array(F.lit(None).cast("long"))
        own = words.withColumn("keys", F.when(F.size("words") >= length, F.concat(none, keys)).otherwise(none))
        # the outer form: the inner one would evaluate the keys once more, as a filter
        placed = own.select("id", "mark", "n_words", "words", F.posexplode_outer("keys").alias("at", "key"))
        for block in range(blocks):
            chosen = grams.filter((F.col("length") == length) & (F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block))
            side = F.broadcast(chosen.select(F.col("key").alias("item_key"), "gram"))
            hit = placed.join(side, F.col("key") == F.col("item_key"), "left")
            first = length == lengths[0] and block == 0 if lengths else True
            right = F.array_join(F.slice("words", F.col("at"), length), " ") == F.col("gram")
            keep = (F.col("gram").isNotNull() & right) | ((F.col("at") == 0) if first else F.lit(False))
            found.append(hit.filter(keep).select("id", "mark", "n_words", "at", F.lit(length).alias("length"), "key", "gram"))
    return reduce(DataFrame.unionByName, found)


def covered(spans: Column) -> Column:
    """Runs [from, to) of word positions that the sorted (at, length) structs cover, joined where they touch."""
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def add(acc: Column, x: Column) -> Column:
        a, b = (x["at"] - 1).cast("int"), (x["at"] - 1 + x["length"]).cast("int")
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], b).alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= a), grown).otherwise(
            F.concat(acc, F.array(F.struct(a.alias("a"), b.alias("b"))))
        )

    return F.aggregate(spans, empty, add)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    k: int = 10,
) -> DataFrame:
    """(id, mark, n_words, n_hit, runs, items): words inside benchmark windows, and the items found, sorted as strings.

    One row for each different (id, text); ``mark`` is the text's hash.  Null and empty texts have no words; items without
    words are never found, items of null id are found but not listed.
    """
    windows = cut_lineage(item_windows(items, item_column, item_text, k))
    grams = cut_lineage(windows.select("length", "key", "gram").distinct())
    found = cut_lineage(contaminated_windows(docs, grams, id_column, text_column))
    texts = found.filter("at = 0").groupBy("id", "mark").agg(F.max("n_words").alias("n_words"))
    hits = found.filter("at > 0")
    spans = hits.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("at", "length"))).alias("spans"))
    spans = spans.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), covered(F.col("spans")).alias("runs"))
    own = hits.select("id", "mark", "length", "key", "gram").distinct()
    named = own.join(broadcast_if_small(windows), ["length", "key", "gram"]).select("id", "mark", "item").distinct()
    named = named.groupBy("id", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select(F.col("id").alias("_id2"), F.col("mark").alias("_mark2"), "items")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["b"] - r["a"])
    return (
        texts.join(cut_lineage(spans), F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
        .join(cut_lineage(named), F.col("id").eqNullSafe(F.col("_id2")) & (F.col("mark") == F.col("_mark2")), "left")
        .select(
            "id", "mark", "n_words",
            F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
            "runs",
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", drop_documents: bool = False, k: int = 10
) -> DataFrame:
    """``docs`` without contaminated spans (a word and what stands behind it up to the next), or without the documents.

    A text that is contaminated as a whole becomes empty.  All other columns stay.
    """
    return beside(docs, [id_column, text_column], lambda d: _decontaminate(d, items, id_column, text_column, drop_documents, k))


def _decontaminate(
    docs: DataFrame, items: DataFrame, id_column: str, text_column: str, drop_documents: bool, k: int
) -> DataFrame:
    found = contamination(docs, items, id_column, text_column, k=k).filter("n_hit > 0")
    found = cut_lineage(found.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("runs").alias("_runs")))
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (F.xxhash64(text_column) == F.col("_mark"))
    side = broadcast_if_small(found)
    clean = docs.join(side, same, "left_anti")
    if drop_documents:
        return clean
    hit = docs.join(side, same).withColumns(
        {"_words": F.regexp_extract_all(text_column, F.lit(f"({WORD})")), "_gaps": F.split(text_column, WORD)}
    )
    kept = F.transform(
        "_words",
        lambda w, i: F.when(F.exists("_runs", lambda r: (r["a"] <= i) & (i < r["b"])), F.lit("")).otherwise(F.concat(w, F.get("_gaps", i + 1))),
    )
    stripped = hit.withColumn(text_column, F.concat(F.get("_gaps", F.lit(0)), F.array_join(kept, "")))
    return clean.unionByName(stripped.select(*docs.columns))
