"""Quality rules: how often lines recur across the documents of a host, on top of counts inside each document.

Everything is a column expression, a grouping or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.text import BLANK, beside, word_array
from foldmeter.session import broadcast_if_small, cut_lineage

SYMBOLS = r"[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))


def line_key(line: Column) -> Column:
    """Hash of a line in lower case with single spaces."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), BLANK, " ")))


def window_hashes(k: int) -> Column:
    """Hashes of all k-word windows of ``_words``; null where there are fewer words."""
    starts = F.sequence(F.lit(1), F.size("_words") - (k - 1))
    return F.when(F.size("_words") >= k, F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, k))))


def repeated_places(windows: Column) -> tuple[Column, Column]:
    """Entries ordered with their index, and from that column ``_ordered`` the sorted indexes of those that occur twice."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get("_ordered", i - 1), F.get("_ordered", i + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    return ordered, F.array_sort(F.transform(F.filter("_ordered", twice), lambda x: x["i"]))


def base_counts(docs: DataFrame, text_column: str = "text", k: int = 8) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long), and helper columns ``_*``.

    Windows inside a document are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered, places = repeated_places(F.col("_windows"))
    steps = F.transform(F.col("_places"), lambda p, i: F.least(F.lit(k), F.coalesce(F.get("_places", i + 1) - p, F.lit(k))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        docs.withColumns({"_words": word_array(F.col(text_column)), "_lines": lines_with_words(text)})
        .withColumn("_windows", window_hashes(k))
        .withColumn("_ordered", F.when(some, ordered))
        .withColumn("_places", places)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            }
        )
        .drop("_windows", "_ordered", "_places")
    )


def frequent_lines(docs: DataFrame, host: str, text_column: str, min_docs: int, share: float) -> DataFrame:
    """(host, line): lines of more than ``min_docs`` and ``share`` of the host's different documents.

    Documents of equal text count once, so a line is not frequent only because its document was copied.
    """
    keys = F.array_distinct(F.transform(lines_with_words(F.col(text_column)), line_key))
    texts = docs.select(F.col(host).alias("host"), F.xxhash64(text_column).alias("mark"), keys.alias("keys"))
    total = texts.select("host", "mark").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    seen = texts.select("host", "mark", F.explode_outer("keys").alias("line")).filter("line is not null").distinct()
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    total, counts = cut_lineage(total), cut_lineage(counts)
    both = counts.join(broadcast_if_small(total.withColumnRenamed("host", "_host")), F.col("host").eqNullSafe(F.col("_host")))
    return both.filter(F.col("n") > share * F.col("docs")).select("host", "line")


def line_frequency_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    min_docs: int = 20,
    share: float = 0.10,
    least_left: float = 0.30,
    min_words: int = 20,
    most_repeated: int = 30,
) -> DataFrame:
    """``docs`` without the lines that are frequent in their host, judged.

    Added columns (same names are replaced): n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text,
    n_words_left after removal, base_failed (too few words, or too many in repeated windows) and kept: false if base_failed or
    if less than ``least_left`` of the words are left.  Null and empty texts have no words and fail; a null host is a host.
    Every row comes back, repeated rows too.
    """
    return beside(docs, [id_column, text_column, host_column], lambda d: _line_frequency_rules(d, id_column, text_column, host_column, min_docs, share, least_left, min_words, most_repeated))


def _line_frequency_rules(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    host_column: str,
    min_docs: int,
    share: float,
    least_left: float,
    min_words: int,
    most_repeated: int,
) -> DataFrame:
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_left", "base_failed", "kept"]
    docs = docs.drop(*made)
    bad = cut_lineage(frequent_lines(docs, host_column, text_column, min_docs, share))
    counted = base_counts(docs, text_column).withColumn("_mark", F.xxhash64(text_column))
    keys = F.array_distinct(F.transform(lines_with_words(F.col(text_column)), line_key))
    marks = docs.select(F.col(host_column).alias("_host"), F.xxhash64(text_column).alias("_mark"), F.explode_outer(keys).alias("line")).filter("line is not null")
    hit = marks.join(broadcast_if_small(bad), F.col("_host").eqNullSafe(F.col("host")) & (marks["line"] == bad["line"]))
    # one row for each host and text, however often it is copied
    hit = hit.groupBy("_host", "_mark").agg(F.collect_set(marks["line"]).alias("_bad"))
    hit = cut_lineage(hit).withColumnRenamed("_mark", "_hit")
    joined = counted.join(
        broadcast_if_small(hit), (F.col("_mark") == F.col("_hit")) & F.col(host_column).eqNullSafe(F.col("_host")), "left"
    )
    left = F.array_join(
        F.filter(F.split(text_column, "\n"), lambda x: ~F.array_contains("_bad", line_key(x)) | ~x.rlike(HAS_WORD)), "\n"
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return (
        joined.withColumn(text_column, F.when(F.col("_bad").isNull(), F.col(text_column)).otherwise(left))
        .withColumn("n_words_left", F.when(F.col("_bad").isNull(), F.col("n_words")).otherwise(F.size(word_array(F.col(text_column)))).cast("long"))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (F.col("n_words_left") >= least_left * F.col("n_words")))
        .select(*docs.columns, *made)
    )
