"""One registered query for each operator, with production parameters, and its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmeter.llm.bytes import byte_dedup
from foldmeter.llm.crossentropy import cross_entropy_difference
from foldmeter.llm.decontaminate import contamination
from foldmeter.llm.importance import importance_resample
from foldmeter.llm.jaccard import ngram_jaccard
from foldmeter.llm.mix import mix_sources
from foldmeter.llm.neighbours import neighbour_quality
from foldmeter.llm.pagetext import main_text
from foldmeter.llm.periodic import periodic_runs
from foldmeter.llm.repeats import substring_dedup
from foldmeter.llm.rules import line_frequency_rules
from foldmeter.llm.text import word_array
from foldmeter.llm.urls import path_of, url_filter
from foldmeter.llm.warc import pages_through_archives

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity 0.9: component and number of links of every document."""
    return ngram_jaccard(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that a document of smaller id has too are removed."""
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    words = F.array_join(word_array(F.col("text")), " ")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(w) - 7)) AS p, w FROM d WHERE len(w) >= 8),
win2 AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 8], ' ') AS g FROM win),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win2) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - p, 8)))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nx FROM rep) GROUP BY 1),
ln AS (SELECT doc_id, source, text, unnest(l) AS raw FROM d),
ln2 AS (SELECT *, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
               len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS nw FROM ln),
host AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY 1),
freq AS (SELECT source, line, count(DISTINCT text) AS n FROM ln2 GROUP BY 1, 2),
bad AS (SELECT f.source, f.line FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source
        WHERE f.n > 20 AND f.n > 0.10::DOUBLE * h.docs),
gone AS (SELECT doc_id, sum(nw)::BIGINT AS n FROM ln2 JOIN bad ON ln2.line = bad.line AND ln2.source IS NOT DISTINCT FROM bad.source GROUP BY 1),
s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    (len(w) - coalesce(gone.n, 0))::BIGINT AS n_words_left
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words_left >= 0.30::DOUBLE * n_words) AS kept
FROM s
"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules, and rejection of documents that consist mostly of their source's frequent lines."""
    return line_frequency_rules(table(spark, sf_dir, "documents")).drop("text", "lang", "source", "n_chars")


OP3_SQL = r"""
WITH f AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM f),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[p + 1:p + k], ' ') AS g
      FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
win AS (SELECT doc_id, k, p, array_to_string(w[p + 1:p + k], ' ') AS g
        FROM (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT win.doc_id, p, win.k, item_id FROM win JOIN g ON win.k = g.k AND win.g = g.g),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside 10-word windows of benchmark items, and which items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1; 150 % of all words; nothing more than twice."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives of one gzip stream, normalised, read back record by record."""
    return pages_through_archives(table(spark, sf_dir, "pages")).drop("url", "payload")


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of quality 1."""
    target = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose crc32 of the id modulo 5 is 0 are held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    scored = neighbour_quality(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query("op4_url_filters")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document its url names by number: good if of quality 1 and not toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})", 1)
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null and quality is not null")
    labels = labels.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("label"))
    named = pages.withColumn("_doc", F.when(number != "", number).cast("long")).join(labels.withColumnRenamed("doc_id", "_doc"), "_doc", "left")
    return url_filter(named.drop("_doc"), RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document of smaller id has too are removed."""
    kept = byte_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the benchmark's word features."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


@query("op12_html_extraction")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page by its host's template."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the texts, chosen by the id, a part of the words repeats to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # only the chosen texts are cut into words
    w = F.when(h % 10 == 0, word_array(F.col("text"))).otherwise(F.array().cast("array<string>"))
    words = docs.select("doc_id", "text", w.alias("w"), h.alias("h"), F.floor(h / 10).alias("g"))
    n, g = F.size("w"), F.col("g")
    a = F.when(n > 0, g % n).otherwise(0).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    cycle = F.slice("w", a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), a), again), " ")
    return words.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words of every document, the longest one, and the words left when each run keeps one period."""
    found = periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, F.concat(r.period.cast("string"), F.lit("\n"))))
    return found.withColumn("top", longest).select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).cast("long").alias("start"),
        F.col("top.length").cast("long").alias("length"),
        (-F.col("top.period")).cast("long").alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
