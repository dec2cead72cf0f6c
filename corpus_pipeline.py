"""From raw documents to a training mix in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmeter.llm.decontaminate import decontaminate
from foldmeter.llm.jaccard import ngram_jaccard
from foldmeter.llm.mix import mix_sources
from foldmeter.llm.repeats import substring_dedup
from foldmeter.llm.rules import line_frequency_rules
from foldmeter.llm.text import word_array
from foldmeter.session import broadcast_if_small, cut_lineage, drop_scratch, recorded_scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def columns_of_documents(docs: DataFrame) -> DataFrame:
    """Texts may have changed: count their characters anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def with_words(docs: DataFrame) -> DataFrame:
    return docs.filter(F.size(word_array(F.col("text"))) > 0)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines of a source go; so do documents that fail the base rules or have little left."""
    # written first: a filter pushed below the counts would evaluate them again for every word
    return columns_of_documents(cut_lineage(line_frequency_rules(docs)).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of 5-word-shingle similarity 0.8 or more the document with the smallest id stays."""
    found = cut_lineage(ngram_jaccard(docs).filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(broadcast_if_small(found), "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of smaller id has too go; documents without words left go."""
    return columns_of_documents(with_words(cut_lineage(substring_dedup(docs))))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 10-word windows of the benchmark go; documents without words left go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return columns_of_documents(with_words(cut_lineage(decontaminate(docs, items))))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with the words taken of each, repeats counted."""
    return mix_sources(docs).filter("taken > 0")


#: Scratch tables of the stage before, by session: its result is written when the next stage begins.
_behind: dict[int, list[str]] = {}


def stage(work):
    """A stage that first drops the scratch tables of the one before, whose result has been written and is read again."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, _behind.pop(id(spark), []))
        with recorded_scratch() as made:
            out = work(spark, docs, sf_dir)
        _behind[id(spark)] = made
        return out

    return run_stage


STAGES = [
    ("quality rules", stage(quality_rules)),
    ("n-gram Jaccard join", stage(near_duplicates)),
    ("substring dedup", stage(repeated_passages)),
    ("benchmark decontamination", stage(benchmark_passages)),
    ("mixing sources to target weights", stage(source_mix)),
]
#: Similarity components and the seeded order of the mix are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
