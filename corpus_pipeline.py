"""A corpus pipeline of five stages; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a table with the columns of documents;
the last returns the coded corpus. Between stages tables are written as Parquet in the
session's shared folder and read again.

Defined cases, in every stage: a null or empty text has no words, so the base rules reject
it; null ids, sources and languages are values like others (a null id ranks last where one
row of several stays); repeated rows are judged alike, and the join keeps one of them; very
long texts are read whole; an empty table gives an empty table; further columns are carried
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import bpe, line_dedup, mixing, ngram_join, quality
from loomdex.llm._store import materialize
from loomdex.llm.queries import bpe_model_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (9): documents that the base rules or the learned decision list reject go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (8): repeated lines go; a document that loses all its words with them goes too."""
    cleaned = line_dedup.dedup(docs)
    cleaned = cleaned.where((F.size("__removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    counted = cleaned.withColumn("n_chars", F.when(F.size("__removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return counted.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (7): of rows that links of 5-word sets (Jaccard 0.8 or more) connect, one stays.

    It is that of the smallest id (null last), there that of the smallest text hash; of
    rows equal in both any one. Rows are told apart by a number of their own, so repeated
    and null ids do no harm.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    joined = ngram_join.components(rows, n=5, num=80, den=100, key="__row").select("__row", "component_id")
    placed = rows.select("__row", "doc_id", F.xxhash64("text").alias("th")).join(joined, "__row")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "__row")
    first = placed.groupBy("component_id").agg(F.min(rank)["__row"].alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = placed.join(first, "component_id").where(F.col("__row") != F.col("first")).select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (2): each document as often as systematic sampling to the sources' targets takes it."""
    return mixing.mix(docs)


def code(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE (1): the ids of every text, and the text that they decode to."""
    coded = bpe.encode_decode(docs, bpe_model_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", one_of_each),
    ("mix", mix_sources),
    ("bpe", code),
]
#: Line dedup's SimHash, the join's components and BPE merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
