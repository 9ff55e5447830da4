"""The corpus pipeline: five stages over documents, each one operator of treeloom.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
A null or empty text, an empty table, repeated rows and further columns are handled as the
operators document; the language stage rejects texts without letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import decontamination, language, simhash, substring_dedup
from treeloom.llm.common import scratch, table
from treeloom.llm.queries import bpe_digests

#: A text whose phrases exceed one letter by less than this share of what is usual in the nearest language is no text of a learned language.
LEAST_LIKENESS = 0.12


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least_likeness: float = LEAST_LIKENESS) -> DataFrame:
    """Drops documents without letters, and those whose likeness to the nearest learned language is under least_likeness (0: none); lang stays as it was. Learns from two thirds of the labelled documents."""
    model = language.fit(docs.filter((language.fold("doc_id", 3) != 1) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    found = language.identify(docs, model)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("likeness") >= least_likeness)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of five-word-shingle similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs, similarity=0.8)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words that start in an earlier document too; untouched texts stay as they are, documents left without words go."""
    out = substring_dedup.remove_repeats(docs, window=50)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    kept = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat an item of the benchmark; a row without an id stays."""
    leaks = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the digests of the ids and of the decoded text."""
    return bpe_digests(docs, "doc_id", "lang", "source")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: No SQL: a fitted language model, similarity groups and latent retrieval are not expressible; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
