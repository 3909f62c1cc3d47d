"""Corpus pipeline over ``documents``; each stage calls one operator of ``cuadro.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes the result of each as
Parquet in the shared scratch folder and hands the reread table to the next. All stages but the
last return the columns of ``documents``; other columns of their input are dropped.

Defined results: null texts are rejected by the language stage; a doc_id stands for one document,
so of repeated rows one stays; rows without an id cannot be told apart and stay unless language or
benchmark rejects them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuadro.llm import bpe, decontam, language_id, pii, simhash
from cuadro.llm.common import documents
from cuadro.llm.queries import BPE_RANKS
from cuadro.session import configure, materialise, read_table, release_scratch, scratch_count

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A text this far from every learned language is rejected; clean text scores over 0.4.
MIN_SCORE = 0.2
SHINGLE, BITS = 4, 4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is near a learned language; ``und`` and far texts go."""
    docs = docs.select(*COLUMNS)
    profiles = language_id.learn(docs, F.col("lang"))
    labelled = language_id.label(docs, profiles)
    return labelled.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group."""
    docs = docs.select(*COLUMNS)
    kept = simhash.near_duplicates(docs, SHINGLE, BITS).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy, edited or not, of a benchmark item."""
    return decontam.remove(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the name of its kind; n_chars follows the new text."""
    return pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and the byte offsets for decoding."""
    return bpe.encode(docs.select(*COLUMNS), BPE_RANKS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mask_pii", mask_pii), ("encode", encode)]

#: SQL cannot express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = documents(spark, sf_dir)
    held = scratch_count()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release_scratch(held, keep_last=True)               # what the stage wrote in passing, and its input
    return docs
