"""A training corpus from raw documents: quality rules, line and near deduplication, source mixing, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the docs of the
next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm import copies, mixing, packing, quality, setjoin, simhash
from docskein.session import ship, stored

MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [3, 1, 2], 1.5, 2.0


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the model, which learns from the labels of this folder."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that match an earlier line of the corpus."""
    ship(spark)
    return _sized(setjoin.without_repeated_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints that differ in two bits at most link, and so do texts
    whose five-word shingles have a Jaccard similarity of 0.8 at least, which two bits often miss."""
    ship(spark)
    alike = simhash.near_duplicates(docs).select("doc_id", "component_id")
    return simhash.smallest_of(docs, stored(simhash.joined(alike, copies.near_copies(docs)), "near-copies"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    ship(spark)
    return mixing.mixed_documents(docs, MIX_WEIGHTS, MIX_SHARE, MIX_MOST)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    ship(spark)
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("pack_sequences", pack)]

# hashes and the trained model have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is a written table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir.rstrip("/")), name)
    return docs
