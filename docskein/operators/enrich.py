"""Chunk metadata, the four views to embed, deterministic enrichment, catalogue records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.operators.classify import category_department, priority_tier


def stamp_metadata(chunks: DataFrame, docs: DataFrame, uploaded_by: str = "system") -> DataFrame:
    """Copy document attributes onto every chunk, with defaults."""
    attrs = docs.select("doc_id", "department", "doc_origin", "repository", "access_roles", "project_id", "source_file",
                        "ingested_at")
    dropped = chunks.drop(*[c for c in chunks.columns if c in attrs.columns and c != "doc_id"])
    roles = F.array(*[F.lit(r) for r in fixed.DEFAULT_ROLES])
    return dropped.join(attrs, "doc_id").select(
        *dropped.columns, "department", "doc_origin", "source_file",
        priority_tier(F.col("doc_origin")).alias("priority_tier"),
        F.coalesce("repository", "department", F.lit("Unknown")).alias("repository"),
        F.coalesce("access_roles", roles).alias("access_roles"),
        F.coalesce("project_id", F.lit("")).alias("project_id"),
        F.lit(uploaded_by).alias("uploaded_by"),
        F.col("ingested_at").alias("created_at"),
    )


def four_views(chunks: DataFrame) -> DataFrame:
    """Text to embed per view in long form. Missing summaries, questions and keywords fall back to the opening words."""
    opening = F.substring("content", 1, 200)
    lines = lambda *cols: F.coalesce(*[
        F.when(F.size(c) > 0, F.array_join(c, "\n")) for c in cols], opening)
    summary = F.trim(F.coalesce("chunk_summary", F.lit("")))
    view = lambda name, text: F.struct(F.lit(name).alias("vector_name"), text.alias("text"))
    return chunks.select("chunk_id", F.explode(F.array(
        view("content", F.col("content")),
        view("summary", F.when(summary != "", summary).otherwise(opening)),
        view("question", lines("chunk_questions", "hypothetical_questions")),
        view("keyword", lines("chunk_keywords", "keywords")),
    )).alias("v")).select("chunk_id", "v.*")


def fallback_enrichment(chunks: DataFrame) -> DataFrame:
    """Deterministic summary and questions from the section title."""
    t = F.col("section_title")
    return chunks.withColumns({
        "chunk_summary": F.concat(F.lit("Information about "), t),
        "chunk_keywords": F.array().cast("array<string>"),
        "chunk_questions": F.array(F.concat(F.lit("What is "), t, F.lit("?")),
                                   F.concat(F.lit("How does "), t, F.lit(" work?"))),
    })


def ticket_to_chunk(tickets: DataFrame) -> DataFrame:
    """Searchable chunk per ticket. Ids are SHA-1 over a fixed name space, stable across runs."""
    stable = lambda c: F.sha1(F.concat(F.lit("ticket-namespace:"), c))
    cat, pri = F.coalesce("category", F.lit("General")), F.coalesce("priority", F.lit("Medium"))
    return tickets.select(
        stable(F.col("ticket_id")).alias("chunk_id"),
        stable(F.concat(F.lit("tickets_"), cat)).alias("doc_id"),
        "ticket_id",
        F.concat(F.lit("Ticket ID: "), "ticket_id", F.lit("\nSubject: "), "subject", F.lit("\n\nDescription:\n"),
                 "description").alias("content"),
        F.substring("subject", 1, 100).alias("section_title"),
        category_department(cat).alias("department"),
        F.array(F.concat(F.lit("How was the "), cat, F.lit(" issue '"), F.substring("subject", 1, 50),
                         F.lit("' resolved?")),
                F.concat(F.lit("What should I do when I have a "), F.lower(pri), F.lit(" priority "), cat,
                         F.lit(" problem?"))).alias("hypothetical_questions"),
        F.concat(F.array(F.lower(cat), F.lower(pri)),
                 F.slice(F.filter(F.split(F.lower("subject"), r"\s+"), lambda w: w != ""), 1, 5)).alias("keywords"),
    )


def embed_once(texts: DataFrame, embed: Callable[[pd.Series], pd.Series], column: str = "text") -> DataFrame:
    """Embed each distinct text once and join the vectors back.

    The key is the MD5 of the text; copies collapse before the model runs, and the join back is on the key, where the
    vector side has one row per distinct text (so a text that fills a third of the rows is split by AQE, not grouped).
    """
    keyed = texts.withColumn("text_key", F.md5(column))
    distinct = keyed.groupBy("text_key").agg(F.first(column).alias(column))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text_key": pdf["text_key"], "embedding": embed(pdf[column])})

    vectors = distinct.mapInPandas(run, "text_key string, embedding array<float>")
    return keyed.join(vectors, "text_key")


def distinct_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """What ``embed_once`` sends to the model: key and number of rows sharing it."""
    return texts.groupBy(F.md5(column).alias("text_key")).agg(F.count("*").alias("uses"))


def hash_embed(chunks: DataFrame, dims: int = 256) -> DataFrame:
    """Stand-in embedding: L2-normalised TF-IDF over hashed terms."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from docskein.functions.text import tokens
    from docskein.session import stored

    counted = HashingTF(inputCol="terms", outputCol="tf", numFeatures=dims).transform(
        chunks.select("chunk_id", tokens(F.col("content")).alias("terms"))).select("chunk_id", "tf")
    # the document frequencies and the vectors both read the counts: texts are cut and hashed once
    counted = stored(counted, "term-counts", "zstd")
    model = Pipeline(stages=[
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="unit", p=2.0),
    ]).fit(counted)
    return model.transform(counted).select("chunk_id", vector_to_array("unit", "float32").alias("embedding"))


def doc_records(docs: DataFrame, chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """Catalogue row per document."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    repo = repositories.select("repository_id", F.col("name").alias("repository"))
    return docs.join(counts, "doc_id", "left").join(repo, "repository", "left").select(
        "doc_id", F.substring("title", 1, 512).alias("title"), F.sha2("text", 256).alias("checksum"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "repository_id", F.lit("READY").alias("status"))


def ingest_summary(docs: DataFrame, chunks: DataFrame, pii_counts: DataFrame) -> DataFrame:
    """Per document: classification, chunk count and personal-data counts by type (as a map)."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    pii = pii_counts.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", "n")))).alias("pii"))
    return docs.join(counts, "doc_id", "left").join(pii, "doc_id", "left").withColumn(
        "chunks", F.coalesce("chunks", F.lit(0)))
