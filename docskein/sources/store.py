"""Keyed writes as set operations, and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions.ranking import latest
from docskein.session import shuffles_dropped, stored


def merge_upsert(current: DataFrame, changes: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Insert or update by key; among several changes of one key the highest ``version`` wins.

    Only the latest change per key is kept before the join, and current rows meet changes by an anti-join, so the
    current table is never sorted.
    """
    last = latest(changes, key, [F.desc(v) for v in version])
    return current.join(last.select(*key), key, "left_anti").unionByName(last)


def insert_ignore(current: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Insert rows whose key is not present; the first new row per key wins."""
    first = latest(new, key, [F.asc(o) for o in order])
    return current.unionByName(first.join(current.select(*key), key, "left_anti"))


def update_doc_attributes(chunks: DataFrame, changes: DataFrame, version: list[str] | None = None) -> DataFrame:
    """Apply document changes (repository, doc_origin, access_roles) to all chunks.

    A change matches by ``doc_id``; one whose ``doc_id`` has no chunk matches by file name. Of several changes of one
    document, or of one file, the highest ``version`` wins (without it, the highest values), so no chunk is ever
    multiplied. The repository also replaces the department, as both label the chunk.
    """
    present = chunks.select("doc_id").distinct()
    fields = ["repository", "doc_origin", "access_roles"]
    order = [F.desc(v) for v in version or ["doc_id", *fields]]
    by_id = latest(changes.join(present, "doc_id", "left_semi"), ["doc_id"], order).select(
        "doc_id", *[F.col(f).alias(f"_i_{f}") for f in fields])
    by_file = latest(changes.join(present, "doc_id", "left_anti"), ["source_file"], order).select(
        "source_file", *[F.col(f).alias(f"_f_{f}") for f in fields])
    out = chunks.join(by_id, "doc_id", "left").join(by_file, "source_file", "left")
    pick = lambda f, old: F.coalesce(f"_i_{f}", f"_f_{f}", old)
    return out.withColumns({
        "department": pick("repository", "department"),
        "repository": pick("repository", "repository"),
        "doc_origin": pick("doc_origin", "doc_origin"),
        "access_roles": pick("access_roles", "access_roles"),
    }).drop(*[f"_{p}_{f}" for p in "if" for f in fields])


def clip(text: Column, limit: int | None = None) -> Column:
    """Logged text, whole unless the log has a ``limit`` of characters."""
    return text if limit is None else F.substring(text, 1, limit)


def log_rows(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Query-log rows in the log schema with their date partition."""
    return queries.select(
        "id", "ts", "user_id", "session_id", clip(F.col("query_text"), limit).alias("query_text"), "intent",
        "repositories_searched", "chunks_retrieved", "confidence", "reranker_top_score", "latency_ms", "low_confidence",
        F.to_date("ts").alias("log_date"))


def append_log(queries: DataFrame, path: str, limit: int | None = None) -> None:
    """Append log rows to date-partitioned Parquet."""
    log_rows(queries, limit).write.mode("append").partitionBy("log_date").parquet(path)


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with the store's defaults for missing attributes."""
    return chunks.withColumns({
        "doc_origin": F.coalesce("doc_origin", F.lit("INTERNAL")),
        "repository": F.coalesce("repository", "department", F.lit("Unknown")),
        "priority_tier": F.coalesce("priority_tier", F.lit(1)),
        "access_roles": F.coalesce("access_roles", F.array().cast("array<string>")),
    })


TASK_BYTES = 64 << 20  # text that a writing task sorts by partition


def _volume(rows: DataFrame) -> int:
    """Bytes of the texts of ``rows``, with a little for each row."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rows.dtypes if kind == "string"]
    return rows.agg(F.sum(sum(sizes, F.lit(64).cast("bigint")))).first()[0] or 0


def write_chunks(chunks: DataFrame, path: str, version: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write chunks, latest per ``chunk_id``, as Parquet partitioned by origin and repository.

    ``mode='overwrite'`` on a session with dynamic partition overwrite replaces touched partitions only. The latest rows are
    found among keys and versions alone; texts are stored once, then meet the numbers of the chosen rows by hash, in as many
    parts as their volume asks for. So no task sorts more than about ``TASK_BYTES`` of text, however large the table or often a key.
    """
    rows = chunk_rows(chunks)
    if version:
        held = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "chunk-rows", "zstd")
        volume = _volume(held)
        # small tables still keep all cores busy
        parts = max(1, -(-volume // TASK_BYTES), min(held.sparkSession.sparkContext.defaultParallelism, -(-volume // (TASK_BYTES >> 4))))
        last = latest(held.select("chunk_id", "_row", *version), ["chunk_id"], [F.desc(v) for v in version]).select("_row")
        rows = held.repartition(parts, "_row").join(
            last.repartition(parts, "_row").hint("shuffle_hash"), "_row", "left_semi").drop("_row")
    with shuffles_dropped(chunks.sparkSession):
        (rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("doc_origin", "repository").parquet(path))
