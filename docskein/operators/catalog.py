"""Catalogue, access and session reports: equality joins, small pre-aggregates, ordered top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.functions.ranking import top_k
from docskein.operators.filters import visible_rows


def with_repository(docs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Documents with the id of the repository they name; those naming none keep a null."""
    r = repositories.select("repository_id", F.col("name").alias("repository"))
    return docs.join(r, "repository", "left")


def repo_documents(docs: DataFrame, repositories: DataFrame, limit: int = 50) -> DataFrame:
    """Newest ``limit`` documents of every repository."""
    joined = docs.join(repositories.select(F.col("name").alias("repository")), "repository")
    return top_k(joined, ["repository"], [F.desc("ingested_at"), F.asc("doc_id")], limit)


def document_list(docs: DataFrame, repositories: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    """Newest visible documents per role profile. Visibility is applied before the limit, so no page comes up short."""
    return top_k(visible_rows(with_repository(docs, repositories), users), ["profile"],
                 [F.desc("ingested_at"), F.asc("doc_id")], limit)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))


def document_detail(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document with its ordered chunks nested. The nested array is as long as the document itself."""
    nested = chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("chunks"))
    return docs.join(nested, "doc_id", "left")


def repo_stats(repositories: DataFrame, docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Live document and chunk counts of every repository, zeros kept."""
    per_repo = (docs.select("doc_id", F.col("repository").alias("name")).join(counts, "doc_id", "left")
                .groupBy("name").agg(F.count("*").alias("document_count"),
                                     F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunk_count")))
    return repositories.join(per_repo, "name", "left").na.fill(0, ["document_count", "chunk_count"])


def repo_stats_from_chunks(chunks: DataFrame, doc_repositories: DataFrame) -> DataFrame:
    """The stored-procedure variant: counts the chunk table and leaves out repositories without chunks."""
    per_doc = chunk_counts(chunks).join(doc_repositories.select("doc_id", "repository"), "doc_id")
    return per_doc.filter(F.col("repository").isNotNull()).groupBy("repository").agg(
        F.count("*").alias("document_count"), F.sum("chunk_count").alias("chunk_count"))


def access_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with requester and resolver names."""
    who = users.select("user_id", F.col("email").alias("user_email"), F.col("username").alias("user_name"))
    by = users.select(F.col("user_id").alias("resolved_by"), F.col("username").alias("resolved_by_name"))
    return requests.join(who, "user_id").join(by, "resolved_by", "left")


def audit_list(log: DataFrame, users: DataFrame, action: str | None = None, email: str | None = None) -> DataFrame:
    """Log rows with the user's e-mail, optionally filtered."""
    u = users.select("user_id", F.col("email").alias("user_email"))
    out = log if action is None else log.filter(F.col("intent") == action)
    out = out.join(u, "user_id", "left")
    return out if email is None else out.filter(F.col("user_email").ilike(f"%{email}%"))


def page(df: DataFrame, order: list[Column], limit: int, skip: int) -> DataFrame:
    """One page of an ordered list; ``order`` ends in a unique key."""
    return df.orderBy(*order).offset(skip).limit(limit)


def sessions(messages: DataFrame) -> DataFrame:
    """One row per session: owner, title from its first question (≤ 255 characters), activity and message count."""
    first_ask = F.min_by(F.when(F.col("role") == "user", F.trim("content")),
                         F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("session_id", "user_id").agg(
        F.substring(F.coalesce(first_ask, F.lit("New Chat")), 1, 255).alias("title"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        F.count("*").alias("message_count"),
    )


def session_list(messages: DataFrame, limit: int = 50) -> DataFrame:
    """Latest sessions of every user."""
    return top_k(sessions(messages), ["user_id"], [F.desc("updated_at"), F.asc("session_id")], limit)


def session_messages(messages: DataFrame, requested: DataFrame) -> DataFrame:
    """Messages of requested (session_id, user_id) pairs; a session asked for by anyone but its owner yields nothing."""
    return messages.join(requested.select("session_id", "user_id").distinct(), ["session_id", "user_id"])


def session_buckets(sess: DataFrame, as_of: str) -> DataFrame:
    """Sessions per recency band."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("updated_at"))
    band = (F.when(age <= 0, "Today").when(age == 1, "Yesterday").when(age <= 7, "Previous 7 Days").otherwise("Older"))
    return sess.groupBy(band.alias("bucket")).agg(F.count("*").alias("sessions"))


def active_scope(sess: DataFrame, bundles: DataFrame, explicit: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents each session is limited to: an explicit list overrides the applied bundle."""
    b = bundles.select("bundle_id", F.col("document_ids").alias("_bundle"))
    e = explicit.select("session_id", F.col("document_ids").alias("_explicit"))
    scoped = sess.join(b, "bundle_id", "left").join(e, "session_id", "left").select(
        "session_id", F.explode(F.array_distinct(F.coalesce("_explicit", "_bundle"))).alias("doc_id"))
    return scoped.join(docs.select("doc_id", "source_file"), "doc_id", "left")


def bundle_list(bundles: DataFrame, name: str | None = None) -> DataFrame:
    """Bundles with their ``rank`` in each user's display order (pinned first, then newest), optionally by name."""
    out = bundles if name is None else bundles.filter(F.col("name").ilike(f"%{name}%"))
    order = Window.partitionBy("user_id").orderBy(F.desc("pinned"), F.desc("created_at"), "bundle_id")
    return out.withColumn("rank", F.row_number().over(order))


def catalog_counts(docs: DataFrame, chunks: DataFrame, tickets: DataFrame, repositories: DataFrame,
                   requests: DataFrame) -> DataFrame:
    """The dashboard's five totals in one row."""
    n = F.count("*")
    return docs.agg(n.alias("total_documents")).select(
        "total_documents",
        chunks.agg(n).scalar().alias("total_chunks"),
        tickets.agg(n).scalar().alias("total_tickets"),
        repositories.agg(n).scalar().alias("total_repositories"),
        requests.filter(F.col("status") == "pending").agg(n).scalar().alias("pending_requests"),
    )
