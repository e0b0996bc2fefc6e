"""Registered catalogue, access and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.operators import catalog as c
from docskein.operators.metrics import lookback
from docskein.plans.fixtures import AS_OF_LOG
from docskein.plans.registry import query, stamp

_TS = "yyyy-MM-dd HH:mm:ss"


@query("repo_documents", """
SELECT d.repository, d.doc_id, (row_number() OVER (PARTITION BY d.repository ORDER BY ingested_at DESC, doc_id))::INT AS rank
FROM docs d JOIN repositories r ON r.name = d.repository QUALIFY rank <= 50""", "docs repositories")
def _(t):
    return c.repo_documents(t.docs.drop("text"), t.repositories).select("repository", "doc_id", "rank")


@query("document_list", """
WITH p AS (SELECT DISTINCT CASE WHEN role = 'admin' THEN '#ADMIN' ELSE
  array_to_string(list_sort(list_distinct(list_transform(access_roles, lambda r: upper(r)))), '|') END AS profile,
  role = 'admin' AS admin, list_sort(list_transform(access_roles, lambda r: upper(r))) AS roles FROM users),
v AS (SELECT DISTINCT p.profile, d.doc_id, d.ingested_at, r.repository_id FROM p JOIN docs d
 ON p.admin OR d.access_roles IS NULL OR list_has_any(list_transform(d.access_roles, lambda r: upper(r)), p.roles)
 LEFT JOIN repositories r ON r.name = d.repository)
SELECT profile, doc_id, repository_id, (row_number() OVER (PARTITION BY profile ORDER BY ingested_at DESC, doc_id))::INT AS rank
FROM v QUALIFY rank <= 50""", "docs users repositories")
def _(t):
    return c.document_list(t.docs.drop("text"), t.repositories, t.users).select(
        "profile", "doc_id", "repository_id", "rank")


@query("document_detail", """
SELECT d.doc_id, d.source_file, count(c.chunk_id) AS n_chunks,
 coalesce(string_agg(CAST(c.chunk_id AS VARCHAR), ',' ORDER BY c.chunk_index), '') AS chunk_ids,
 coalesce(sum(length(c.content)), 0)::BIGINT AS chars
FROM docs d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY ALL""", "docs chunks")
def _(t):
    d = c.document_detail(t.docs.drop("text"), t.chunks)
    ids = F.array_join(F.transform("chunks", lambda x: x["chunk_id"].cast("string")), ",")
    chars = F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["content"]))
    return d.select("doc_id", "source_file", F.coalesce(F.size("chunks"), F.lit(0)).cast("bigint").alias("n_chunks"),
                    F.coalesce(ids, F.lit("")).alias("chunk_ids"), F.coalesce(chars, F.lit(0)).alias("chars")
                    ).withColumn("n_chunks", F.greatest("n_chunks", F.lit(0)))


_STATS = """n AS (SELECT doc_id, count(*) AS k FROM chunks GROUP BY doc_id)
SELECT r.repository_id, r.name, count(d.doc_id) AS document_count, coalesce(sum(n.k), 0)::BIGINT AS chunk_count
FROM repositories r LEFT JOIN docs d ON d.repository = r.name LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL"""


@query("repo_stats", f"WITH {_STATS}", "docs chunks repositories")
def _(t):
    return c.repo_stats(t.repositories, t.docs.select("doc_id", "repository"), c.chunk_counts(t.chunks)).select(
        "repository_id", "name", "document_count", "chunk_count")


@query("repo_stats_refresh", """
SELECT d.repository, count(DISTINCT d.doc_id) AS document_count, count(*) AS chunk_count
FROM chunks c JOIN docs d ON d.doc_id = c.doc_id WHERE d.repository IS NOT NULL GROUP BY d.repository""", "docs chunks")
def _(t):
    return c.repo_stats_from_chunks(t.chunks, t.docs)


@query("access_requests", f"""
SELECT a.user_id, u.email AS user_email, a.resource_name, a.status, r.username AS resolved_by_name,
 {stamp('a.requested_at')} AS requested_at FROM access_requests a JOIN users u ON u.user_id = a.user_id
LEFT JOIN users r ON r.user_id = a.resolved_by""", "access_requests users")
def _(t):
    return c.access_requests(t.access_requests, t.users).select(
        "user_id", "user_email", "resource_name", "status", "resolved_by_name",
        F.date_format("requested_at", _TS).alias("requested_at"))


@query("audit_list", """
SELECT l.id, l.user_id, u.email AS user_email, l.intent FROM query_log l LEFT JOIN users u ON u.user_id = l.user_id
WHERE l.intent = 'SEARCH' AND u.email ILIKE '%1@example%'""", "query_log users")
def _(t):
    return c.audit_list(t.query_log, t.users, "SEARCH", "1@example").select("id", "user_id", "user_email", "intent")


@query("audit_page", """
SELECT l.id, u.email AS user_email FROM query_log l LEFT JOIN users u ON u.user_id = l.user_id
ORDER BY l.ts DESC, l.id DESC LIMIT 50 OFFSET 100""", "query_log users")
def _(t):
    newest = c.page(t.query_log, [F.desc("ts"), F.desc("id")], 50, 100)
    return c.audit_list(newest, t.users).select("id", "user_email")


_SESS = """s AS (SELECT session_id, user_id, substr(coalesce(arg_min(CASE WHEN role = 'user' THEN trim(content) END,
 CASE WHEN role = 'user' THEN turn END), 'New Chat'), 1, 255) AS title, max(created_at) AS updated_at, count(*) AS message_count
 FROM messages GROUP BY ALL)"""


@query("session_title", f"WITH {_SESS} SELECT session_id, title, {stamp('updated_at')} AS updated_at FROM s", "messages")
def _(t):
    return c.sessions(t.messages).select("session_id", "title", F.date_format("updated_at", _TS).alias("updated_at"))


@query("session_list", f"""
WITH {_SESS} SELECT user_id, session_id, message_count,
 (row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, session_id))::INT AS rank FROM s QUALIFY rank <= 50""",
       "messages")
def _(t):
    return c.session_list(t.messages).select("user_id", "session_id", "message_count", "rank")


@query("session_messages", """
SELECT m.session_id, m.turn, m.role, length(m.content)::BIGINT AS chars FROM messages m
JOIN (SELECT conv_id AS session_id, min(conv_id % 150 + conv_id % 2) AS user_id FROM conversations GROUP BY conv_id) r
 ON r.session_id = m.session_id AND r.user_id = m.user_id""", "messages")
def _(t):
    # every second session is asked for by somebody else than its owner
    asked = t.conversations.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.min(F.col("conv_id") % 150 + F.col("conv_id") % 2).alias("user_id"))
    return c.session_messages(t.messages, asked).select(
        "session_id", "turn", "role", F.length("content").cast("bigint").alias("chars"))


@query("session_buckets", f"""
WITH {_SESS}, a AS (SELECT date_diff('day', updated_at::DATE, (SELECT max(created_at)::DATE FROM messages)) AS age FROM s)
SELECT CASE WHEN age <= 0 THEN 'Today' WHEN age = 1 THEN 'Yesterday' WHEN age <= 7 THEN 'Previous 7 Days' ELSE 'Older' END AS bucket,
 count(*) AS sessions FROM a GROUP BY 1""", "messages")
def _(t):
    newest = t.messages.agg(F.max("created_at")).first()[0]
    return c.session_buckets(c.sessions(t.messages), str(newest))


@query("active_scope", """
WITH s AS (SELECT conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN conv_id END AS bundle_id FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id AS session_id, [conv_id, conv_id + 1] AS ids FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id),
x AS (SELECT s.session_id, unnest(list_distinct(coalesce(e.ids, b.document_ids))) AS doc_id FROM s
 LEFT JOIN bundles b ON b.bundle_id = s.bundle_id LEFT JOIN e ON e.session_id = s.session_id)
SELECT x.session_id, x.doc_id, d.source_file FROM x LEFT JOIN docs d ON d.doc_id = x.doc_id""", "bundles docs")
def _(t):
    conv = t.conversations.select(F.col("conv_id").alias("session_id")).distinct()
    sess = conv.withColumn("bundle_id", F.when(F.col("session_id") % 2 == 0, F.col("session_id")))
    explicit = conv.filter(F.col("session_id") % 3 == 0).withColumn(
        "document_ids", F.array(F.col("session_id"), F.col("session_id") + 1))
    return c.active_scope(sess, t.bundles, explicit, t.docs).select("session_id", "doc_id", "source_file")


@query("bundle_list", """
SELECT bundle_id, user_id, name, pinned, row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC, created_at DESC, bundle_id)::INT AS rank
FROM bundles WHERE name ILIKE '%b%'""", "bundles")
def _(t):
    return c.bundle_list(t.bundles, "b").select("bundle_id", "user_id", "name", "pinned", "rank")


@query("catalog_counts", """
SELECT (SELECT count(*) FROM docs) AS total_documents, (SELECT count(*) FROM chunks) AS total_chunks,
 (SELECT count(*) FROM tickets) AS total_tickets, (SELECT count(*) FROM repositories) AS total_repositories,
 (SELECT count(*) FROM access_requests WHERE status = 'pending') AS pending_requests""",
       "docs chunks tickets repositories access_requests")
def _(t):
    return c.catalog_counts(t.docs, t.chunks, t.tickets, t.repositories, t.access_requests)


@query("json_metadata", """
SELECT event_id, CAST(json_extract(regexp_extract(props, '(?s)\\{.*\\}', 0), '$.k') AS BIGINT) AS k FROM events""")
def _(t):
    obj = F.from_json(F.regexp_extract("props", r"(?s)\{.*\}", 0), "k bigint")
    return t.events.select("event_id", obj["k"].alias("k"))
