"""Registered predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions.text import basename, doc_title
from docskein.operators import filters as f
from docskein.plans.registry import query

_VISIBLE = """(u.role = 'admin' OR d.access_roles IS NULL OR len(d.access_roles) = 0 OR
 list_has_any(list_transform(d.access_roles, lambda r: upper(r)), list_transform(u.access_roles, lambda r: upper(r))))"""


@query("doc_title", r"""
SELECT doc_id, translate(regexp_replace(source_file, '\.[^.]*$', ''), '_-', '  ') AS title FROM docs""", "docs")
def _(t):
    return t.docs.select("doc_id", doc_title(F.col("source_file")).alias("title"))


@query("basename", r"""
SELECT doc_id, list_extract(string_split(replace(path, '\', '/'), '/'), -1) AS name FROM (
 SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/data/in/' || source_file ELSE 'C:\Temp\in\' || source_file END AS path FROM docs)""",
       "docs")
def _(t):
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/data/in/"), "source_file")).otherwise(
        F.concat(F.lit("C:\\Temp\\in\\"), "source_file"))
    return t.docs.select("doc_id", basename(path).alias("name"))


@query("rbac_filter", f"""
SELECT u.user_id, count(d.doc_id) AS visible FROM users u LEFT JOIN docs d ON {_VISIBLE} GROUP BY u.user_id""",
       "docs users")
def _(t):
    return f.visible_counts(t.docs, t.users)


@query("rbac_prefilter", """
SELECT q.user_roles[1] || '+' || len(q.user_roles) AS roles, count(*) AS chunks, sum(c.chunk_id)::BIGINT AS id_sum
FROM (SELECT DISTINCT user_roles FROM queries) q JOIN chunk_meta c
 ON c.access_roles IS NULL OR list_has_any(c.access_roles, q.user_roles) GROUP BY 1""", "queries chunk_meta")
def _(t):
    users = t.queries.select(F.col("user_roles").alias("access_roles"), F.lit("employee").alias("role")).distinct()
    rows = f.visible_rows(t.chunk_meta.select("chunk_id", "access_roles"), users)
    label = users.select(f.role_signature(F.col("access_roles")).alias("profile"),
                         F.concat(F.col("access_roles")[0], F.lit("+"), F.size("access_roles")).alias("roles"))
    per = rows.groupBy("profile").agg(F.count("*").alias("chunks"), F.sum("chunk_id").alias("id_sum"))
    return per.join(label, "profile").select("roles", "chunks", "id_sum")


@query("payload_filter", """
SELECT chunk_id, doc_id FROM chunk_meta WHERE doc_origin = 'INTERNAL' AND doc_type IN ('Policy','SOP')
 AND list_has_any(access_roles, ['HR','EMPLOYEE'])""", "chunk_meta")
def _(t):
    cond = f.payload_filter({"doc_origin": "INTERNAL", "doc_type": ["Policy", "SOP"], "access_roles": ["HR", "EMPLOYEE"]})
    return t.chunk_meta.filter(cond).select("chunk_id", "doc_id")


@query("scope_filter", """
WITH q AS (SELECT *, CASE WHEN scope_doc_ids IS NOT NULL THEN 'DOC' WHEN scope_repository IS NOT NULL THEN 'REPOSITORY'
 WHEN scope_department IS NOT NULL THEN 'DEPARTMENT' ELSE 'GLOBAL' END AS kind FROM queries)
SELECT q.query_id, q.kind, count(c.chunk_id) AS in_scope FROM q LEFT JOIN chunk_meta c
 ON CASE q.kind WHEN 'DOC' THEN list_contains(q.scope_doc_ids, c.doc_id) WHEN 'REPOSITORY' THEN c.repository = q.scope_repository
  WHEN 'DEPARTMENT' THEN c.department = q.scope_department ELSE true END GROUP BY ALL""", "queries chunk_meta")
def _(t):
    return f.scope_sizes(t.queries, t.chunk_meta)


@query("ticket_filter", """
SELECT ticket_id FROM tickets WHERE status = 'open' AND category = 'Network' AND priority = 'High'""", "tickets")
def _(t):
    cond = f.equal_filters({"status": "open", "category": "Network", "priority": "High"})
    return t.tickets.filter(cond).select("ticket_id")


@query("ilike_search", "SELECT user_id, email FROM users WHERE email ILIKE '%R.00%5@EXAMPLE%'", "users")
def _(t):
    return t.users.filter(F.col("email").ilike("%R.00%5@EXAMPLE%")).select("user_id", "email")


@query("visible_repos", """
SELECT u.user_id, r.name FROM users u JOIN repositories r ON u.role = 'admin'
 OR list_contains(list_transform(u.access_roles, lambda x: upper(x)), 'EMPLOYEE')
 OR list_contains(list_transform(u.access_roles, lambda x: upper(x)), upper(r.name))""", "users repositories")
def _(t):
    return f.visible_repositories(t.repositories, t.users)
