"""Registered ticket queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.operators import tickets as tk
from docskein.operators import understand as u
from docskein.plans import retrieval as rt
from docskein.plans.q_context import _CASCADE, _cascade, _scoped
from docskein.plans.q_search import bm25_ctes, duck_tokens
from docskein.plans.q_understand import TICKET_FILTERS
from docskein.plans.registry import query, stamp

_TS = "yyyy-MM-dd HH:mm:ss"
_ALL = "concat_ws(' ', subject, description, resolution)"

# every user turn as a question, whole
_TQ = """tq AS (SELECT conv_id * 1000 + turn AS query_id, text,
 CASE WHEN turn % 4 = 0 THEN 'open' END AS status, CASE WHEN conv_id % 3 = 1 THEN 'High' END AS priority,
 CAST(NULL AS VARCHAR) AS category, CASE WHEN conv_id % 5 = 0 THEN ['TCK' || lpad(CAST(conv_id + 1 AS VARCHAR), 6, '0')] ELSE [] END AS ticket_ids
 FROM conversations WHERE role = 'user')"""


def _ticket_queries(t):
    conv = t.conversations.filter(F.col("role") == "user")
    tid = F.concat(F.lit("TCK"), F.lpad((F.col("conv_id") + 1).cast("string"), 6, "0"))
    return conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text",
        F.when(F.col("turn") % 4 == 0, "open").alias("status"), F.when(F.col("conv_id") % 3 == 1, "High").alias("priority"),
        F.lit(None).cast("string").alias("category"),
        F.when(F.col("conv_id") % 5 == 0, F.array(tid)).otherwise(F.array().cast("array<string>")).alias("ticket_ids"))


@query("ticket_status", """
SELECT ticket_id, CASE lower(trim(status_raw)) WHEN 'done' THEN 'resolved' WHEN 'new' THEN 'open'
 ELSE CASE WHEN coalesce(trim(resolution), '') <> '' OR resolved_at IS NOT NULL THEN 'resolved' ELSE 'open' END END AS status FROM tickets""", "tickets")
def _(t):
    return t.tickets.select("ticket_id", tk.normalise_status(F.col("status_raw"), F.col("resolution"), F.col("resolved_at")).alias("status"))


@query("parse_iso_ts", f"""
WITH r AS (SELECT ticket_id, created_at, requester_id % 4 AS k FROM tickets)
SELECT ticket_id, {stamp("CASE WHEN k = 3 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE created_at END")} AS created_at FROM r""", "tickets")
def _(t):
    c, k = F.col("created_at"), F.col("requester_id") % 4
    raw = (F.when(k == 0, F.date_format(c, "yyyy-MM-dd")).when(k == 1, F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
           .when(k == 2, F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise("last tuesday"))
    parsed = tk.parse_iso(raw, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return t.tickets.select("ticket_id", F.date_format(parsed, _TS).alias("created_at"))


_FTS = f"{bm25_ctes('tickets', 'ticket_id', _ALL, 'tq')}, m AS (SELECT * FROM b_any WHERE full_hit)"


@query("ticket_fts", f"""
WITH {_TQ}, {_FTS} SELECT query_id, chunk_id AS ticket_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank
FROM m QUALIFY rank <= 10""", "tickets")
def _(t):
    return tk.search(t.tickets, _ticket_queries(t), 10)


@query("ticket_by_id", f"""
WITH {_TQ}, i AS (SELECT query_id, unnest(ticket_ids) AS ticket_id FROM tq) SELECT i.query_id, t.ticket_id, t.status, t.category
FROM i JOIN tickets t ON t.ticket_id = i.ticket_id""", "tickets")
def _(t):
    return tk.by_id(t.tickets, _ticket_queries(t).select("query_id", "ticket_ids")).select("query_id", "ticket_id", "status", "category")


_DUAL = f"""{_TQ}, {_FTS}, ex AS (SELECT i.query_id, t.ticket_id FROM (SELECT query_id, unnest(ticket_ids) AS ticket_id FROM tq) i JOIN tickets t USING (ticket_id)),
tx AS (SELECT m.query_id, m.chunk_id AS ticket_id, row_number() OVER (PARTITION BY m.query_id ORDER BY m.score DESC, m.chunk_id) AS r FROM m
 JOIN tq q USING (query_id) JOIN tickets t ON t.ticket_id = m.chunk_id WHERE (q.status IS NULL OR q.status = t.status) AND (q.priority IS NULL OR q.priority = t.priority)
 AND m.query_id NOT IN (SELECT query_id FROM ex) QUALIFY r <= 5),
thin AS (SELECT query_id FROM tq WHERE query_id NOT IN (SELECT query_id FROM ex)
 AND query_id NOT IN (SELECT query_id FROM tx GROUP BY query_id HAVING count(*) >= 2)),
sm AS (SELECT query_id, chunk_id AS ticket_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM b_any QUALIFY r <= 5),
al AS (SELECT query_id, ticket_id, 'exact' AS path, 0 AS p, 0 AS r FROM ex UNION ALL SELECT query_id, ticket_id, 'sql', 1, r FROM tx
 UNION ALL SELECT query_id, ticket_id, 'vector', 2, r FROM sm WHERE query_id IN (SELECT query_id FROM thin)),
on1 AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, ticket_id ORDER BY p, r) = 1)"""


@query("ticket_dual_path", f"""
WITH {_DUAL} SELECT query_id, ticket_id, path, row_number() OVER (PARTITION BY query_id ORDER BY p, r, ticket_id)::INT AS rank FROM on1 QUALIFY rank <= 5""", "tickets")
def _(t):
    q = _ticket_queries(t)
    # any-term hits stand in for vector hits
    held = tk.index_tickets(t.tickets, q, tk.FILTERS)
    similar = tk.search(t.tickets, q, 5, all_terms=False, held=held)
    return tk.dual_path(t.tickets, q, similar, held=held)


@query("ticket_fallback", f"""
WITH {_CASCADE}, {bm25_ctes('tickets', 'ticket_id', _ALL, 'queries', p='z')}, thin AS (SELECT query_id FROM cas WHERE chunks < 3),
zero AS (SELECT s.query_id, s.doc_id FROM scoped s JOIN cas c USING (query_id) WHERE c.level = 0),
nth AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS len FROM chunks),
smp AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM nth
 WHERE list_contains(list_transform(range(0, least(len, 8)), lambda i: floor(i * (len::DOUBLE / least(len, 8)))::BIGINT), pos)),
fin AS (SELECT r.query_id, CAST(chunk_id AS VARCHAR) AS chunk_key, final_score FROM rs r JOIN cas c ON c.query_id = r.query_id AND c.level = r.level
 UNION ALL SELECT query_id, 'outline-' || doc_id, 0.99::DOUBLE FROM zero
 UNION ALL SELECT z.query_id, CAST(s.chunk_id AS VARCHAR), round(0.95::DOUBLE - s.i * 0.001::DOUBLE, 6) FROM zero z JOIN smp s USING (doc_id)),
tb AS (SELECT query_id, chunk_id AS ticket_id FROM z_any QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 3),
tal AS (SELECT * FROM fin UNION ALL SELECT query_id, 'ticket-' || ticket_id, 0.55::DOUBLE FROM tb WHERE query_id IN (SELECT query_id FROM thin))
SELECT query_id, chunk_key, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_key)::INT AS rank FROM tal QUALIFY rank <= 8""",
       "docs chunk_meta queries tickets")
def _(t):
    results, kept = _cascade(t)
    final = results.join(kept.select("query_id", "level"), ["query_id", "level"]).select(
        "query_id", F.col("chunk_id").cast("string").alias("chunk_key"), "final_score").unionByName(
        rt.document_fallback(kept, _scoped(t), t.stored("chunk_meta")))
    found = tk.search(t.tickets, t.queries.select("query_id", "text"), 5, all_terms=False)
    return rt.ticket_fallback(final, kept.filter(F.col("chunks") < 3), found)


_SYM = f"""sq AS (SELECT query_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
 lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND NOT list_contains([{', '.join("'" + w + "'" for w in fixed.SYMPTOM_STOP_WORDS)}], w))[1:8], ' ') AS text FROM tq),
kq AS (SELECT * FROM sq WHERE text <> '')"""
_HITS = f"""{_TQ}, {_SYM}, {bm25_ctes('tickets', 'ticket_id', _ALL, 'kq')},
hit AS (SELECT s.query_id, s.chunk_id AS ticket_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.chunk_id) AS rank FROM b_any s WHERE full_hit QUALIFY rank <= 20),
h AS (SELECT hit.*, t.resolution, t.category FROM hit JOIN tickets t USING (ticket_id))"""


@query("known_issue", f"""
WITH {_HITS} SELECT query_id, count(*) AS ticket_count, count(resolution) AS resolved_count, round(count(resolution) / count(*)::DOUBLE, 2) AS resolution_rate,
 coalesce(arg_min(resolution, ROW(length(resolution), rank)) FILTER (WHERE length(resolution) > 20 AND length(resolution) < 500),
  substr(arg_min(resolution, rank) FILTER (WHERE resolution IS NOT NULL), 1, 300)) AS common_resolution,
 string_agg(ticket_id, ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS similar_tickets FROM h GROUP BY query_id""", "tickets")
def _(t):
    k = tk.known_issue(t.tickets, _ticket_queries(t))
    return k.withColumn("similar_tickets", F.array_join("similar_tickets", ","))


@query("known_issue_categories", f"""
WITH {_HITS}, c AS (SELECT query_id, coalesce(category, 'Unknown') AS v, count(*) AS n FROM h GROUP BY ALL)
SELECT query_id, string_agg(v || '=' || n, ',' ORDER BY v) AS counts FROM c GROUP BY query_id""", "tickets")
def _(t):
    c = tk.known_issue_counts(t.tickets, _ticket_queries(t), "category")
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return c.select("query_id", F.array_join(pairs, ",").alias("counts"))


@query("resolution_stats", """
SELECT category, count(*) AS total, count(*) FILTER (WHERE status IN ('resolved','closed')) AS resolved, count(*) FILTER (WHERE status = 'open') AS n_open,
 count(*) FILTER (WHERE status = 'in_progress') AS n_in_progress, count(*) FILTER (WHERE status = 'resolved') AS n_resolved, count(*) FILTER (WHERE status = 'closed') AS n_closed,
 round(count(*) FILTER (WHERE status IN ('resolved','closed')) / count(*)::DOUBLE, 2) AS resolution_rate FROM tickets GROUP BY category""", "tickets")
def _(t):
    return tk.resolution_stats(t.tickets)


@query("category_breakdown", """
SELECT category, count(*) AS total, count(*) FILTER (WHERE status IN ('resolved','closed')) AS resolved FROM tickets GROUP BY category
ORDER BY total DESC, category LIMIT 10""", "tickets")
def _(t):
    return tk.category_breakdown(t.tickets)


@query("ticket_count", f"""
WITH {TICKET_FILTERS} SELECT f.query_id, count(t.ticket_id) AS tickets FROM tf f LEFT JOIN tickets t ON (f.status IS NULL OR f.status = t.status)
 AND (f.priority IS NULL OR f.priority = t.priority) AND (f.category IS NULL OR f.category = t.category) GROUP BY f.query_id""", "queries tickets")
def _(t):
    q = t.queries.select("query_id", u.ticket_filters(F.col("text")).alias("f")).select("query_id", "f.*")
    return tk.ticket_counts(t.tickets, q)


@query("recent_tickets", f"""
SELECT ticket_id, category, {stamp('created_at')} AS created_at FROM tickets WHERE category = 'Network' ORDER BY tickets.created_at DESC, ticket_id LIMIT 10""", "tickets")
def _(t):
    return tk.recent(t.tickets, 10, "Network").select("ticket_id", "category", F.date_format("created_at", _TS).alias("created_at"))


@query("ticket_answer", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY requester_id ORDER BY created_at DESC, ticket_id) AS rank FROM tickets QUALIFY rank <= 3),
n AS (SELECT requester_id, count(*) AS n FROM r GROUP BY 1)
SELECT requester_id AS query_id, CASE WHEN min(n.n) = 1 THEN min(concat_ws(chr(10), '**Ticket ' || ticket_id || '** — ' || subject, '- Status: ' || coalesce(status, 'unknown'),
 '- Priority: ' || coalesce(priority, 'unknown'), '- Category: ' || coalesce(category, 'unknown'), '- Description: ' || description, '- Resolution: ' || resolution,
 '- Created: ' || {stamp('created_at')})) ELSE 'Found ' || min(n.n) || ' matching tickets:' || chr(10) || string_agg('- **' || ticket_id || '** (' || coalesce(status, 'unknown') || ', '
 || coalesce(priority, 'unknown') || ' priority, ' || coalesce(category, 'unknown') || '): ' || subject, chr(10) ORDER BY rank) END AS answer
FROM r JOIN n USING (requester_id) GROUP BY requester_id""", "tickets")
def _(t):
    from docskein.functions.ranking import top_k

    found = top_k(t.tickets.withColumn("query_id", F.col("requester_id")), ["query_id"], [F.desc("created_at"), F.asc("ticket_id")], 3)
    return tk.answers(found)


@query("known_issue_mining", f"""
WITH s AS (SELECT *, coalesce((list_filter(regexp_extract_all(lower(concat_ws(' ', subject, description)), '[\\p{{L}}\\p{{N}}_]+'),
 lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND NOT list_contains([{', '.join("'" + w + "'" for w in fixed.SYMPTOM_STOP_WORDS)}], w)))[1], '(none)') AS symptom FROM tickets)
SELECT category, symptom, count(*) AS occurrences, count(*) FILTER (WHERE status = 'resolved') AS resolved, round(count(*) FILTER (WHERE status = 'resolved') / count(*)::DOUBLE, 2) AS resolution_rate,
 arg_min(resolution, ROW(length(resolution), ticket_id)) FILTER (WHERE length(resolution) > 20 AND length(resolution) < 500) AS resolution, {stamp('max(created_at)')} AS last_seen
FROM s GROUP BY category, symptom""", "tickets")
def _(t):
    return tk.known_issues(t.tickets).withColumn("last_seen", F.date_format("last_seen", _TS))


@query("known_issue_similar", f"""
WITH x AS (SELECT ticket_id, list_distinct({duck_tokens(_ALL)}) AS w FROM tickets), d AS (SELECT min(ticket_id) AS id, w, count(*) AS copies FROM (SELECT ticket_id, list_sort(w) AS w FROM x) GROUP BY w),
p AS (SELECT a.id, sum(b.copies) AS k FROM d a JOIN d b ON a.id <> b.id AND len(a.w) > 0 AND len(b.w) > 0
 AND len(list_intersect(a.w, b.w)) >= 0.5::DOUBLE * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) GROUP BY a.id)
SELECT x.ticket_id, (CASE WHEN len(x.w) > 0 THEN d.copies - 1 ELSE 0 END + coalesce(p.k, 0))::BIGINT AS similar_count
FROM x JOIN d ON d.w = list_sort(x.w) LEFT JOIN p ON p.id = d.id""", "tickets")
def _(t):
    return tk.similar_counts(t.tickets)
