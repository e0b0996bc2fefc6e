"""Registered context-building and cascade queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.operators import context as cx
from docskein.operators import lexical, scoring
from docskein.plans import retrieval as rt
from docskein.plans.fixtures import AS_OF_DOCS
from docskein.plans.q_ingest import WORDS
from docskein.plans.q_search import AGE, ENTITY, FRESH, SCORED_CTES, SIGMOID, bm25_ctes, duck_tier, scored
from docskein.functions import fixed
from docskein.plans.q_understand import EXPANDED, UNDERSTAND
from docskein.plans.registry import query
from docskein.session import stored


# the graded pair score over the rows of a question, and its logistic
RAW = "(score / max(score) OVER (PARTITION BY query_id) * least(1.0::DOUBLE, overlap * 4.0::DOUBLE) * 6.0::DOUBLE - 3.0::DOUBLE)"
PAIR = SIGMOID.format(x=RAW)


def pack_ctes(source: str, doc_key: str, stale: str = "false") -> str:
    """Greedy packing and the tier-1 guarantee as a recursive walk over ``source`` (query_id, chunk_id, token_count,
    priority_tier, final_score, intent)."""
    return f"""ordered AS (SELECT query_id, chunk_id, {doc_key} AS dk, token_count::BIGINT AS tc, priority_tier AS tier, final_score, intent, {stale} AS stale,
 row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS pos FROM {source} ),
walk AS (SELECT query_id, 0::BIGINT AS pos, 0::BIGINT AS used, []::BIGINT[] AS picked, []::VARCHAR[] AS docs,
  CASE WHEN min(intent) = 'SUMMARIZE' THEN 8192 ELSE 4096 END AS budget, CASE WHEN min(intent) = 'SUMMARIZE' THEN 16 ELSE 8 END AS slots
  FROM ordered GROUP BY query_id
 UNION ALL SELECT query_id, pos, CASE WHEN fits THEN used + tc ELSE used END, CASE WHEN fits THEN list_append(picked, pos) ELSE picked END,
  CASE WHEN fits THEN list_append(docs, dk) ELSE docs END, budget, slots FROM (
  SELECT w.query_id, o.pos, w.used, w.picked, w.docs, w.budget, w.slots, o.tc, o.dk::VARCHAR AS dk,
   len(w.picked) < w.slots AND len(list_filter(w.docs, lambda d: d = o.dk::VARCHAR)) < 3 AND w.used + o.tc <= w.budget AS fits
  FROM walk w JOIN ordered o ON o.query_id = w.query_id AND o.pos = w.pos + 1)),
walked AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) = 1),
chosen AS (SELECT w.query_id, unnest(w.picked) AS pos, generate_subscripts(w.picked, 1) AS no, w.used, w.budget FROM walked w),
c2 AS (SELECT c.*, o.chunk_id, o.tc, o.tier, o.final_score, o.stale FROM chosen c JOIN ordered o ON o.query_id = c.query_id AND o.pos = c.pos),
t1 AS (SELECT query_id, min(pos) AS best FROM ordered WHERE tier = 1 GROUP BY query_id),
low AS (SELECT query_id, arg_min(pos, ROW(final_score, pos)) AS low, min(used) AS used, min(budget) AS budget FROM c2 WHERE tier <> 1 GROUP BY query_id),
sw AS (SELECT l.query_id, l.low, t.best, l.used - o1.tc + o2.tc AS new_used, l.budget FROM low l JOIN t1 t USING (query_id)
 JOIN ordered o1 ON o1.query_id = l.query_id AND o1.pos = l.low JOIN ordered o2 ON o2.query_id = l.query_id AND o2.pos = t.best
 WHERE l.query_id NOT IN (SELECT query_id FROM c2 WHERE tier = 1)),
ok AS (SELECT * FROM sw WHERE new_used <= budget),
final AS (SELECT c.query_id, c.no, coalesce(s.best, c.pos) AS pos, coalesce(s.new_used, c.used) AS used
 FROM c2 c LEFT JOIN ok s ON s.query_id = c.query_id AND s.low = c.pos),
used AS (SELECT w.query_id, coalesce(s.new_used, w.used) AS used FROM walked w LEFT JOIN ok s USING (query_id)),
packed AS (SELECT f.query_id, f.no, o.chunk_id, u.used, o.stale, o.final_score FROM final f JOIN ordered o ON o.query_id = f.query_id AND o.pos = f.pos
 JOIN used u ON u.query_id = f.query_id)"""


_PACK = pack_ctes("top", "doc_id", f"{AGE} > 180")


def _gathered(t):
    s = scoring.select_final(scored(t)).withColumn("doc_key", F.col("doc_id"))
    return cx.gather(s, cx.is_stale(scoring.age_days(F.col("ingested_at"), AS_OF_DOCS)))


@query("context_pack", f"""
WITH RECURSIVE {SCORED_CTES}, {_PACK} SELECT query_id, no::INT AS source_no, o.chunk_id, used::INT AS used_tokens, o.stale FROM c2 o""",
       "vectors feedback")
def _(t):
    rows = cx.picked_rows(cx.pack(_gathered(t), guarantee=False), "used_tokens")
    return rows.select("query_id", "source_no", "chunk_id", "used_tokens", "stale")


@query("tier1_guarantee", f"""
WITH RECURSIVE {SCORED_CTES}, {_PACK} SELECT query_id, no::INT AS source_no, chunk_id, used::INT AS used_tokens FROM packed""",
       "vectors feedback")
def _(t):
    return cx.picked_rows(cx.pack(_gathered(t)), "used_tokens").select(
        "query_id", "source_no", "chunk_id", "used_tokens")


@query("context_pack_simple", f"""
WITH RECURSIVE {SCORED_CTES}, plain AS (SELECT * REPLACE ('SEARCH' AS intent) FROM top), {pack_ctes('plain', 'doc_id')}
SELECT query_id, no::INT AS source_no, chunk_id FROM c2""", "vectors feedback")
def _(t):
    return cx.picked_rows(cx.pack_simple(_gathered(t))).select("query_id", "source_no", "chunk_id")


def _list_ctes(name: str, scores: str) -> str:
    """The list of a question: 20 best chunks that the asker may see, with their rank and raw pair score."""
    return f"""{name}0 AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.chunk_id) AS rank FROM {scores} s
 JOIN chunk_meta m USING (chunk_id) JOIN queries q ON q.query_id = s.query_id
 WHERE m.access_roles IS NULL OR list_has_any(m.access_roles, q.user_roles) QUALIFY rank <= 20),
{name} AS (SELECT query_id, chunk_id, rank, {RAW} AS raw FROM {name}0)"""


_ANSWER = rf"""{UNDERSTAND}, {EXPANDED}, pq AS (SELECT query_id, safe AS text FROM u7),
xq AS (SELECT query_id, expanded[2] AS text FROM x2 WHERE len(expanded) > 1),
{bm25_ctes(queries='pq')}, {bm25_ctes(queries='xq', p='y')}, {_list_ctes('l1', 'b_score')}, {_list_ctes('l2', 'y_score')},
al AS (SELECT query_id, chunk_id, max(raw) AS raw FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY ALL),
r AS (SELECT a.query_id, a.chunk_id, a.raw, m.priority_tier, m.source_file, m.ingested_at, m.content, coalesce(m.repository, m.department) AS repo, u.intent,
 a.entity FROM (SELECT *, round({ENTITY}, 6) AS entity FROM (SELECT al.*, m.department, m.repository, lower(m.content) AS c, lower(m.source_file) AS f, u.repositories, u.departments,
  CASE WHEN u.intent = 'TICKET_LOOKUP' THEN regexp_extract_all(u.safe, '{fixed.TICKET_ID}', 1) ELSE [] END AS ids
  FROM al JOIN chunk_meta m USING (chunk_id) JOIN u7 u USING (query_id))) a JOIN chunk_meta m USING (chunk_id) JOIN u7 u USING (query_id)),
f AS (SELECT *, len({WORDS.format(x='content')}) AS token_count,
 round({SIGMOID.format(x='raw')} + {duck_tier('priority_tier', fixed.TIER_ADDITIVE, 0.0)} + {FRESH} + entity, 6) AS final_score FROM r),
fin AS (SELECT * FROM f WHERE final_score >= 0.38 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id)
 <= CASE intent WHEN 'SUMMARIZE' THEN 16 ELSE 8 END),
{pack_ctes('fin', 'source_file', f'{AGE} > 180')},
blocks AS (SELECT p.query_id, p.no, p.used, p.chunk_id, p.final_score, m.source_file, '[Source ' || p.no || '] ' || m.source_file || ' | General | p.0 | ' || m.repo
 || CASE WHEN p.stale THEN ' [STALE – verify before actioning]' ELSE '' END || chr(10) || m.content AS block FROM packed p JOIN f m USING (query_id, chunk_id))"""


@query("answer_contexts", f"""
WITH RECURSIVE {_ANSWER}, g AS (SELECT query_id, count(*) AS n, max(used) AS used, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY no) AS txt FROM blocks GROUP BY query_id)
SELECT q.query_id, q.text AS question, coalesce(g.n, 0)::INT AS n_chunks, coalesce(g.used, 0)::INT AS used_tokens, coalesce(g.txt, '') AS context_text
FROM queries q LEFT JOIN g USING (query_id)""", "docs chunk_meta queries")
def _(t):
    return rt.answer_contexts(t.stored("chunk_meta"), t.stored("queries"), AS_OF_DOCS).drop("citations")


@query("citations", f"""
WITH RECURSIVE {_ANSWER} SELECT query_id, no::INT AS source_no, chunk_id, source_file AS source, floor((floor(final_score * 1000000::DOUBLE + 0.5::DOUBLE) + 50) / 100::DOUBLE) / 10000::DOUBLE AS score FROM blocks""",
       "docs chunk_meta queries")
def _(t):
    a = rt.answer_contexts(t.stored("chunk_meta"), t.stored("queries"), AS_OF_DOCS)
    return a.select("query_id", F.posexplode("citations").alias("i", "c")).select(
        "query_id", (F.col("i") + 1).alias("source_no"), "c.chunk_id", "c.source", "c.score")


# ------------------------------------------------------------------ cascade
_CASCADE = f"""{bm25_ctes()},
pr AS (SELECT s.query_id, s.chunk_id, s.score, s.overlap, m.doc_id, m.repository, m.department, m.priority_tier, q.scope_doc_ids, q.scope_repository, q.scope_department
 FROM b_score s JOIN chunk_meta m ON m.chunk_id = s.chunk_id JOIN queries q ON q.query_id = s.query_id WHERE (m.access_roles IS NULL OR list_has_any(m.access_roles, q.user_roles))),
lv AS (SELECT *, 1 AS level FROM pr WHERE list_contains(scope_doc_ids, doc_id) UNION ALL SELECT *, 2 FROM pr WHERE repository = scope_repository
 UNION ALL SELECT *, 3 FROM pr WHERE department = scope_department UNION ALL SELECT *, 4 FROM pr),
sh AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY query_id, level ORDER BY score DESC, chunk_id) <= 20),
fs AS (SELECT *, round({PAIR} + {duck_tier('priority_tier', fixed.TIER_ADDITIVE, 0.0)}, 6) AS final_score FROM sh),
rs AS (SELECT * FROM fs WHERE final_score >= 0.38 QUALIFY row_number() OVER (PARTITION BY query_id, level ORDER BY final_score DESC, chunk_id) <= 8),
st AS (SELECT query_id, level, count(*) AS chunks, max(final_score) AS confidence FROM rs GROUP BY ALL),
ds AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
scoped AS (SELECT q.query_id, q.doc_id, ds.n FROM (SELECT query_id, user_roles, unnest(scope_doc_ids) AS doc_id FROM queries) q JOIN ds USING (doc_id)
 JOIN docs m USING (doc_id) WHERE (m.access_roles IS NULL OR list_has_any(m.access_roles, q.user_roles))),
fb AS (SELECT q.query_id, 0 AS level, sum(least(q.n, 8) + 1)::BIGINT AS chunks, 0.95::DOUBLE AS confidence FROM scoped q
 WHERE q.query_id NOT IN (SELECT query_id FROM st WHERE level = 1) GROUP BY q.query_id),
fl AS (SELECT query_id, 4 AS level, 0 AS chunks, 0.0::DOUBLE AS confidence FROM queries WHERE query_id NOT IN (SELECT query_id FROM st WHERE level = 4)),
al AS (SELECT * FROM st UNION ALL SELECT * FROM fb UNION ALL SELECT * FROM fl),
cas AS (SELECT query_id, level, chunks, confidence, confidence < 0.35 AS low_confidence FROM al QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY
 CASE WHEN confidence >= 0.35 THEN 0 ELSE 1 END, CASE WHEN confidence >= 0.35 THEN level ELSE -chunks END, CASE WHEN level = 4 THEN 0 ELSE 1 END, level) = 1)"""


def _cascade_inputs(t):
    return t.stored("queries").withColumns({"repo_hint": F.col("scope_repository"), "dept_hint": F.col("scope_department")})


def _index(t):
    """The stored term index of the chunks, built once per query."""
    if "chunks" not in t.indexes:
        t.indexes["chunks"] = rt.index_corpus(t.stored("chunk_meta"))
    return t.indexes["chunks"]


def _scoped(t):
    return rt.scoped_documents(t.stored("queries"), t.stored("chunk_meta"))


def _cascade(t):
    q = _cascade_inputs(t)
    scoped = stored(_scoped(t), "scoped-documents")
    results = rt.level_results(_index(t), q, t.stored("chunk_meta"), scoped=scoped)
    return results, rt.pick_level(q, results, scoped)


@query("cascade", f"""
WITH {_CASCADE} SELECT query_id, level, CASE level WHEN 0 THEN 'DOCUMENT_FALLBACK' WHEN 1 THEN 'DOCUMENT' WHEN 2 THEN 'REPOSITORY' WHEN 3 THEN 'DEPARTMENT' ELSE 'GLOBAL' END AS label,
 chunks, confidence, low_confidence FROM cas""", "docs chunk_meta queries")
def _(t):
    return _cascade(t)[1]


@query("scope_escape", f"""
WITH {_CASCADE} SELECT c.query_id, c.level, q.scope_doc_ids IS NOT NULL AND c.level <> 1 AS scope_escaped FROM cas c JOIN queries q USING (query_id)""",
       "docs chunk_meta queries")
def _(t):
    picked = _cascade(t)[1].join(t.queries.select("query_id", "scope_doc_ids"), "query_id")
    return cx.scope_escape(picked).select("query_id", "level", "scope_escaped")


@query("low_conf_retry", f"""
WITH {_CASCADE}, s25 AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40),
f25 AS (SELECT *, round({PAIR} + {duck_tier('priority_tier', fixed.TIER_ADDITIVE, 0.0)}, 6) AS final_score FROM s25),
k25 AS (SELECT * FROM f25 WHERE final_score >= 0.38 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) <= 25),
g AS (SELECT query_id, count(*) AS n, max(final_score) AS c FROM k25 GROUP BY query_id),
j AS (SELECT a.*, g.n, g.c, a.low_confidence AND coalesce(g.n, 0) >= a.chunks AS retried FROM cas a LEFT JOIN g USING (query_id))
SELECT query_id, CASE WHEN retried THEN coalesce(n, 0) ELSE chunks END AS chunks, CASE WHEN retried THEN coalesce(c, 0.0::DOUBLE) ELSE confidence END AS confidence, retried FROM j""",
       "docs chunk_meta queries")
def _(t):
    _, kept = _cascade(t)
    # the retry drops every scope and widens both the list and the final k
    weak = _cascade_inputs(t).join(kept.filter("low_confidence").select("query_id"), "query_id", "left_semi")
    again = rt.level_results(_index(t), weak, t.stored("chunk_meta"), list_size=40, k=25, levels=(4,))
    stats = again.groupBy("query_id").agg(F.count("*").alias("chunks"), F.max("final_score").alias("confidence"))
    return rt.low_confidence_retry(kept, stats)


# ------------------------------------------------------------------ documents
@query("doc_chunks", """
WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, chunk_id, chunk_index, source_file FROM chunk_meta),
a AS (SELECT d.doc_id, c.chunk_id, c.chunk_index FROM docs d JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT d.doc_id, c.chunk_id, c.chunk_index FROM docs d JOIN c ON c.source_file = d.source_file WHERE d.doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index NULLS LAST, chunk_id)::INT AS position
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY position <= 500""", "chunk_meta docs")
def _(t):
    # every third document was stored under an id the catalogue does not know
    stored = t.chunk_meta.select(F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"),
                                 "chunk_id", "chunk_index", "source_file")
    return cx.doc_chunks(t.docs.select("doc_id", "source_file"), stored, 500).select("doc_id", "chunk_id", "position")


@query("doc_outline", """
SELECT doc_id, substr(string_agg('- ' || CASE WHEN chunk_index % 2 = 0 THEN 'Part ' || chunk_index ELSE 'Section ' || chunk_index END
 || CASE WHEN chunk_index % 3 = 0 THEN ': about ' || chunk_id ELSE '' END, chr(10) ORDER BY chunk_index), 1, 3000) AS outline FROM chunks GROUP BY doc_id""",
       "chunks")
def _(t):
    i = F.col("chunk_index")
    c = t.chunks.select("doc_id", "chunk_index",
                        F.when(i % 2 == 0, F.concat(F.lit("Part "), i.cast("string"))).alias("section_title"),
                        F.when(i % 3 == 0, F.concat(F.lit("about "), F.col("chunk_id").cast("string"))).alias("chunk_summary"))
    return cx.doc_outline(c, 3000)


@query("even_sample", """
WITH n AS (SELECT doc_id, count(*) AS len FROM chunks GROUP BY doc_id)
SELECT c.doc_id, c.chunk_id FROM chunks c JOIN n USING (doc_id)
WHERE list_contains(list_transform(range(0, least(n.len, 8)), lambda i: floor(i * (n.len::DOUBLE / least(n.len, 8)))::BIGINT), c.chunk_index)""",
       "chunks")
def _(t):
    return cx.even_sample(t.chunks, 8).select("doc_id", "chunk_id")


@query("prompt_assembly", r"""
WITH q AS (SELECT session_id, arg_max(content, turn) AS question FROM messages WHERE role = 'user' GROUP BY session_id),
h AS (SELECT session_id, turn, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(content, 1, 300) AS line FROM messages
 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 4),
g AS (SELECT session_id, string_agg(line, chr(10) ORDER BY turn) || chr(10) || chr(10) AS head FROM h GROUP BY session_id)
SELECT q.session_id, g.head || 'CONTEXT FROM KNOWLEDGE BASE:' || chr(10) || 'context of ' || q.session_id || chr(10) || chr(10) || '---' || chr(10) || 'USER QUESTION: '
 || q.question || chr(10) || chr(10) || 'Answer based only on the context above. Include [Source N] citations.' AS prompt FROM q JOIN g USING (session_id)""", "messages")
def _(t):
    m = t.messages
    asked = m.filter(F.col("role") == "user").groupBy("session_id").agg(F.max_by("content", "turn").alias("question"))
    ctx = asked.withColumn("context_text", F.concat(F.lit("context of "), F.col("session_id").cast("string")))
    return cx.prompts(ctx, m.select("session_id", "turn", "role", "content"), max_chars=300)


@query("fallback_summary", f"""
WITH w AS (SELECT doc_id, {WORDS.format(x='text')} AS w FROM documents)
SELECT doc_id, md5(array_to_string(w[1:120], ' ') || CASE WHEN len(w) > 120 THEN '...' ELSE '' END) AS summary_md5 FROM w""")
def _(t):
    return t.documents.select("doc_id", F.md5(cx.fallback_summary(F.col("text"), 60)).alias("summary_md5"))
