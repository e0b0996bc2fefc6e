"""Registered retrieval queries: dense, lexical, fusion, re-ranking and final scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.text import TOKEN, tokens
from docskein.operators import dense, lexical, scoring
from docskein.operators import feedback as fb
from docskein.operators import understand as u
from docskein.operators.filters import scope_kind
from docskein.plans import retrieval as rt
from docskein.plans.fixtures import AS_OF_DOCS
from docskein.plans.q_metrics import BOOSTS_CTE
from docskein.plans.q_understand import UNDERSTAND
from docskein.plans.registry import query
from docskein.session import stored

# ------------------------------------------------------------------ DuckDB building blocks
E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
PAIRS = f"""{E}, pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label AS c_label,
 round(list_dot_product(q.v, c.v), 6) AS cosine FROM e q JOIN e c ON q.vec_id <> c.vec_id)"""
CAND = f"""{PAIRS}, cand0 AS (SELECT query_id, chunk_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id)::INT AS rank
 FROM pairs QUALIFY rank <= 60),
cand AS (SELECT c.query_id, c.chunk_id, c.cosine, c.rank, 8.0::DOUBLE * c.cosine - 1.0::DOUBLE AS raw_score, v.priority_tier, v.doc_id, v.token_count,
 v.department, v.ingested_at, CASE WHEN c.query_id % 5 = 0 THEN 'SUMMARIZE' ELSE 'SEARCH' END AS intent FROM cand0 c JOIN vectors v ON v.chunk_id = c.chunk_id)"""
STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOP_WORDS) + "]"


def duck_tokens(x: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({x}), '{TOKEN}'), "
            f"lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))")


def bm25_ctes(corpus: str = "chunks", key: str = "chunk_id", text: str = "content", queries: str = "queries",
              qtext: str = "text", p: str = "b") -> str:
    return f"""{p}_tok AS (SELECT {key} AS chunk_id, {duck_tokens(text)} AS t FROM {corpus}),
{p}_len AS (SELECT chunk_id, len(t) AS dl FROM {p}_tok), {p}_corpus AS (SELECT count(*) AS n, avg(dl) AS mean FROM {p}_len),
{p}_post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM {p}_tok) GROUP BY ALL),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_post GROUP BY term),
{p}_raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM {p}_df, {p}_corpus),
{p}_idf AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM {p}_raw) ELSE idf END AS idf FROM {p}_raw),
{p}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({duck_tokens(qtext)}) AS term FROM {queries}) GROUP BY ALL),
{p}_nq AS (SELECT query_id, count(*) AS n_terms FROM {p}_q GROUP BY query_id),
{p}_sum AS (SELECT q.query_id, p.chunk_id, round(sum(q.qtf * i.idf * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / c.mean))), 6) AS score,
 count(*) AS hit FROM {p}_q q JOIN {p}_post p ON p.term = q.term JOIN {p}_idf i ON i.term = q.term JOIN {p}_len l ON l.chunk_id = p.chunk_id
 CROSS JOIN {p}_corpus c GROUP BY ALL),
{p}_any AS (SELECT s.query_id, s.chunk_id, s.score, s.hit = n.n_terms AS full_hit, round(s.hit::DOUBLE / n.n_terms, 6) AS overlap FROM {p}_sum s JOIN {p}_nq n USING (query_id)),
{p}_score AS (SELECT query_id, chunk_id, score, overlap FROM {p}_any WHERE score > 0)"""


def duck_tier(col: str, table, default: float) -> str:
    arms = " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in table.items())
    return f"CASE {col} {arms} ELSE {default}::DOUBLE END"


AGE = f"greatest(date_diff('day', ingested_at::DATE, DATE '{AS_OF_DOCS[:10]}'), 0)"
FRESH = f"greatest(-0.08::DOUBLE, -0.01::DOUBLE * floor({AGE} / 30.0::DOUBLE / 6.0::DOUBLE))"
SIGMOID = "round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))), 6)"


STRONG = 0.30  # cosine from which the trace counts a dense hit as strong


# ------------------------------------------------------------------ Spark inputs
def probes(t):
    return t.vectors.select(F.col("chunk_id").alias("query_id"), "embedding")


def candidates(t):
    """Top 60 per stored vector with attributes and a raw pair score."""
    hits = dense.dense_topk(probes(t), t.vectors, 60, exclude_self=True)
    attrs = t.vectors.select("chunk_id", "priority_tier", "doc_id", "token_count", "department", "ingested_at")
    intent = F.when(F.col("query_id") % 5 == 0, "SUMMARIZE").otherwise("SEARCH")
    return hits.join(attrs, "chunk_id").withColumns({
        "raw_score": F.col("cosine") * 8.0 - 1.0, "intent": intent})


def chunk_vectors(t):
    """The stored vectors as three named views, rotated by 0, 1 and 2 positions."""
    def turn(r):
        e = F.col("embedding")
        return F.concat(F.slice(e, r + 1, F.size(e)), F.slice(e, 1, r))

    names = ("content", "question", "summary")
    return t.vectors.select("chunk_id", "priority_tier", F.explode(F.array(*[
        F.struct(F.lit(n).alias("vector_name"), turn(r).alias("embedding")) for r, n in enumerate(names)])).alias("v")
    ).select("chunk_id", "priority_tier", "v.*")


# ------------------------------------------------------------------ dense
@query("dense_topk", f"""
WITH {PAIRS} SELECT query_id, chunk_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id)::INT AS rank
FROM pairs QUALIFY rank <= 20""")
def _(t):
    return dense.dense_topk(probes(t), t.vectors, 20, exclude_self=True)


@query("dense_ann")
def _(t):
    approx = dense.dense_ann(probes(t), t.vectors, 20, exclude_self=True)
    return dense.recall(approx, dense.dense_topk(probes(t), t.vectors, 20, exclude_self=True))


_INTERNAL = f"""{E}, pairs AS (SELECT q.vec_id AS query_id, c.chunk_id, c.doc_origin, round(list_dot_product(q.v, c.embedding::DOUBLE[]), 6) AS cosine FROM e q CROSS JOIN near c),
internal AS (SELECT query_id, chunk_id, cosine FROM (SELECT *, row_number() OVER
 (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS r FROM pairs WHERE doc_origin = 'INTERNAL') WHERE r <= 15 AND cosine >= 0.70)"""


@query("min_score_pass", f"WITH {_INTERNAL} SELECT query_id, chunk_id, cosine FROM internal", "near")
def _(t):
    return dense.internal_pass(probes(t), t.near).select("query_id", "chunk_id", "cosine")


_DUAL = f"""{_INTERNAL}, enough AS (SELECT query_id FROM internal GROUP BY query_id HAVING count(*) >= 3),
fullp AS (SELECT query_id, chunk_id, cosine FROM pairs WHERE query_id NOT IN (SELECT query_id FROM enough)
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) <= 20),
dual AS (SELECT *, 'dense_internal' AS source FROM internal UNION ALL SELECT *, 'dense' FROM fullp)"""


@query("dual_pass", f"WITH {_DUAL} SELECT query_id, chunk_id, cosine, source FROM dual", "near")
def _(t):
    return dense.dual_pass(probes(t), t.near)


@query("dedup_best_score", f"""
WITH {_DUAL}, b AS (SELECT query_id, chunk_id, max(cosine) AS cosine, arg_max(source, ROW(cosine, source)) AS source FROM dual GROUP BY ALL)
SELECT query_id, chunk_id, cosine, source, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id)::INT AS rank FROM b QUALIFY rank <= 20""", "near")
def _(t):
    return dense.best_per_chunk(dense.dual_pass(probes(t), t.near), 20).select(
        "query_id", "chunk_id", "cosine", "source", "rank")


_VIEWS3 = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
cv AS (SELECT vec_id, 'content' AS vector_name, v FROM e UNION ALL SELECT vec_id, 'question', list_concat(v[2:], v[1:1]) FROM e
 UNION ALL SELECT vec_id, 'summary', list_concat(v[3:], v[1:2]) FROM e),
mv AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.vector_name, round(list_dot_product(q.v, c.v), 6) AS cosine
 FROM e q JOIN cv c ON q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, vector_name ORDER BY cosine DESC, chunk_id)::INT AS rank FROM mv QUALIFY rank <= 20)"""


@query("multi_view_search", f"WITH {_VIEWS3} SELECT query_id, vector_name, chunk_id, cosine, rank FROM ranked")
def _(t):
    return dense.multi_view_search(probes(t), chunk_vectors(t), ["content", "question", "summary"], 20, exclude_self=True)


@query("rrf_fuse", f"""
WITH {_VIEWS3}, w AS (SELECT query_id, chunk_id, CASE vector_name WHEN 'content' THEN 0 WHEN 'question' THEN 1 ELSE 2 END AS no,
 CASE vector_name WHEN 'content' THEN 'dense' WHEN 'question' THEN 'question' ELSE 'bm25' END AS source,
 CASE vector_name WHEN 'summary' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank) AS w FROM ranked),
g AS (SELECT query_id, chunk_id, sum(w) AS w, string_agg(source, '+' ORDER BY no) AS sources FROM w GROUP BY ALL)
SELECT g.query_id, g.chunk_id, g.sources, round(g.w * {duck_tier('v.priority_tier', fixed.TIER_RRF_BOOST, 1.0)}, 9) AS rrf_score
FROM g JOIN vectors v ON v.chunk_id = g.chunk_id""", "vectors")
def _(t):
    # read three times, searched once
    mv = stored(dense.multi_view_search(probes(t), chunk_vectors(t), ["content", "question", "summary"], 20, exclude_self=True), "ranked")
    pick = lambda v: mv.filter(F.col("vector_name") == v)
    return scoring.rrf_fuse([("dense", pick("content")), ("question", pick("question")), ("bm25", pick("summary"))], t.vectors)


# ------------------------------------------------------------------ lexical
@query("tokenise", f"SELECT doc_id, array_to_string({duck_tokens('text')}, ' ') AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query("bm25_index", f"""
WITH {bm25_ctes()} SELECT p.term, i.df, round(i.idf, 6) AS idf, sum(p.tf)::BIGINT AS tf, sum(l.dl)::BIGINT AS dl, sum(p.chunk_id)::BIGINT AS chunk_sum
FROM b_post p JOIN b_len l USING (chunk_id) JOIN b_idf i USING (term) GROUP BY ALL""", "chunks queries")
def _(t):
    index = lexical.index_chunks(t.stored("chunks"))
    per_term = index.postings.groupBy("term").agg(
        F.sum("tf").alias("tf"), F.sum("dl").alias("dl"), F.sum("chunk_id").alias("chunk_sum"))
    return per_term.join(index.terms, "term").withColumn("idf", F.round("idf", 6))


_KIND = """CASE WHEN scope_doc_ids IS NOT NULL THEN 'DOC' WHEN scope_repository IS NOT NULL THEN 'REPOSITORY'
 WHEN scope_department IS NOT NULL THEN 'DEPARTMENT' ELSE 'GLOBAL' END"""


@query("bm25_search", f"""
WITH {bm25_ctes()}, q AS (SELECT *, {_KIND} AS kind FROM queries),
s AS (SELECT s.query_id, s.chunk_id, s.score FROM b_score s JOIN chunk_meta m ON m.chunk_id = s.chunk_id JOIN q ON q.query_id = s.query_id
 WHERE (m.access_roles IS NULL OR list_has_any(m.access_roles, q.user_roles)) AND CASE q.kind
  WHEN 'DOC' THEN list_contains(q.scope_doc_ids, m.doc_id) WHEN 'REPOSITORY' THEN coalesce(m.repository = q.scope_repository, false)
  WHEN 'DEPARTMENT' THEN m.department = q.scope_department ELSE true END)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 20""",
       "chunk_meta queries")
def _(t):
    q = t.stored("queries")
    kind = scope_kind(F.col("scope_doc_ids"), F.col("scope_repository"), F.col("scope_department"))
    level = F.when(kind == "DOC", 1).when(kind == "REPOSITORY", 2).when(kind == "DEPARTMENT", 3)
    hinted = q.withColumns({"repo_hint": F.col("scope_repository"), "dept_hint": F.col("scope_department")})
    due = hinted.withColumn("must", F.filter(F.array(lexical.role_demand(F.col("user_roles")), rt.scope_demand(level)),
                                             lambda x: x.isNotNull()))
    return lexical.search(rt.index_corpus(t.stored("chunk_meta")), due, 20, must="must").drop("overlap")


# ------------------------------------------------------------------ scores
_POOL = f"""{CAND}, pool AS (SELECT *, {SIGMOID.format(x='raw_score')} AS rerank_score FROM cand
 WHERE rank <= CASE intent WHEN 'SUMMARIZE' THEN 60 ELSE 44 END)"""
_SCORED = f"""{_POOL}, {BOOSTS_CTE}, scored AS (SELECT p.*, {FRESH} AS freshness,
 coalesce(CASE WHEN abs(b.boost_score) > 0.001 THEN b.boost_score END, 0.0::DOUBLE) AS feedback_boost FROM pool p LEFT JOIN boosts b ON b.chunk_id = p.chunk_id),
fin AS (SELECT *, round(rerank_score + {duck_tier('priority_tier', fixed.TIER_ADDITIVE, 0.0)} + freshness + feedback_boost, 6) AS final_score FROM scored),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id)::INT AS final_rank FROM fin WHERE final_score >= 0.38
 QUALIFY final_rank <= CASE intent WHEN 'SUMMARIZE' THEN 16 ELSE 8 END)"""
SCORED_CTES = _SCORED


def pooled(t):
    # the fused score of these candidates is their cosine
    return scoring.rerank_pool(candidates(t).withColumn("rrf_score", F.col("cosine"))).withColumn(
        "rerank_score", scoring.logistic(F.col("raw_score")))


def scored(t):
    p = pooled(t).withColumn("freshness", scoring.freshness_decay(scoring.age_days(F.col("ingested_at"), AS_OF_DOCS)))
    return scoring.add_final_score(fb.join_boosts(p, fb.chunk_boosts(t.feedback)))


@query("sigmoid_rerank", f"WITH {_POOL} SELECT query_id, chunk_id, rerank_score FROM pool", "vectors")
def _(t):
    return pooled(t).select("query_id", "chunk_id", "rerank_score")


@query("freshness_decay", f"SELECT doc_id, {AGE} AS age_days, {FRESH} AS freshness FROM docs", "docs")
def _(t):
    age = scoring.age_days(F.col("ingested_at"), AS_OF_DOCS)
    return t.docs.select("doc_id", age.cast("bigint").alias("age_days"), scoring.freshness_decay(age).alias("freshness"))


ENTITY = """least(0.30::DOUBLE, CASE WHEN list_contains(departments, department) THEN 0.08::DOUBLE + 0.15::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN list_contains(repositories, repository) THEN 0.12::DOUBLE + 0.20::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN len(list_filter(ids, lambda x: contains(c, lower(x)) OR contains(f, lower(x)))) > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)"""


@query("entity_boost", f"""
WITH {bm25_ctes()}, {UNDERSTAND}, top AS (SELECT s.query_id, s.chunk_id FROM b_score s JOIN chunk_meta m USING (chunk_id) JOIN queries q USING (query_id)
 WHERE m.access_roles IS NULL OR list_has_any(m.access_roles, q.user_roles) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20),
j AS (SELECT t.query_id, t.chunk_id, m.department, m.repository, lower(m.content) AS c, lower(m.source_file) AS f, u.repositories, u.departments,
 CASE WHEN u.intent = 'TICKET_LOOKUP' THEN regexp_extract_all(u.safe, '{fixed.TICKET_ID}', 1) ELSE [] END AS ids
 FROM top t JOIN chunk_meta m ON m.chunk_id = t.chunk_id JOIN u7 u ON u.query_id = t.query_id)
SELECT query_id, chunk_id, round({ENTITY}, 6) AS entity_boost FROM j""",
       "chunk_meta queries")
def _(t):
    chunks, asked = t.stored("chunk_meta"), t.stored("queries")
    due = asked.select("query_id", "text", F.array(lexical.role_demand(F.col("user_roles"))).alias("must"))
    hits = lexical.search(rt.index_corpus(chunks), due, 20, must="must").select("query_id", "chunk_id")
    q = u.understand(t.stored("queries")).select("query_id", "departments", "repositories", "ticket_ids", "repository_weight",
                                       "department_weight")
    m = t.stored("chunk_meta").select("chunk_id", "department", "repository", "content", "source_file")
    j = hits.join(m, "chunk_id").join(q, "query_id")
    return j.select("query_id", "chunk_id", scoring.entity_boost(
        F.col("department"), F.col("repository"), F.col("content"), F.col("source_file")).alias("entity_boost"))


@query("final_score", f"WITH {_SCORED} SELECT query_id, chunk_id, final_score, final_rank FROM top", "vectors feedback")
def _(t):
    return scoring.select_final(scored(t)).select("query_id", "chunk_id", "final_score", "final_rank")


@query("retrieval_confidence", f"""
WITH {_SCORED} SELECT q.vec_id AS query_id, coalesce(max(t.final_score), 0.0::DOUBLE) AS confidence, coalesce(max(t.final_score), 0.0) < 0.35 AS low_confidence,
 count(t.chunk_id) AS chunks, count(t.chunk_id) < 3 AS chunk_count_low FROM embeddings q LEFT JOIN top t ON t.query_id = q.vec_id GROUP BY q.vec_id""",
       "vectors feedback")
def _(t):
    return scoring.confidence(probes(t), scoring.select_final(scored(t)))


@query("retrieval_trace", f"""
WITH {_SCORED}, n AS (SELECT query_id, count(*) AS n_dense, count(*) FILTER (WHERE cosine >= 0.30) AS n_strong FROM cand GROUP BY query_id),
s AS (SELECT query_id, count(*) AS reranked, max(rerank_score) AS rerank_max, min(rerank_score) AS rerank_min, round(sum(rerank_score), 6) AS rerank_total,
 count(*) FILTER (WHERE final_score < 0.38) AS below_threshold FROM fin GROUP BY query_id)
SELECT q.vec_id AS query_id, coalesce(n_dense, 0) AS n_dense, coalesce(n_strong, 0) AS n_strong, coalesce(reranked, 0) AS reranked,
 coalesce(rerank_max, 0.0::DOUBLE) AS rerank_max, coalesce(rerank_min, 0.0::DOUBLE) AS rerank_min, coalesce(rerank_total, 0.0::DOUBLE) AS rerank_total,
 coalesce(below_threshold, 0) AS below_threshold FROM embeddings q LEFT JOIN n ON n.query_id = q.vec_id LEFT JOIN s ON s.query_id = q.vec_id""",
       "vectors feedback")
def _(t):
    c = candidates(t).select("query_id", "chunk_id", "cosine")
    out = scoring.trace(probes(t), {"dense": c, "strong": c.filter(F.col("cosine") >= STRONG)}, scored(t))
    return out.withColumn("rerank_total", F.round(F.col("rerank_avg") * F.col("reranked"), 6)).drop("rerank_avg")


@query("answer_confidence", f"""
WITH {_SCORED}, a AS (SELECT query_id, max(rerank_score) AS top_score, count(*) AS candidates FROM fin GROUP BY query_id),
b AS (SELECT query_id, count(*) AS used, max(final_score) - min(final_score) AS spread FROM top GROUP BY query_id),
c AS (SELECT a.query_id, least(top_score, 1.0::DOUBLE) AS r, CASE WHEN candidates >= 20 THEN 1.0::DOUBLE WHEN candidates >= 10 THEN 0.75 WHEN candidates >= 5 THEN 0.50 WHEN candidates >= 2 THEN 0.30 ELSE 0.0 END AS g,
 CASE WHEN used / 8.0::DOUBLE >= 0.75 THEN 1.0::DOUBLE WHEN used / 8.0::DOUBLE >= 0.5 THEN 0.75 WHEN used / 8.0::DOUBLE >= 0.25 THEN 0.50 ELSE 0.20 END
  * CASE WHEN used >= 2 AND spread > 0.40 THEN 0.85::DOUBLE ELSE 1.0 END AS f FROM a LEFT JOIN b USING (query_id)),
d AS (SELECT query_id, round_even(round(least(0.5::DOUBLE * r + 0.3::DOUBLE * g + 0.2::DOUBLE * f, 1.0), 9), 3) AS overall FROM c)
SELECT query_id, overall, CASE WHEN overall >= 0.75 THEN 'HIGH' WHEN overall >= 0.55 THEN 'MEDIUM' WHEN overall >= 0.35 THEN 'LOW' ELSE 'VERY_LOW' END AS label FROM d""",
       "vectors feedback")
def _(t):
    s = scored(t)
    a = s.groupBy("query_id").agg(F.max("rerank_score").alias("top_score"), F.count("*").alias("candidates"))
    b = scoring.select_final(s).groupBy("query_id").agg(
        F.count("*").alias("chunks_used"), (F.max("final_score") - F.min("final_score")).alias("spread"))
    rows = a.join(b, "query_id", "left").na.fill(0, ["chunks_used"]).na.fill(0.0, ["spread"])
    return scoring.answer_confidence(rows).select("query_id", "overall", "label")
