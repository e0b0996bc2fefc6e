"""Registered metrics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.operators import feedback as fb
from docskein.operators import metrics as m
from docskein.plans.fixtures import AS_OF_LOG
from docskein.plans.registry import query, stamp

_BACK = f"ts > TIMESTAMP '{AS_OF_LOG}' - INTERVAL 7 DAY"
_FBACK = f"created_at > TIMESTAMP '{AS_OF_LOG}' - INTERVAL 7 DAY"


def _log(t, days=7):
    return m.lookback(t.query_log, AS_OF_LOG, days)


@query("dashboard_overall", f"""
SELECT count(*) AS total_queries, round(avg(confidence),6) AS avg_confidence, round(avg(latency_ms),6) AS avg_latency_ms,
 round(avg(chunks_retrieved),6) AS avg_chunks, count(*) FILTER (WHERE low_confidence) AS low_confidence_count,
 round(count(*) FILTER (WHERE low_confidence) / count(*)::DOUBLE, 6) AS low_confidence_rate
FROM query_log WHERE {_BACK}""", "query_log")
def _(t):
    return m.dashboard_overall(_log(t))


@query("repo_usage", f"""
SELECT repository, count(*) AS queries FROM (SELECT unnest(repositories_searched) AS repository FROM query_log WHERE {_BACK})
GROUP BY repository""", "query_log")
def _(t):
    return m.repo_usage(_log(t))


@query("daily_queries", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS queries, round(avg(confidence),6) AS avg_confidence
FROM query_log WHERE {_BACK} GROUP BY 1""", "query_log")
def _(t):
    return m.daily_queries(_log(t))


@query("intent_distribution", f"SELECT intent, count(*) AS queries FROM query_log WHERE {_BACK} GROUP BY intent",
       "query_log")
def _(t):
    return m.intent_distribution(_log(t))


@query("recent_queries", """
SELECT user_id, id, query_text, intent, confidence, latency_ms, rn::INT AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM query_log) WHERE rn <= 10""",
       "query_log")
def _(t):
    return m.recent_queries(t.query_log).drop("ts")


@query("lookback_filter", f"SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM query_log WHERE {_BACK}",
       "query_log")
def _(t):
    return _log(t).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_SCORED = f"""scored AS (
 SELECT *, list_concat([coalesce(reranker_top_score,0.0)::DOUBLE], CASE WHEN least(chunks_retrieved,5) > 1
   THEN list_transform(range(1, least(chunks_retrieved,5)), lambda i: greatest(0.0::DOUBLE, confidence - 0.05::DOUBLE * i))
   ELSE [] END) AS top_scores,
  greatest(chunks_retrieved * 3, 5) AS total_candidates FROM query_log WHERE {_BACK})"""


@query("eval_reconstruct", f"""
WITH {_SCORED} SELECT id, array_to_string(list_transform(top_scores, lambda s: CAST(round(s * 100) AS BIGINT)), ',') AS scores,
 total_candidates FROM scored""", "query_log")
def _(t):
    s = m.reconstruct_scores(_log(t))
    cents = F.transform("top_scores", lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return s.select("id", F.array_join(cents, ",").alias("scores"), "total_candidates")


@query("eval_precision_recall", f"""
WITH {_SCORED}, r AS (SELECT len(list_filter(top_scores[1:5], lambda s: s >= 0.5)) AS rel, len(top_scores[1:5]) AS n,
 list_position(list_transform(top_scores[1:5], lambda s: s >= 0.5), true) AS first, total_candidates AS cand FROM scored)
SELECT count(*) AS total_evaluated, round(avg(rel::DOUBLE / n),6) AS precision_at_k,
 round(least(avg(rel) / greatest(avg(cand) * 0.3::DOUBLE, 1.0), 1.0),6) AS recall_at_k,
 round(avg(CASE WHEN first > 0 THEN 1.0::DOUBLE / first ELSE 0.0 END),6) AS mrr,
 round(avg(CASE WHEN rel > 0 THEN 1.0::DOUBLE ELSE 0.0 END),6) AS hit_rate FROM r""", "query_log")
def _(t):
    return m.precision_recall(m.reconstruct_scores(_log(t)))


@query("eval_latency", f"""
WITH o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS rn, count(*) OVER () AS n FROM query_log WHERE {_BACK})
SELECT round(avg(latency_ms),6) AS avg_latency_ms,
 max(CASE WHEN rn = least(floor(n * 0.95::DOUBLE) + 1, n) THEN latency_ms END) AS p95_latency_ms,
 max(CASE WHEN rn = least(floor(n * 0.99::DOUBLE) + 1, n) THEN latency_ms END) AS p99_latency_ms FROM o""", "query_log")
def _(t):
    return m.latency_profile(_log(t))


@query("eval_confidence", f"""
WITH {_SCORED}, b AS (SELECT list_max(top_scores) AS best, low_confidence FROM scored)
SELECT round(avg(best),6) AS avg_confidence, round(avg(low_confidence::INT),6) AS low_confidence_rate,
 count(*) FILTER (WHERE best >= 0.75) AS high, count(*) FILTER (WHERE best >= 0.55 AND best < 0.75) AS medium,
 count(*) FILTER (WHERE best >= 0.35 AND best < 0.55) AS low, count(*) FILTER (WHERE best < 0.35) AS very_low FROM b""",
       "query_log")
def _(t):
    return m.eval_confidence(m.reconstruct_scores(_log(t)))


_SIMPLE = """tail AS (SELECT * FROM query_log ORDER BY ts DESC, id DESC LIMIT 500),
s AS (SELECT *, row_number() OVER (ORDER BY latency_ms) AS rn, count(*) OVER () AS n FROM tail)"""


@query("eval_simple", f"""
WITH {_SIMPLE} SELECT count(*) AS total_evaluated, round(avg((confidence >= 0.5)::INT),6) AS hit_rate,
 round(avg(confidence),6) AS avg_confidence, round(avg(latency_ms),6) AS avg_latency_ms,
 round(avg(low_confidence::INT),6) AS low_confidence_rate,
 count(*) FILTER (WHERE confidence >= 0.75) AS high, count(*) FILTER (WHERE confidence >= 0.50 AND confidence < 0.75) AS medium,
 count(*) FILTER (WHERE confidence >= 0.35 AND confidence < 0.50) AS low, count(*) FILTER (WHERE confidence < 0.35) AS very_low,
 max(CASE WHEN rn = least(floor(n * 0.95::DOUBLE) + 1, n) THEN latency_ms END) AS p95_latency_ms FROM s""", "query_log")
def _(t):
    return m.eval_simple(t.query_log)


@query("bucket_share", f"""
WITH {_SCORED}, b AS (SELECT list_max(top_scores) AS best FROM scored),
k AS (SELECT CASE WHEN best >= 0.75 THEN 'high' WHEN best >= 0.55 THEN 'medium' WHEN best >= 0.35 THEN 'low' ELSE 'very_low' END AS bucket FROM b),
names AS (SELECT unnest(['high','medium','low','very_low']) AS bucket)
SELECT bucket, count(k.bucket) AS n, round(count(k.bucket)::DOUBLE / greatest(sum(count(k.bucket)) OVER (), 1)::DOUBLE, 6) AS share
FROM names LEFT JOIN k USING (bucket) GROUP BY bucket""", "query_log")
def _(t):
    return m.bucket_share(m.eval_confidence(m.reconstruct_scores(_log(t))))


_GAPS = """gaps AS (SELECT * FROM query_log WHERE intent <> 'SMALLTALK' AND (chunks_retrieved < 3 OR confidence < 0.30)),
rolled AS (SELECT md5(lower(trim(query_text))) AS query_hash, count(*) AS frequency, arg_min(query_text, ROW(ts, id)) AS query_text,
 arg_min(intent, ROW(ts, id)) AS intent, max(ts) AS last_seen, min(ts) AS created_at FROM gaps GROUP BY 1),
resolved AS (SELECT DISTINCT md5(lower(trim(query_text))) AS query_hash FROM query_log WHERE chunks_retrieved = 8 AND confidence >= 0.95),
marked AS (SELECT r.*, s.query_hash IS NOT NULL AS resolved FROM rolled r LEFT JOIN resolved s USING (query_hash))"""


def _gaps(t):
    return m.gap_rollup(m.gap_detect(t.query_log))


def _marked(t):
    """A gap counts as resolved once the same question was answered with eight chunks and high confidence."""
    done = t.query_log.filter((F.col("chunks_retrieved") == 8) & (F.col("confidence") >= 0.95)).select(
        m.gap_key(F.col("query_text")).alias("query_hash"))
    return m.gap_resolve(_gaps(t), done)


@query("gap_detect", f"WITH {_GAPS} SELECT id, query_text, intent FROM gaps", "query_log")
def _(t):
    return m.gap_detect(t.query_log).select("id", "query_text", "intent")


@query("gap_rollup", f"""WITH {_GAPS} SELECT query_hash, frequency, query_text, intent, {stamp('last_seen')} AS last_seen,
 {stamp('created_at')} AS created_at FROM rolled""", "query_log")
def _(t):
    f = "yyyy-MM-dd HH:mm:ss"
    return _gaps(t).withColumn("last_seen", F.date_format("last_seen", f)).withColumn(
        "created_at", F.date_format("created_at", f))


@query("gap_resolve", f"WITH {_GAPS} SELECT query_hash, frequency, resolved FROM marked", "query_log")
def _(t):
    return _marked(t).select("query_hash", "frequency", "resolved")


@query("gap_list", f"""WITH {_GAPS} SELECT query_hash, query_text, frequency FROM marked WHERE NOT resolved
ORDER BY frequency DESC, last_seen DESC, query_hash LIMIT 20""", "query_log")
def _(t):
    return m.gap_list(_marked(t)).select("query_hash", "query_text", "frequency")


@query("gap_open_count", f"WITH {_GAPS} SELECT count(*) FILTER (WHERE NOT resolved) AS open_gaps FROM marked", "query_log")
def _(t):
    return m.gap_open_count(_marked(t))


@query("feedback_summary", f"""
SELECT count(*) AS total_feedback, count(*) FILTER (WHERE rating = 1) AS positive, count(*) FILTER (WHERE rating = -1) AS negative,
 round(count(*) FILTER (WHERE rating = 1)::DOUBLE / count(*), 6) AS satisfaction_rate, round(avg(confidence),6) AS avg_confidence
FROM feedback WHERE {_FBACK}""", "feedback")
def _(t):
    return m.feedback_summary(m.lookback(t.feedback, AS_OF_LOG, 7, "created_at"))


@query("top_negative_queries", f"""
SELECT query_text, count(*) AS n FROM feedback WHERE rating = -1 AND {_FBACK} GROUP BY query_text
ORDER BY n DESC, query_text LIMIT 5""", "feedback")
def _(t):
    return m.top_negative_queries(m.lookback(t.feedback, AS_OF_LOG, 7, "created_at"))


BOOSTS_CTE = """steps AS (
 SELECT unnest(cited_chunk_ids) AS chunk_id, generate_subscripts(cited_chunk_ids, 1) AS pos, created_at, feedback_id,
  CASE WHEN rating > 0 THEN 0.02::DOUBLE ELSE -0.01::DOUBLE END AS delta FROM feedback WHERE rating <> 0),
boosts AS (SELECT chunk_id, count(*) AS feedback_count,
 round(list_reduce(list(delta ORDER BY created_at, feedback_id, pos),
  lambda x, d: greatest(-0.05::DOUBLE, least(0.10::DOUBLE, x + d)), 0.0::DOUBLE), 6) AS boost_score FROM steps GROUP BY chunk_id)"""


@query("chunk_boosts", f"WITH {BOOSTS_CTE} SELECT chunk_id, feedback_count, boost_score FROM boosts", "feedback")
def _(t):
    return fb.chunk_boosts(t.feedback)


@query("feedback_boost_join", f"""
WITH {BOOSTS_CTE} SELECT v.chunk_id, coalesce(b.boost_score, 0.0::DOUBLE) AS feedback_boost FROM vectors v
LEFT JOIN (SELECT * FROM boosts WHERE abs(boost_score) > 0.001) b ON b.chunk_id = v.chunk_id""", "feedback vectors")
def _(t):
    return fb.join_boosts(t.vectors.select("chunk_id"), fb.chunk_boosts(t.feedback))


@query("audit_metrics", f"""
SELECT count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'click') AS n_click,
 count(*) FILTER (WHERE event_type = 'signup') AS n_signup, count(*) FILTER (WHERE event_type = 'error') AS n_error
FROM events WHERE {_BACK}""")
def _(t):
    return m.audit_metrics(m.lookback(t.events, AS_OF_LOG, 7), "event_type", ["view", "click", "signup", "error"])


@query("role_union", """
SELECT u.user_id, array_to_string(list_concat(u.access_roles, coalesce(list_filter(g.new, lambda r: NOT list_contains(u.access_roles, r)), [])), ',') AS access_roles
FROM users u LEFT JOIN (SELECT user_id, list_sort(list(DISTINCT resource_name)) AS new FROM access_requests
 WHERE status = 'approved' GROUP BY user_id) g ON g.user_id = u.user_id""", "users access_requests")
def _(t):
    grants = t.access_requests.filter(F.col("status") == "approved")
    return m.role_union(t.users, grants).select("user_id", F.array_join("access_roles", ",").alias("access_roles"))


@query("faq_votes", """
WITH v AS (SELECT user_id, event_id % 20 AS faq_id, CASE WHEN event_type IN ('purchase','click') THEN 1 ELSE -1 END AS vote, ts, event_id FROM events),
l AS (SELECT user_id, faq_id, arg_max(vote, ROW(ts, event_id)) AS vote FROM v GROUP BY ALL)
SELECT faq_id, CAST(sum(vote) AS BIGINT) AS net_votes, count(*) AS voters FROM l GROUP BY faq_id""")
def _(t):
    votes = t.events.select("user_id", (F.col("event_id") % 20).alias("faq_id"), "ts", F.col("event_id").alias("seq"),
                            F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(-1).alias("vote"))
    return m.faq_votes(votes)


@query("latest_draft", f"""
WITH i AS (SELECT event_id AS issue_id, user_id, event_id % 5 AS chat_id, ts AS updated_at,
 CASE event_type WHEN 'view' THEN 'draft' WHEN 'click' THEN 'draft' ELSE 'submitted' END AS status FROM events)
SELECT user_id, chat_id, issue_id, {stamp('updated_at')} AS updated_at FROM i WHERE status = 'draft'
QUALIFY row_number() OVER (PARTITION BY user_id, chat_id ORDER BY updated_at DESC, issue_id DESC) = 1""")
def _(t):
    issues = t.events.select(
        F.col("event_id").alias("issue_id"), "user_id", (F.col("event_id") % 5).alias("chat_id"),
        F.col("ts").alias("updated_at"),
        F.when(F.col("event_type").isin("view", "click"), "draft").otherwise("submitted").alias("status"))
    return m.latest_draft(issues).select(
        "user_id", "chat_id", "issue_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
