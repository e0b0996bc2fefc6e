"""Registered query-understanding queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.operators import understand as u
from docskein.plans.registry import query


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(patterns):
    return "(" + " OR ".join(f"regexp_matches(low, {lit(p)})" for p in patterns) + ")"


def _rules():
    arms = []
    for name, patterns in fixed.INTENT_RULES:
        cond = _any(patterns)
        if name == "TICKET_ANALYTICS_FOLLOW_UP":
            cond, name = f"({cond} AND NOT regexp_matches(low, {lit(fixed.FIRST_PERSON)}))", "TICKET_ANALYTICS"
        arms.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(arms) + " END"


def _hits(words):
    return "(" + " + ".join(f"contains(low, {lit(w)})::INT" for w in words) + ")"


_SIG = "[" + ", ".join(
    f"{{'score': CASE WHEN {_hits(ws)} > 0 THEN round(least(0.50::DOUBLE + {_hits(ws)} * 0.12::DOUBLE, 0.85::DOUBLE), 6) END, 'tie': {-i}, 'intent': '{n}'}}"
    for i, (n, ws) in enumerate(fixed.INTENT_SIGNALS)) + "]"


def _names(table):
    items = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {lit(k)})' for k in ks)} THEN '{n}' END" for n, ks in table)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _syn(table, low):
    arms = " ".join(f"WHEN contains({low}, {lit(k)}) THEN [{', '.join(lit(s) for s in ss[:3])}]" for k, ss in table)
    return f"CASE {arms} ELSE [] END"


def _distinct(x):
    return f"list_reduce({x}, lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END, []::VARCHAR[])"


UNDERSTAND = rf"""u1 AS (SELECT query_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS cleaned FROM queries),
u2 AS (SELECT *, regexp_replace(cleaned, {lit(fixed.QUERY_EMAIL)}, '<EMAIL_REDACTED>', 'g') AS nomail FROM u1),
u3 AS (SELECT *, regexp_replace(nomail, {lit(fixed.QUERY_PHONE)}, '<PHONE_REDACTED>', 'g') AS safe,
 array_to_string(list_filter([CASE WHEN regexp_matches(cleaned, {lit(fixed.QUERY_EMAIL)}) THEN 'email' END,
  CASE WHEN regexp_matches(nomail, {lit(fixed.QUERY_PHONE)}) THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS pii_types FROM u2),
u4 AS (SELECT *, lower(safe) AS low FROM u3),
u5 AS (SELECT *, {_rules()} AS rule, list_filter({_SIG}, lambda s: s.score IS NOT NULL) AS sigs FROM u4),
u6 AS (SELECT *, list_max(sigs) AS sig FROM u5),
u7 AS (SELECT *, coalesce(rule, sig.intent, 'SEARCH') AS intent,
 CASE WHEN rule IS NOT NULL THEN 0.92::DOUBLE WHEN sig IS NOT NULL THEN sig.score ELSE 0.95::DOUBLE END AS intent_confidence,
 CASE WHEN rule IS NOT NULL THEN false WHEN sig IS NOT NULL THEN sig.score < 0.70 ELSE true END AS low_confidence,
 {_names(fixed.REPOSITORY_WORDS)} AS repositories, {_names(fixed.DEPARTMENT_WORDS)} AS departments FROM u6)"""


def _base(t):
    return u.understand(t.queries)


@query("normalise_query", f"WITH {UNDERSTAND} SELECT query_id, cleaned FROM u1", "queries")
def _(t):
    return u.normalise(t.queries).select("query_id", "cleaned")


@query("query_pii_scrub", f"WITH {UNDERSTAND} SELECT query_id, safe, pii_types FROM u3", "queries")
def _(t):
    return u.scrub(u.normalise(t.queries)).select("query_id", "safe", F.array_join("pii_types", ",").alias("pii_types"))


@query("intent_rules", f"WITH {UNDERSTAND} SELECT query_id, coalesce(rule, '') AS rule FROM u7", "queries")
def _(t):
    q = u.scrub(u.normalise(t.queries))
    return q.select("query_id", F.coalesce(u.intent_rule(F.lower("safe")), F.lit("")).alias("rule"))


@query("intent_signals", f"""
WITH {UNDERSTAND} SELECT query_id, coalesce(sig.intent, '') AS best, coalesce(sig.score, 0.0::DOUBLE) AS score,
 intent, intent_confidence, low_confidence FROM u7""", "queries")
def _(t):
    q = u.intents(u.scrub(u.normalise(t.queries))).withColumn("s", u.intent_signal(F.lower("safe")))
    return q.select("query_id", F.coalesce("s.intent", F.lit("")).alias("best"), F.coalesce("s.score", F.lit(0.0)).alias("score"),
                    "intent", "intent_confidence", "low_confidence")


@query("needs_clarification", f"WITH {UNDERSTAND} SELECT query_id, intent_confidence < 0.55 AS ask FROM u7", "queries")
def _(t):
    return u.intents(u.scrub(u.normalise(t.queries))).select("query_id", F.col("needs_clarification").alias("ask"))


@query("extract_ticket_ids", f"""
WITH {UNDERSTAND} SELECT query_id, array_to_string(regexp_extract_all(safe, {lit(fixed.TICKET_ID)}, 1), ',') AS ids FROM u7""", "queries")
def _(t):
    return u.scrub(u.normalise(t.queries)).select("query_id", F.array_join(u.ticket_ids(F.col("safe")), ",").alias("ids"))


@query("structural_filters", f"""
WITH {UNDERSTAND} SELECT query_id, CASE WHEN intent = 'TICKET_LOOKUP' THEN 'Ticket' END AS doc_type_filter,
 CASE WHEN intent = 'TICKET_LOOKUP' THEN array_to_string(regexp_extract_all(safe, {lit(fixed.TICKET_ID)}, 1), ',') ELSE '' END AS ids FROM u7""",
       "queries")
def _(t):
    return _base(t).select("query_id", "doc_type_filter", F.array_join("ticket_ids", ",").alias("ids"))


@query("soft_weights", f"""
WITH {UNDERSTAND} SELECT query_id, array_to_string(repositories, ',') AS repositories, array_to_string(departments, ',') AS departments,
 round(len(repositories) * 0.20::DOUBLE, 6) AS repository_weight, round(len(departments) * 0.15::DOUBLE, 6) AS department_weight FROM u7""",
       "queries")
def _(t):
    total = lambda m: F.round(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x), 6)
    return _base(t).select("query_id", F.array_join("repositories", ",").alias("repositories"),
                           F.array_join("departments", ",").alias("departments"),
                           total("repository_weight").alias("repository_weight"),
                           total("department_weight").alias("department_weight"))


EXPANDED = f"""x1 AS (SELECT *, {_syn(fixed.EXPANSIONS, 'low')} AS syn FROM u7),
x2 AS (SELECT *, list_concat([safe], list_filter(syn, lambda s: NOT contains(low, s))) AS expanded FROM x1)"""


@query("expand_query", f"WITH {UNDERSTAND}, {EXPANDED} SELECT query_id, array_to_string(expanded[1:4], ' | ') AS expanded FROM x2", "queries")
def _(t):
    return _base(t).select("query_id", F.array_join("expanded", " | ").alias("expanded"))


@query("expand_query_repo", f"""
WITH {UNDERSTAND}, x AS (SELECT *, list_concat([safe], {_syn(fixed.REPOSITORY_EXPANSIONS, 'low')},
 CASE WHEN len(repositories) = 1 AND NOT contains(low, lower(repositories[1])) THEN [lower(repositories[1]) || ' ' || safe] ELSE [] END) AS e FROM u7)
SELECT query_id, array_to_string(e[1:5], ' | ') AS expanded FROM x""", "queries")
def _(t):
    q = _base(t)
    return q.select("query_id", F.array_join(u.expand_with_repository(F.col("safe"), F.col("repositories")), " | ").alias("expanded"))


def _half(pattern, group):
    return f"trim(regexp_extract(safe, {lit('(?is)^(.*?)' + pattern + '(.*)$')}, {group}))"


DECOMPOSED = rf"""d1 AS (SELECT *, {_half(fixed.COMPARISONS, 1)} AS c1, {_half(fixed.COMPARISONS, 3)} AS c2,
 {_half(fixed.CONJUNCTIONS, 1)} AS j1, {_half(fixed.CONJUNCTIONS, 3)} AS j2,
 len(list_filter(regexp_split_to_array(safe, '\s+'), lambda v: v <> '')) AS n FROM x2),
d2 AS (SELECT *, CASE WHEN regexp_matches(low, {lit(fixed.COMPARISONS)}) AND length(c1) > 5 AND length(c2) > 5 THEN [c1, c2]
 WHEN regexp_matches(low, {lit(fixed.CONJUNCTIONS)}) AND n > 12 AND length(j1) > 5 AND length(j2) > 5 THEN [j1, j2] ELSE [] END AS sub FROM d1)"""


@query("decompose_query", f"WITH {UNDERSTAND}, {EXPANDED}, {DECOMPOSED} SELECT query_id, len(sub)::INT AS parts, array_to_string(sub, ' | ') AS sub FROM d2",
       "queries")
def _(t):
    return _base(t).select("query_id", F.size("sub_queries").alias("parts"), F.array_join("sub_queries", " | ").alias("sub"))


def _route():
    arms = []
    for i, (repo, kws) in enumerate(fixed.ROUTING_WORDS):
        depts = [d for d, r in fixed.DEPARTMENT_REPOSITORY.items() if r == repo]
        named = " + ".join(["0"] + [f"CASE WHEN list_contains(departments, '{d}') THEN 3 ELSE 0 END" for d in depts])
        arms.append(f"SELECT query_id, {_hits(kws)} + {named} AS score, CASE WHEN {_hits(kws)} > 0 THEN 0 ELSE 1 END AS late, {i} AS ordinal, '{repo}' AS repository FROM u7")
    return " UNION ALL ".join(arms)


@query("route_repositories", f"""
WITH {UNDERSTAND}, r AS ({_route()})
SELECT query_id, repository, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, late, ordinal)::INT AS rank
FROM r WHERE score > 0 QUALIFY rank <= 2""", "queries")
def _(t):
    return u.route_repositories(_base(t))


_AMBIG = rf"""(len(list_filter(regexp_split_to_array(cleaned, '\s+'), lambda v: v <> '')) <= 3 OR
 CASE WHEN len(regexp_extract_all(lower(cleaned), '[a-z'']+')) > 0 THEN
  len(list_filter(regexp_extract_all(lower(cleaned), '[a-z'']+'), lambda w: list_contains([{', '.join(lit(w) for w in fixed.VAGUE_WORDS)}], w)))::DOUBLE
   / len(regexp_extract_all(lower(cleaned), '[a-z'']+')) >= 0.3 ELSE false END)"""


@query("ambiguous_query", f"WITH {UNDERSTAND} SELECT query_id, {_AMBIG} AS ambiguous FROM u7", "queries")
def _(t):
    return u.normalise(t.queries).select("query_id", u.ambiguous(F.col("cleaned")).alias("ambiguous"))


@query("hyde_trigger", rf"""
WITH {UNDERSTAND}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
f AS (SELECT q.vec_id, max(round(list_dot_product(q.v, c.v), 6)) AS cosine FROM e q JOIN e c ON c.label % 2 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id)
SELECT u7.query_id, coalesce(f.cosine, 0.0::DOUBLE) AS first_pass_score,
 coalesce(f.cosine, 0.0) < 0.70 OR {_AMBIG} OR len(list_filter(regexp_split_to_array(cleaned, '\s+'), lambda v: v <> '')) < 5 AS use_passage
FROM u7 LEFT JOIN f ON f.vec_id = u7.query_id // 1000""", "queries")
def _(t):
    from docskein.operators.dense import dense_topk

    # the stored vector with the conversation's number stands in for the question's embedding
    corpus = t.vectors.filter(F.col("doc_origin") == "INTERNAL").select("chunk_id", "embedding")
    probes = t.vectors.select(F.col("chunk_id").alias("query_id"), "embedding")
    best = dense_topk(probes, corpus, 1, exclude_self=True).select(F.col("query_id").alias("conv"), "cosine")
    q = u.normalise(t.queries).withColumn("conv", F.floor(F.col("query_id") / 1000))
    first = q.join(best, "conv").select("query_id", "cosine")
    return u.hyde_trigger(q, first).select("query_id", "first_pass_score", "use_passage")


@query("query_fanout", f"""
WITH {UNDERSTAND}, {EXPANDED}, {DECOMPOSED}, f AS (SELECT query_id, list_concat([cleaned], (expanded[1:4])[2:3], sub[1:2]) AS all_ FROM d2),
p AS (SELECT query_id, unnest(all_) AS text, generate_subscripts(all_, 1) AS pos FROM f),
m AS (SELECT query_id, text, min(pos) AS pos FROM p GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1)::INT AS variant, text FROM m""", "queries")
def _(t):
    texts = u.fanout(F.col("cleaned"), F.col("expanded"), F.col("sub_queries"))
    return _base(t).select("query_id", F.posexplode(texts).alias("variant", "text"))


def _first(table):
    arms = " ".join(f"WHEN regexp_matches(low, {lit(chr(92) + 'b' + re.escape(w) + chr(92) + 'b')}) THEN '{v}'" for w, v in table)
    return f"CASE {arms} END"


TICKET_FILTERS = f"""tf AS (SELECT query_id, {_first(fixed.FILTER_STATUS)} AS status, {_first(fixed.FILTER_PRIORITY)} AS priority,
 {_first(fixed.FILTER_CATEGORY)} AS category FROM (SELECT query_id, lower(text) AS low FROM queries))"""


@query("ticket_query_filters", f"WITH {TICKET_FILTERS} SELECT * FROM tf", "queries")
def _(t):
    return t.queries.select("query_id", u.ticket_filters(F.col("text")).alias("f")).select("query_id", "f.*")


@query("describe_filters", f"""
WITH {TICKET_FILTERS} SELECT query_id, concat_ws(' ', lower(priority) || ' priority', replace(status, '_', ' '), 'tickets', 'in ' || category) AS label FROM tf""",
       "queries")
def _(t):
    f = t.queries.select("query_id", u.ticket_filters(F.col("text")).alias("f"))
    return f.select("query_id", u.describe_filters(F.col("f")).alias("label"))
