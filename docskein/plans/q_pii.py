"""Registered pseudonymisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.operators import pii
from docskein.operators.enrich import ingest_summary
from docskein.plans.registry import query
from docskein.sources.store import insert_ignore


def _ctes(source: str, skip: str = "false", extra: str = "") -> str:
    """The eight replacements as chained CTEs; DuckDB has no replace-with-callback, so split and zip as well."""
    out = [f"p0 AS (SELECT doc_id{extra}, text, []::STRUCT(pii_type VARCHAR, token VARCHAR, value VARCHAR)[] AS hits, {skip} AS skip FROM {source})"]
    for i, (kind, prefix, pattern) in enumerate(fixed.PII_PATTERNS):
        p = "'" + pattern.replace("'", "''") + "'"
        off = " AND NOT skip" if kind in fixed.TECHNICAL_TYPES else ""
        out.append(
            f"f{i} AS (SELECT *, CASE WHEN regexp_matches(text, {p}){off} THEN list_transform(regexp_extract_all(text, {p}), "
            f"lambda v: {{'pii_type': '{kind}', 'token': '{prefix}_HASH_' || upper(substr(sha256('docskein' || "
            r"lower(regexp_replace(v, '^\s+|\s+$', '', 'g'))), 1, 6)), 'value': v}) ELSE [] END AS h FROM p" + f"{i})")
        out.append(
            f"p{i + 1} AS (SELECT doc_id{extra}, CASE WHEN len(h) > 0 THEN array_to_string(list_transform(regexp_split_to_array(text, {p}), "
            "lambda g, j: g || coalesce(h[j].token, '')), '') ELSE text END AS text, list_concat(hits, h) AS hits, skip FROM "
            f"f{i})")
    out.append("red AS (SELECT * FROM p8)")
    return ",\n".join(out)


_PLAIN = _ctes("documents")
_TECH = "department IN ('IT','Engineering') OR doc_type = 'Runbook'"


def _redacted(t):
    return pii.pseudonymise(t.documents.select("doc_id", "text"))


@query("pii_tokenise", f"WITH {_PLAIN} SELECT doc_id, md5(text) AS text_md5, len(hits)::INT AS n_hits FROM red")
def _(t):
    return _redacted(t).select("doc_id", F.md5("text").alias("text_md5"), F.size("pii_hits").alias("n_hits"))


@query("pii_context_skip", f"""
WITH {_ctes('docs', _TECH)} SELECT doc_id, md5(text) AS text_md5, len(hits)::INT AS n_hits, skip FROM red""", "docs")
def _(t):
    skip = pii.technical_context(F.col("doc_type"), F.col("department"))
    d = t.docs.select("doc_id", "text", skip.alias("skip"))
    return pii.pseudonymise(d, skip=F.col("skip")).select(
        "doc_id", F.md5("text").alias("text_md5"), F.size("pii_hits").alias("n_hits"), "skip")


@query("pii_hash_map", f"""
WITH {_PLAIN} SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: h.token || '=' || h.pii_type))), ',') AS tokens
FROM red WHERE len(hits) > 0""")
def _(t):
    m = _redacted(t).filter(F.size("pii_hits") > 0).select("doc_id", pii.hash_map(F.col("pii_hits")).alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("doc_id", F.array_join(F.array_sort(pairs), ",").alias("tokens"))


@query("pii_audit", f"""
WITH {_PLAIN}, h AS (SELECT doc_id, unnest(hits).pii_type AS pii_type FROM red)
SELECT doc_id, pii_type, count(*) AS n FROM h GROUP BY ALL""")
def _(t):
    return pii.audit(_redacted(t))


@query("pii_vault", f"""
WITH {_PLAIN}, h AS (SELECT doc_id, generate_subscripts(hits, 1) AS pos, unnest(hits) AS h FROM red)
SELECT h.token AS token, h.pii_type AS pii_type, arg_min(h.value, ROW(doc_id, pos)) AS original_value, min(doc_id) AS doc_id, count(*) AS uses
FROM h GROUP BY h.token, h.pii_type, lower(trim(h.value))""")
def _(t):
    return pii.vault(_redacted(t))


@query("insert_ignore", f"""
WITH {_PLAIN}, h AS (SELECT doc_id, generate_subscripts(hits, 1) AS pos, unnest(hits) AS h FROM red)
SELECT h.token AS token, arg_min(h.value, ROW(doc_id, pos)) AS original_value, min(doc_id) AS doc_id FROM h GROUP BY h.token""")
def _(t):
    # two batches of documents; a token already in the vault is left as it is
    cut = t.documents.agg(F.floor(F.avg("doc_id"))).scalar()
    hits = _redacted(t).select("doc_id", F.posexplode("pii_hits").alias("pos", "h")).select(
        F.col("h.token").alias("token"), F.col("h.value").alias("original_value"), "doc_id", "pos")
    empty = hits.limit(0)
    one = insert_ignore(empty, hits.filter(F.col("doc_id") <= cut), ["token"], ["doc_id", "pos"])
    return insert_ignore(one, hits.filter(F.col("doc_id") > cut), ["token"], ["doc_id", "pos"]).drop("pos")


@query("ingest_summary", f"""
WITH {_ctes('docs', 'false', ', doc_type, department')}, h AS (SELECT doc_id, unnest(hits).pii_type AS k FROM red),
n AS (SELECT doc_id, k, count(*) AS n FROM h GROUP BY ALL),
a AS (SELECT doc_id, string_agg(k || '=' || n, ',' ORDER BY k) AS pii FROM n GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS k FROM chunks GROUP BY doc_id)
SELECT d.doc_id, d.doc_type, d.department, coalesce(c.k, 0) AS chunks, coalesce(a.pii, '') AS pii
FROM docs d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id""", "docs chunks")
def _(t):
    s = ingest_summary(t.docs.select("doc_id", "doc_type", "department"), t.chunks, pii.audit(_redacted(t)))
    pairs = F.transform(F.map_entries("pii"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("doc_id", "doc_type", "department", "chunks",
                    F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("pii"))
