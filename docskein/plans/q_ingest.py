"""Registered ingestion queries: sources, classification, chunking, enrichment, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.text import doc_title, word_count
from docskein.operators import chunking as ch
from docskein.operators import classify as cl
from docskein.operators import enrich as en
from docskein.plans.q_search import duck_tokens
from docskein.plans.registry import query, stamp
from docskein.session import scratch_path
from docskein.sources import files, store

_TS = "yyyy-MM-dd HH:mm:ss"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def documents_with_pages(t, view="docs"):
    d = getattr(t, view)
    if view != "docs":
        d = d.join(t.docs.drop("text", "source_file"), "doc_id")
    ext = F.upper(F.regexp_extract("source_file", r"\.([^.]+)$", 1))
    return files.with_pages(d.withColumn("title", doc_title(F.col("source_file"))).withColumn("source_type", ext))


# ---------------------------------------------------------------- sources
@query("ingest_manifest", r"""
WITH p AS (SELECT CASE doc_id % 6 WHEN 0 THEN '/in/__MACOSX/' || source_file WHEN 1 THEN '/in/.' || source_file
  WHEN 2 THEN '/in/' || upper(source_file) WHEN 3 THEN '/in/plain_' || doc_id ELSE 'C:\in\' || source_file END AS path FROM docs),
b AS (SELECT path, list_extract(string_split(replace(path, '\', '/'), '/'), -1) AS filename FROM p),
e AS (SELECT *, lower(regexp_extract(filename, '(\.[^.]+)$', 1)) AS extension FROM b)
SELECT 'batch-1' AS batch_id, filename, extension,
 CASE WHEN extension IN ('.pdf','.docx','.pptx') THEN 'queued' ELSE 'rejected' END AS status,
 CASE WHEN extension NOT IN ('.pdf','.docx','.pptx') THEN 'Unsupported file type: ' || CASE WHEN extension = '' THEN '(none)' ELSE extension END END AS error
FROM e WHERE filename <> '' AND NOT starts_with(filename, '.') AND NOT contains(path, '__MACOSX')""", "docs")
def _(t):
    k, f = F.col("doc_id") % 6, F.col("source_file")
    path = (F.when(k == 0, F.concat(F.lit("/in/__MACOSX/"), f)).when(k == 1, F.concat(F.lit("/in/."), f))
            .when(k == 2, F.concat(F.lit("/in/"), F.upper(f))).when(k == 3, F.concat(F.lit("/in/plain_"), "doc_id"))
            .otherwise(F.concat(F.lit("C:\\in\\"), f)))
    return files.ingest_manifest(t.docs.select(path.alias("path")), "batch-1")


@query("read_pages", """
SELECT doc_id, generate_subscripts(l, 1)::INT AS page_number, md5(unnest(l)) AS text_md5
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)""", "docs")
def _(t):
    return files.read_pages(documents_with_pages(t)).select("doc_id", "page_number", F.md5("text").alias("text_md5"))


@query("read_tickets_csv", f"""
SELECT trim(ticket_id) AS ticket_id, trim(subject) AS subject, coalesce(priority, 'Medium') AS priority, category,
 md5(trim(description)) AS description_md5, coalesce(md5(trim(resolution)), '') AS resolution_md5, nullif(status_raw, '') AS status,
 {stamp('created_at')} AS created_at FROM tickets WHERE trim(subject) <> ''""", "tickets")
def _(t):
    path = scratch_path(t.spark, "tickets-csv")
    raw = t.tickets.select(
        F.concat(F.lit("  "), "ticket_id").alias(" Ticket ID "), F.concat("subject", F.lit(" ")).alias("Title"),
        F.col("description").alias("Details"), F.col("priority").alias("Severity"), F.col("category").alias("Type"),
        F.date_format("created_at", _TS).alias("createdAt"), F.col("status_raw").alias("State"),
        F.col("resolution").alias("Fix"))
    raw.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    back = files.read_tickets_csv(t.spark, path)
    return back.select("ticket_id", "subject", "priority", "category", F.md5("description").alias("description_md5"),
                       F.coalesce(F.md5("resolution"), F.lit("")).alias("resolution_md5"), "status", "created_at")


@query("write_chunks", """
SELECT doc_origin, coalesce(repository, department) AS repository, count(*) AS chunks, sum(chunk_id)::BIGINT AS id_sum,
 sum(len(coalesce(access_roles, [])))::BIGINT AS roles FROM chunk_meta GROUP BY ALL""", "chunk_meta")
def _(t):
    path = scratch_path(t.spark, "chunks")
    # the same chunk arrives twice; the later batch wins
    first = t.chunk_meta.withColumn("batch", F.lit(1)).withColumn("content", F.lit("old"))
    store.write_chunks(first.unionByName(t.chunk_meta.withColumn("batch", F.lit(2))), path, ["batch"])
    back = t.spark.read.parquet(path).filter(F.col("content") != "old")
    return back.groupBy("doc_origin", "repository").agg(
        F.count("*").alias("chunks"), F.sum("chunk_id").alias("id_sum"),
        F.sum(F.size("access_roles")).cast("bigint").alias("roles"))


@query("merge_upsert", """
SELECT ticket_id, CASE WHEN requester_id % 3 = 0 THEN 'Critical' ELSE coalesce(priority, 'Medium') END AS priority,
 CASE WHEN requester_id % 3 = 0 THEN 3 ELSE 1 END AS batch FROM tickets
UNION ALL SELECT 'NEW' || ticket_id, 'Low', 2 FROM tickets WHERE requester_id % 5 = 0""", "tickets")
def _(t):
    k = t.tickets.select("ticket_id", "requester_id", F.coalesce("priority", F.lit("Medium")).alias("priority"))
    base = k.select("ticket_id", "priority", F.lit(1).alias("batch"))
    third = k.filter(F.col("requester_id") % 3 == 0)
    changes = (third.select("ticket_id", F.lit("Low").alias("priority"), F.lit(2).alias("batch"))
               .unionByName(third.select("ticket_id", F.lit("Critical").alias("priority"), F.lit(3).alias("batch")))
               .unionByName(k.filter(F.col("requester_id") % 5 == 0).select(
                   F.concat(F.lit("NEW"), "ticket_id").alias("ticket_id"), F.lit("Low").alias("priority"),
                   F.lit(2).alias("batch"))))
    return store.merge_upsert(base, changes, ["ticket_id"], ["batch"])


@query("update_doc_attributes", """
WITH chg AS (SELECT doc_id, source_file, 'Projects' AS repository FROM docs WHERE doc_id % 10 = 1),
byfile AS (SELECT source_file, 'EXTERNAL' AS doc_origin FROM docs WHERE doc_id % 10 = 2)
SELECT c.chunk_id, coalesce(chg.repository, c.repository) AS repository, coalesce(chg.repository, c.department) AS department,
 coalesce(b.doc_origin, c.doc_origin) AS doc_origin FROM chunk_meta c LEFT JOIN chg ON chg.doc_id = c.doc_id
LEFT JOIN byfile b ON b.source_file = c.source_file""", "docs chunk_meta")
def _(t):
    none = F.lit(None).cast("string")
    d = t.docs.select("doc_id", "source_file")
    by_id = d.filter(F.col("doc_id") % 10 == 1).select(
        "doc_id", "source_file", F.lit("Projects").alias("repository"), none.alias("doc_origin"))
    by_file = d.filter(F.col("doc_id") % 10 == 2).select(
        (-F.col("doc_id")).alias("doc_id"), "source_file", none.alias("repository"), F.lit("EXTERNAL").alias("doc_origin"))
    changes = by_id.unionByName(by_file).withColumn("access_roles", F.lit(None).cast("array<string>"))
    return store.update_doc_attributes(t.chunk_meta, changes).select("chunk_id", "repository", "department", "doc_origin")


@query("append_log", """
SELECT strftime(ts, '%Y-%m-%d') AS log_date, count(*) AS n, sum(length(substr(query_text, 1, 500)))::BIGINT AS chars
FROM query_log GROUP BY 1""", "query_log")
def _(t):
    path = scratch_path(t.spark, "query-log")
    store.append_log(t.query_log, path)
    return t.spark.read.parquet(path).groupBy(F.col("log_date").cast("string").alias("log_date")).agg(
        F.count("*").alias("n"), F.sum(F.length("query_text")).cast("bigint").alias("chars"))


# ---------------------------------------------------------------- classification
def _case(rules, default):
    return "CASE " + " ".join(f"WHEN regexp_matches(n, {sql_text(p)}) THEN {sql_text(v)}" for p, v in rules) + \
        f" ELSE {sql_text(default)} END"


def _hit(rules):
    return " OR ".join(f"regexp_matches(n, {sql_text(p)})" for p, _ in rules)


@query("classify_l1", f"""
WITH f AS (SELECT doc_id, lower(source_file) AS n FROM docs)
SELECT doc_id, {_case(fixed.DEPARTMENT_RULES, 'Unknown')} AS department, {_case(fixed.DOC_TYPE_RULES, 'Guide')} AS doc_type,
 CASE WHEN ({_hit(fixed.DEPARTMENT_RULES)}) AND ({_hit(fixed.DOC_TYPE_RULES)}) THEN 0.95::DOUBLE
  WHEN ({_hit(fixed.DEPARTMENT_RULES)}) THEN 0.80::DOUBLE ELSE 0.70::DOUBLE END AS confidence FROM f""", "docs")
def _(t):
    return cl.classify_l1(t.docs.select("doc_id", "source_file")).select(
        "doc_id", F.col("l1_department").alias("department"), F.col("l1_doc_type").alias("doc_type"),
        F.col("l1_confidence").alias("confidence"))


@query("classify_centroid", """
WITH m AS (SELECT label, i, avg(x) AS v FROM (SELECT label, generate_subscripts(embedding, 1) AS i,
  unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
c AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY label),
s AS (SELECT e.vec_id, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 6) AS cosine FROM embeddings e CROSS JOIN c)
SELECT vec_id, label::BIGINT AS predicted, cosine FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) = 1""")
def _(t):
    e = t.embeddings
    return cl.nearest_centroid(e.select("vec_id", "embedding"), e).select(
        "vec_id", F.col("predicted").cast("bigint").alias("predicted"), "cosine")


@query("map_department_repo", """
SELECT doc_id, CASE department WHEN 'HR' THEN 'HR' WHEN 'Finance' THEN 'Finance' WHEN 'IT' THEN 'IT'
 WHEN 'Engineering' THEN 'Engineering' ELSE 'External' END AS repository FROM docs""", "docs")
def _(t):
    return t.docs.select("doc_id", cl.department_repository(F.col("department")).alias("repository"))


@query("map_category_dept", """
SELECT ticket_id, CASE WHEN category IN ('HR','Payroll') THEN 'HR' WHEN category = 'Finance' THEN 'Finance' ELSE 'IT' END AS department
FROM tickets""", "tickets")
def _(t):
    return t.tickets.select("ticket_id", cl.category_department(F.col("category")).alias("department"))


@query("priority_tier", "SELECT doc_id, CASE WHEN doc_origin = 'INTERNAL' THEN 1 ELSE 3 END AS tier FROM docs", "docs")
def _(t):
    return t.docs.select("doc_id", cl.priority_tier(F.col("doc_origin")).alias("tier"))


@query("doc_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def _(t):
    return t.documents.select("doc_id", cl.checksum(F.col("text")).alias("checksum"))


@query("exact_dedup", """
WITH s AS (SELECT doc_id, sha256(text) AS c FROM documents), k AS (SELECT *, min(doc_id) OVER (PARTITION BY c) AS keeper FROM s)
SELECT doc_id, keeper, doc_id = keeper AS kept FROM k""")
def _(t):
    kept, report = cl.exact_dedup(t.documents)
    return kept.select("doc_id", F.col("doc_id").alias("keeper"), F.lit(True).alias("kept")).unionByName(
        report.select("doc_id", "keeper", F.lit(False).alias("kept")))


@query("stage_progress", f"""
WITH l AS (SELECT event_id % 500 AS job_id, user_id AS batch_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'chunking'
  WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'indexing' ELSE 'failed' END AS stage, ts, event_id AS seq FROM events),
j AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1)
SELECT job_id, batch_id, stage, {stamp('ts')} AS ts, CASE stage WHEN 'queued' THEN 0 WHEN 'chunking' THEN 35 WHEN 'indexing' THEN 92
 WHEN 'completed' THEN 100 ELSE 0 END AS progress FROM j""")
def _(t):
    stage = (F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "chunking")
             .when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "indexing")
             .otherwise("failed"))
    log = t.events.select((F.col("event_id") % 500).alias("job_id"), F.col("user_id").alias("batch_id"),
                          stage.alias("stage"), "ts", F.col("event_id").alias("seq"))
    return cl.stage_progress(log).select("job_id", "batch_id", "stage", F.date_format("ts", _TS).alias("ts"), "progress")


# ---------------------------------------------------------------- chunking
TRIMMED = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda v: v <> '')"


def duck_windows(words: str, size: int, overlap: int) -> str:
    """DuckDB list of the window texts over a list of words."""
    step = size - overlap
    return (f"CASE WHEN len({words}) = 0 THEN [] ELSE list_transform(range(0, CASE WHEN len({words}) <= {size} THEN 1 "
            f"ELSE CAST(ceil((len({words}) - {size}) / {float(step)}::DOUBLE) AS BIGINT) + 1 END), "
            f"lambda i: array_to_string(list_slice({words}, i * {step} + 1, i * {step} + {size}), ' ')) END")


def duck_page(text: str, default: str = "0") -> str:
    """Pages are resolved by joining (doc_id, page_number, text) and taking the lowest hit; see ``_PAGE_CTES``."""
    key = (f"substr(coalesce(list_extract(list_filter(list_transform(string_split({text}, chr(10)), "
           + r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 8), 1), "
           + TRIMMED.format(x=text) + "), 1, 80)")
    return key


LEVEL = (f"CASE WHEN regexp_matches(line, {sql_text(fixed.HEADING_MARKDOWN)}) THEN length(regexp_extract(line, {sql_text(fixed.HEADING_MARKDOWN)}, 1)) "
         f"WHEN regexp_matches(line, {sql_text(fixed.HEADING_NUMBERED)}) THEN len(string_split(regexp_extract(line, {sql_text(fixed.HEADING_NUMBERED)}, 1), '.')) "
         "WHEN upper(line) = line AND upper(line) <> lower(line) AND length(line) BETWEEN 3 AND 80 THEN 1 ELSE 0 END")


def section_ctes(src: str, heading: str) -> str:
    """Sections by running heading count; section paths by a recursive walk over the headings."""
    return rf"""src AS (SELECT doc_id, translate(regexp_replace(source_file, '\.[^.]*$', ''), '_-', '  ') AS title, text,
  source_file, upper(regexp_extract(source_file, '\.([^.]+)$', 1)) AS source_type FROM {src}),
l AS (SELECT doc_id, title, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, title,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM src)),
h AS (SELECT *, length(line) < 120 AND regexp_matches(line, {sql_text(heading)}) AS is_head FROM l),
s AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM h),
heads AS (SELECT doc_id, sec, line AS head, {LEVEL} AS lvl FROM s WHERE is_head),
stk AS (SELECT doc_id, title, 0::HUGEINT AS sec, []::STRUCT(lvl BIGINT, t VARCHAR)[] AS stack, title AS head FROM src
 UNION ALL SELECT k.doc_id, k.title, x.sec, CASE WHEN x.lvl = 0 THEN k.stack
  ELSE list_append(list_filter(k.stack, lambda e: e.lvl < x.lvl), {{'lvl': x.lvl::BIGINT, 't': x.head}}) END, x.head
 FROM stk k JOIN heads x ON x.doc_id = k.doc_id AND x.sec = k.sec + 1),
pth AS (SELECT doc_id, sec, head, list_concat([title], list_transform(stack, lambda e: e.t)) AS named, title FROM stk),
body AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY pos) AS body FROM s WHERE NOT is_head GROUP BY ALL),
sect AS (SELECT b.doc_id, b.sec, b.body, p.head AS section_title, p.title,
  CASE WHEN b.sec = 0 OR list_extract(p.named, -1) = p.head THEN p.named ELSE list_append(p.named, p.head) END AS path
  FROM body b JOIN pth p ON p.doc_id = b.doc_id AND p.sec = b.sec)"""


def page_ctes(source: str, key_cols: str, text: str, pages_from: str = "src") -> str:
    """``paged``: page number of every row of ``source``, looked up in the raw lines of its document."""
    return rf"""pages_ AS (SELECT doc_id, generate_subscripts(ls, 1) AS page_number, unnest(ls) AS ptext
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {pages_from})),
keyed AS (SELECT *, {duck_page(text)} AS pkey FROM {source}),
loose AS (SELECT *, {WORDS.format(x='pkey')} AS pw FROM keyed),
hits AS (SELECT {', '.join('x.' + c for c in key_cols.split())}, min(CASE WHEN contains(p.ptext, x.pkey) THEN p.page_number END) AS p1,
  min(CASE WHEN len(x.pw) >= 3 AND contains(p.ptext, array_to_string(x.pw[1:5], ' ')) THEN p.page_number END) AS p2
  FROM loose x LEFT JOIN pages_ p ON p.doc_id = x.doc_id GROUP BY ALL),
paged AS (SELECT x.*, coalesce(CASE WHEN x.pkey <> '' THEN coalesce(k.p1, k.p2) END, 0)::INT AS page_number
  FROM loose x JOIN hits k USING ({', '.join(key_cols.split())}))"""


def piece_ctes(limit: int, size: int, overlap: int) -> str:
    """``pieces``: whole sections or their windows, numbered within the document."""
    w = WORDS.format(x="body")
    return rf"""sized AS (SELECT *, {w} AS w FROM paged),
cut AS (SELECT *, CASE WHEN len(w) <= {limit} THEN [body] ELSE {duck_windows('w', size, overlap)} END AS parts FROM sized),
flat AS (SELECT doc_id, sec, section_title, path, page_number, len(w) AS n, generate_subscripts(parts, 1) AS part, unnest(parts) AS ptxt FROM cut),
pieces AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, part) - 1)::INT AS chunk_index,
  CASE WHEN n <= {limit} THEN section_title ELSE section_title || ' (part ' || part || ')' END || chr(10) || chr(10) || ptxt AS content,
  section_title, array_to_string(path, ' > ') AS path, page_number, len({WORDS.format(x='ptxt')})::INT AS token_count FROM flat)"""


PIECE_SELECT = "doc_id, chunk_index, md5(content) AS content_md5, section_title, path, page_number, token_count"


def piece_columns(df):
    return df.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "section_title",
                     F.array_join("section_hierarchy", " > ").alias("path"), "page_number", "token_count")


@query("heading_level", rf"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1)::INT AS pos, unnest(ls) AS line FROM (SELECT doc_id,
 list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ls FROM docs_marked))
SELECT doc_id, pos, ({LEVEL})::INT AS lvl FROM l""", "docs_marked")
def _(t):
    lines = t.docs_marked.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("pos"), ch.heading_level(ch.strip(F.col("line"))).alias("lvl"))


@query("section_path", f"""
WITH RECURSIVE {section_ctes('docs_marked', fixed.HEADING_UNIVERSAL)}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INT AS section_no, section_title,
 array_to_string(path, ' > ') AS path FROM sect""", "docs_marked")
def _(t):
    return ch.section_path(documents_with_pages(t, "docs_marked")).select(
        "doc_id", "section_no", "section_title", F.array_join("section_hierarchy", " > ").alias("path"))


@query("chunk_hierarchy", f"""
WITH RECURSIVE {section_ctes('docs_marked', fixed.HEADING_UNIVERSAL)}, {page_ctes('sect', 'doc_id sec', 'body')},
{piece_ctes(800, 700, 105)} SELECT {PIECE_SELECT} FROM pieces""", "docs_marked")
def _(t):
    return piece_columns(ch.chunk_hierarchy(documents_with_pages(t, "docs_marked")))


@query("chunk_policy", rf"""
WITH RECURSIVE {section_ctes('docs', fixed.HEADING_POLICY)},
secs AS (SELECT doc_id, sec, body, section_title, path FROM sect UNION ALL
 SELECT doc_id, 0, text, title, [title] FROM src WHERE doc_id NOT IN (SELECT doc_id FROM sect) AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
{page_ctes('secs', 'doc_id sec', 'body')}, {piece_ctes(800, 700, 105)}
SELECT doc_id, chunk_index, md5(content) AS content_md5, section_title, path, token_count FROM pieces""", "docs")
def _(t):
    return piece_columns(ch.chunk_policy(documents_with_pages(t))).drop("page_number")


@query("chunk_runbook", rf"""
WITH RECURSIVE src AS (SELECT doc_id, translate(regexp_replace(source_file, '\.[^.]*$', ''), '_-', '  ') AS title, text FROM docs_marked),
l AS (SELECT doc_id, title, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, title, string_split(text, chr(10)) AS ls FROM src)),
f AS (SELECT *, sum(starts_with({TRIMMED.format(x='line')}, '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM l),
h AS (SELECT *, pos > 0 AND fences % 2 = 0 AND regexp_matches({TRIMMED.format(x='line')}, {sql_text(fixed.STEP_HEADER)}) AS is_head FROM f),
s AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM h),
b AS (SELECT doc_id, sec, {TRIMMED.format(x="string_agg(line, chr(10) ORDER BY pos)")} AS body,
 CASE WHEN sec = 0 THEN 'Introduction' ELSE {TRIMMED.format(x="arg_min(line, pos)")} END AS section_title FROM s GROUP BY doc_id, sec),
c AS (SELECT *, {WORDS.format(x='body')} AS w FROM b WHERE body <> ''),
p AS (SELECT doc_id, sec, section_title, CASE WHEN len(w) > 500 THEN {duck_windows('w', 450, 45)} ELSE [body] END AS parts FROM c),
q AS (SELECT doc_id, sec, section_title, generate_subscripts(parts, 1) AS part, unnest(parts) AS content FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, part) - 1)::INT AS chunk_index, md5(content) AS content_md5,
 section_title, len({WORDS.format(x='content')})::INT AS token_count FROM q""", "docs_marked")
def _(t):
    return piece_columns(ch.chunk_runbook(documents_with_pages(t, "docs_marked"))).drop("path", "page_number")


_SLIDES = r"""slides AS (SELECT doc_id, page_number, ptext FROM (SELECT doc_id, generate_subscripts(ls, 1) AS page_number, unnest(ls) AS ptext
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs)) WHERE regexp_replace(ptext, '^\s+|\s+$', '', 'g') <> '')"""


@query("chunk_slides", rf"""
WITH {_SLIDES} SELECT doc_id, (page_number - 1)::INT AS chunk_index, md5(ptext) AS content_md5,
 'Slide ' || page_number AS section_title, page_number::INT AS page_number, len({WORDS.format(x='ptext')})::INT AS token_count FROM slides""", "docs")
def _(t):
    return piece_columns(ch.chunk_slides(documents_with_pages(t))).drop("path")


@query("chunk_router", rf"""
WITH RECURSIVE {section_ctes('docs', fixed.HEADING_UNIVERSAL)}, {page_ctes('sect', 'doc_id sec', 'body')}, {piece_ctes(800, 700, 105)},
{_SLIDES}, none AS (SELECT doc_id, title, {WORDS.format(x='text')} AS w FROM src WHERE doc_id NOT IN (SELECT doc_id FROM sect)),
plain AS (SELECT doc_id, title, generate_subscripts(parts, 1) AS part, unnest(parts) AS content FROM (SELECT doc_id, title, {duck_windows('w', 700, 105)} AS parts FROM none)),
routed AS (
 SELECT p.doc_id, chunk_index, content, section_title, token_count FROM pieces p JOIN src USING (doc_id) WHERE source_type <> 'PPTX'
 UNION ALL SELECT p.doc_id, (part - 1)::INT, content, p.title, len({WORDS.format(x='content')})::INT FROM plain p JOIN src USING (doc_id) WHERE source_type <> 'PPTX'
 UNION ALL SELECT s.doc_id, (page_number - 1)::INT, ptext, 'Slide ' || page_number, len({WORDS.format(x='ptext')})::INT FROM slides s JOIN src USING (doc_id) WHERE source_type = 'PPTX')
SELECT r.doc_id, r.chunk_index, md5(r.content) AS content_md5, r.section_title, r.token_count, d.doc_type, d.department
FROM routed r JOIN docs d ON d.doc_id = r.doc_id""", "docs")
def _(t):
    r = ch.chunk_router(documents_with_pages(t))
    return r.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "section_title", "token_count",
                    "doc_type", "department")


@query("split_overlap", f"""
WITH w AS (SELECT doc_id, {WORDS.format(x='text')} AS w FROM documents), p AS (SELECT doc_id, {duck_windows('w', 700, 105)} AS parts FROM w)
SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INT AS chunk_index, md5(unnest(parts)) AS content_md5 FROM p""")
def _(t):
    return ch.split_overlap(t.documents).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("token_count", f"SELECT doc_id, len({WORDS.format(x='text')})::INT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", word_count(F.col("text")).alias("n"))


@query("page_number", f"""
WITH w AS (SELECT doc_id, {WORDS.format(x='text')} AS w, text FROM documents),
c AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS sec, unnest(parts) AS body FROM (SELECT doc_id, {duck_windows('w', 120, 18)} AS parts FROM w)),
{page_ctes('c', 'doc_id sec', 'body', 'documents')} SELECT doc_id, sec::INT AS chunk_index, page_number FROM paged""")
def _(t):
    d = documents_with_pages(t)
    from docskein.functions.text import words

    cut = d.withColumn("_w", words(F.col("text"))).select("doc_id", "pages", ch.windows(F.col("_w"), 120, 0.15).alias("cut"))
    paged = F.transform("cut", lambda c: ch.find_page(F.col("pages"), c))
    return cut.select("doc_id", F.posexplode(paged).alias("chunk_index", "page_number"))


# ---------------------------------------------------------------- metadata and enrichment
@query("stamp_metadata", """
SELECT c.chunk_id, d.department, d.doc_origin, d.source_file, CASE WHEN d.doc_origin = 'INTERNAL' THEN 1 ELSE 3 END AS priority_tier,
 coalesce(d.repository, d.department, 'Unknown') AS repository, array_to_string(coalesce(d.access_roles,
  ['EMPLOYEE','MANAGER','HR','FINANCE','IT_ADMIN','EXECUTIVE']), ',') AS access_roles, 'system' AS uploaded_by
FROM chunks c JOIN docs d ON d.doc_id = c.doc_id""", "chunks docs")
def _(t):
    docs = t.docs.withColumn("project_id", F.lit(None).cast("string"))
    return en.stamp_metadata(t.chunks, docs).select(
        "chunk_id", "department", "doc_origin", "source_file", "priority_tier", "repository",
        F.array_join("access_roles", ",").alias("access_roles"), "uploaded_by")


def _view_source(t):
    some = lambda cond, *vals: F.when(cond, F.array(*[F.lit(v) for v in vals]))
    k = F.col("chunk_id") % 3
    return t.chunks.select(
        "chunk_id", "content", F.when(k == 0, F.lit(" short summary ")).alias("chunk_summary"),
        some(k == 1, "q one", "q two").alias("chunk_questions"), some(k == 0, "old question").alias("hypothetical_questions"),
        F.array().cast("array<string>").alias("chunk_keywords"), some(k == 2, "vpn", "leave").alias("keywords"))


@query("four_views", """
WITH v AS (SELECT chunk_id, chunk_id % 3 AS k, content, substr(content, 1, 200) AS o FROM chunks)
SELECT chunk_id, 'content' AS vector_name, md5(content) AS text_md5 FROM v
UNION ALL SELECT chunk_id, 'summary', md5(CASE WHEN k = 0 THEN 'short summary' ELSE o END) FROM v
UNION ALL SELECT chunk_id, 'question', md5(CASE k WHEN 1 THEN 'q one' || chr(10) || 'q two' WHEN 0 THEN 'old question' ELSE o END) FROM v
UNION ALL SELECT chunk_id, 'keyword', md5(CASE WHEN k = 2 THEN 'vpn' || chr(10) || 'leave' ELSE o END) FROM v""", "chunks")
def _(t):
    return en.four_views(_view_source(t)).select("chunk_id", "vector_name", F.md5("text").alias("text_md5"))


@query("fallback_enrichment", """
SELECT doc_id, 'Information about ' || source_file AS chunk_summary,
 'What is ' || source_file || '?' || '|' || 'How does ' || source_file || ' work?' AS questions FROM docs""", "docs")
def _(t):
    return en.fallback_enrichment(t.docs.withColumn("section_title", F.col("source_file"))).select(
        "doc_id", "chunk_summary", F.array_join("chunk_questions", "|").alias("questions"))


@query("ticket_to_chunk", r"""
WITH t AS (SELECT *, coalesce(category,'General') AS cat, coalesce(priority,'Medium') AS pri FROM tickets)
SELECT ticket_id, sha1('ticket-namespace:' || ticket_id) AS chunk_id, sha1('ticket-namespace:tickets_' || cat) AS doc_id,
 md5('Ticket ID: ' || ticket_id || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || 'Description:' || chr(10) || description) AS content_md5,
 substr(subject,1,100) AS section_title, CASE WHEN cat IN ('HR','Payroll') THEN 'HR' WHEN cat = 'Finance' THEN 'Finance' ELSE 'IT' END AS department,
 'How was the ' || cat || ' issue ''' || substr(subject,1,50) || ''' resolved?' AS question,
 array_to_string(list_concat([lower(cat), lower(pri)], list_filter(regexp_split_to_array(lower(subject), '\s+'), lambda w: w <> '')[1:5]), ',') AS keywords
FROM t""", "tickets")
def _(t):
    return en.ticket_to_chunk(t.tickets).select(
        "ticket_id", "chunk_id", "doc_id", F.md5("content").alias("content_md5"), "section_title", "department",
        F.col("hypothetical_questions")[0].alias("question"), F.array_join("keywords", ",").alias("keywords"))


def _length_and_sum(texts):
    """A deterministic batch model that SQL can repeat: number of bytes and of words."""
    return texts.map(lambda x: [float(len(x.encode())), float(len(x.split(" ")))])


@query("embed_once", """
SELECT chunk_id, md5(content) AS text_key, strlen(content)::DOUBLE AS first, len(string_split(content, ' '))::DOUBLE AS second FROM chunks""", "chunks")
def _(t):
    e = en.embed_once(t.chunks.select("chunk_id", "content"), _length_and_sum, "content")
    return e.select("chunk_id", "text_key", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


@query("distinct_texts", "SELECT md5(content) AS text_key, count(*) AS uses FROM chunks GROUP BY 1", "chunks")
def _(t):
    return en.distinct_texts(t.chunks, "content")


# every text with a term has a vector of length 1, and equal texts have equal vectors
@query("hash_embed", f"""
SELECT chunk_id, 256 AS dims, CASE WHEN len({duck_tokens('content')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS squared_norm FROM chunks""", "chunks")
def _(t):
    e = en.hash_embed(t.chunks)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("chunk_id", F.size("embedding").alias("dims"), F.round(norm, 4).alias("squared_norm"))


@query("doc_record", r"""
SELECT d.doc_id, substr(translate(regexp_replace(source_file, '\.[^.]*$', ''), '_-', '  '), 1, 512) AS title, sha256(d.text) AS checksum,
 coalesce(n.k, 0) AS chunk_count, r.repository_id, 'READY' AS status FROM docs d
LEFT JOIN (SELECT doc_id, count(*) AS k FROM chunks GROUP BY doc_id) n ON n.doc_id = d.doc_id
LEFT JOIN repositories r ON r.name = d.repository""", "docs chunks repositories")
def _(t):
    return en.doc_records(t.docs.withColumn("title", doc_title(F.col("source_file"))), t.chunks, t.repositories)
