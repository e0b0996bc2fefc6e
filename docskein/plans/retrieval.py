"""Retrieval as one set-at-a-time plan: understanding, scope cascade, retry, ticket fallback and packed contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.ranking import top_k
from docskein.functions.text import word_count
from docskein.operators import context, lexical, scoring
from docskein.operators.filters import visible_to
from docskein.operators.understand import understand
from docskein.session import stored

LEVELS = {1: "DOCUMENT", 2: "REPOSITORY", 3: "DEPARTMENT", 4: "GLOBAL"}


def chunk_labels() -> Column:
    """What a search may demand of a chunk: who may see it, its document, repository and department."""
    return F.concat(lexical.role_labels(F.col("access_roles")), lexical.value_labels(
        doc=F.col("doc_id"), repository=F.col("repository"), department=F.col("department")))


def index_corpus(chunks: DataFrame, path: str | None = None) -> lexical.TermIndex:
    """Term index of a chunk table; stretches of a document lie together, so a question about it visits few pieces."""
    stretch = F.floor(F.col("chunk_index") / 64) if "chunk_index" in chunks.columns else F.pmod(F.xxhash64("chunk_id"), F.lit(64))
    return lexical.index_chunks(chunks, path=path, labels=chunk_labels(), cluster=F.concat_ws("/", "doc_id", stretch))


def scope_demand(level: Column) -> Column:
    """Labels of a question's scope at a level: of its documents, its repository or its department."""
    docs = F.transform("scope_doc_ids", lambda d: lexical.value_label("doc", d))
    return (F.when(level == 1, docs).when(level == 2, F.array(lexical.value_label("repository", F.col("repo_hint"))))
            .when(level == 3, F.array(lexical.value_label("department", F.col("dept_hint")))))


def _scope(level: int) -> Column:
    return {1: F.size(F.coalesce("scope_doc_ids", F.array().cast("array<bigint>"))) > 0, 2: F.col("repo_hint").isNotNull(),
            3: F.col("dept_hint").isNotNull(), 4: F.lit(True)}[level]


def level_results(index: lexical.TermIndex, queries: DataFrame, chunks: DataFrame, list_size: int = 20, k: int = 8,
                  levels: tuple[int, ...] = (1, 2, 3, 4), scoped: DataFrame | None = None) -> DataFrame:
    """Final chunks per (question, level), narrowest level first; a level is searched for the questions only that no
    narrower one has settled with confidence.

    Chunks that the asker may not see (``access_roles`` against ``user_roles``) compete at no level. ``scoped`` lists the
    documents a question may fall back to: having one and no chunk at level 1 settles it too.
    """
    roles = lexical.role_demand(F.col("user_roles"))
    asked = stored(queries.select("query_id", "text", "scope_doc_ids", "repo_hint", "dept_hint", roles.alias("roles")), "questions")
    tiers = chunks.select("chunk_id", "priority_tier")
    # pair scores are graded against the best chunk of all that the asker may see; the same search answers the global level
    everywhere = lexical.search(index, asked.withColumn("must", F.array("roles")), list_size if 4 in levels else 1, must="must")
    best = stored(everywhere.filter("rank = 1").select("query_id", F.col("score").alias("best")), "best-scores")
    open_, out = asked, None
    for level in levels:
        now = open_.filter(_scope(level))
        if level == 4:
            found = everywhere.join(now.select("query_id"), "query_id", "left_semi")
        else:
            found = lexical.search(index, now.withColumn("must", F.array("roles", scope_demand(F.lit(level)))), list_size, must="must")
        short = found.join(best, "query_id").join(tiers, "chunk_id")
        scored = scoring.add_final_score(short.withColumn("rerank_score", scoring.logistic(scoring.pair_raw(F.col("best")))))
        kept = scored.filter(F.col("final_score") >= fixed.FINAL_THRESHOLD).withColumn("level", F.lit(level)).drop("rank", "best")
        found = stored(top_k(kept, ["query_id", "level"], [F.desc("final_score"), F.asc("chunk_id")], k, "final_rank"), "level")
        out = found if out is None else out.unionByName(found)
        if level == levels[-1]:
            break
        settled = found.groupBy("query_id").agg(F.max("final_score").alias("c")).filter(
            F.col("c") >= fixed.LOW_CONFIDENCE).select("query_id")
        if level == 1 and scoped is not None:
            settled = settled.union(scoped.select("query_id").join(found.select("query_id"), "query_id", "left_anti")).distinct()
        open_ = stored(open_.join(settled, "query_id", "left_anti"), "unsettled")
    return out


def scoped_documents(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, doc_id, chunk_count) of the documents a question is scoped to and its asker may see."""
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.first("access_roles").alias("access_roles"))
    asked = queries.select("query_id", "user_roles", F.explode(F.array_distinct("scope_doc_ids")).alias("doc_id"))
    return asked.join(sizes, "doc_id").filter(visible_to(F.col("access_roles"), F.col("user_roles"))).select(
        "query_id", "doc_id", "chunk_count")


def document_fallback(picked: DataFrame, scoped: DataFrame, chunks: DataFrame, n: int = 8) -> DataFrame:
    """(query_id, chunk_key, final_score) for questions answered from their documents themselves (level 0): an outline of
    each document at .99 and up to ``n`` evenly spaced chunks at .95, falling by .001."""
    wanted = scoped.join(picked.filter(F.col("level") == 0).select("query_id"), "query_id", "left_semi")
    outline = wanted.select("query_id", F.concat(F.lit("outline-"), F.col("doc_id").cast("string")).alias("chunk_key"),
                            F.lit(0.99).alias("final_score"))
    some = chunks.select("doc_id", "chunk_index", "chunk_id").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = context.even_sample(some, n).withColumn("_i", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")) - 1)
    rows = wanted.join(sample, "doc_id").select("query_id", F.col("chunk_id").cast("string").alias("chunk_key"), F.round(
        F.lit(0.95) - F.col("_i") * F.lit(0.001), 6).alias("final_score"))
    return outline.unionByName(rows)


def pick_level(queries: DataFrame, results: DataFrame, scoped: DataFrame) -> DataFrame:
    """Level each question is answered from: (query_id, level, label, chunks, confidence, low_confidence).

    ``scoped`` lists the documents that a question may fall back to. The narrowest confident level wins. A document scope without any good chunk falls back to the document itself.
    Without a confident level the one with most chunks wins, the narrower on a tie, except that global wins ties.
    """
    stats = results.groupBy("query_id", "level").agg(F.count("*").alias("chunks"), F.max("final_score").alias("confidence"))
    # the global level is always tried; a scoped document with chunks offers its outline when level 1 found nothing
    scoped = scoped.groupBy("query_id").agg(F.sum(F.least("chunk_count", F.lit(8)) + 1).alias("chunks"))
    found1 = stats.filter(F.col("level") == 1).select("query_id")
    fallback = scoped.join(found1, "query_id", "left_anti").select(
        "query_id", F.lit(0).alias("level"), "chunks", F.lit(0.95).alias("confidence"))
    tried = stats.unionByName(fallback)
    floor = queries.join(stats.filter(F.col("level") == 4).select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lit(4).alias("level"), F.lit(0).cast("bigint").alias("chunks"), F.lit(0.0).alias("confidence"))
    tried = tried.unionByName(floor)
    sure = F.col("confidence") >= fixed.LOW_CONFIDENCE
    rank = F.struct(
        sure.cast("int").alias("a"), F.when(sure, -F.col("level")).otherwise(F.col("chunks")).alias("b"),
        F.when(F.col("level") == 4, 1).otherwise(0).alias("c"), (-F.col("level")).alias("d"))
    best = tried.groupBy("query_id").agg(F.max_by(F.struct("level", "chunks", "confidence"), rank).alias("x")).select(
        "query_id", "x.*")
    label = F.when(F.col("level") == 0, "DOCUMENT_FALLBACK")
    for n, name in LEVELS.items():
        label = label.when(F.col("level") == n, name)
    return best.select("query_id", "level", label.alias("label"), "chunks", "confidence",
                       (F.col("confidence") < fixed.LOW_CONFIDENCE).alias("low_confidence"))


def low_confidence_retry(kept: DataFrame, retried: DataFrame) -> DataFrame:
    """Retry result for low-confidence questions when it has no fewer chunks: (query_id, chunks, confidence, retried).

    ``retried`` holds the global attempt with a wider k as (query_id, chunks, confidence)."""
    r = retried.select("query_id", F.col("chunks").alias("_n"), F.col("confidence").alias("_c"))
    j = kept.join(r, "query_id", "left")
    better = F.col("low_confidence") & (F.coalesce("_n", F.lit(0)) >= F.col("chunks"))
    return j.select("query_id", F.when(better, F.coalesce("_n", F.lit(0))).otherwise(F.col("chunks")).alias("chunks"),
                    F.when(better, F.coalesce("_c", F.lit(0.0))).otherwise(F.col("confidence")).alias("confidence"),
                    better.alias("retried"))


def ticket_fallback(final: DataFrame, thin: DataFrame, tickets: DataFrame, k: int = 8, most: int = 3) -> DataFrame:
    """Add up to three ticket chunks at .55 to questions in ``thin`` and re-rank: (query_id, chunk_key, final_score, rank).

    ``final(query_id, chunk_key, final_score)`` holds the chosen level's rows, those of level 0 included; ``tickets(query_id, ticket_id, rank)`` in search order.
    """
    extra = tickets.join(thin.select("query_id"), "query_id", "left_semi").filter(F.col("rank") <= most).select(
        "query_id", F.concat(F.lit("ticket-"), "ticket_id").alias("chunk_key"), F.lit(0.55).alias("final_score"))
    rows = final.select("query_id", "chunk_key", "final_score").unionByName(extra)
    return top_k(rows, ["query_id"], [F.desc("final_score"), F.asc("chunk_key")], k)


def answer_contexts(chunks: DataFrame, queries: DataFrame, as_of: str, list_size: int = 20,
                    index: lexical.TermIndex | None = None) -> DataFrame:
    """Question → packed context over a chunk table: understanding, one list for the question and one for its first
    expansion among the chunks the asker may see, fusion, pool, pair score, freshness, entity boost, threshold, packing,
    citations. Summaries get longer lists and larger budgets."""
    index = index or index_corpus(chunks)
    asked = stored(understand(queries), "understood")

    def ranked(questions: DataFrame) -> DataFrame:
        due = questions.select("query_id", "text", F.array(lexical.role_demand(F.col("user_roles"))).alias("must"))
        found = lexical.search(index, due, list_size, must="must")
        return stored(found.withColumn("raw", scoring.pair_raw()), "ranked")  # list_size rows per question

    own = ranked(asked.withColumn("text", F.col("safe")))
    wider = ranked(asked.filter(F.size("expanded") > 1).withColumn("text", F.get("expanded", F.lit(1))))
    fused = scoring.rrf_fuse([("bm25", own), ("expansion", wider)], chunks)
    raw = own.select("query_id", "chunk_id", "raw").unionByName(wider.select("query_id", "chunk_id", "raw")).groupBy(
        "query_id", "chunk_id").agg(F.max("raw").alias("raw"))
    meta = chunks.select("chunk_id", "source_file", "department", "repository", "content", "priority_tier", "ingested_at",
                         word_count(F.col("content")).alias("token_count"))
    cands = fused.join(raw, ["query_id", "chunk_id"]).join(asked.select(
        "query_id", "intent", "departments", "repositories", "ticket_ids", "repository_weight", "department_weight"), "query_id")
    cands = scoring.rerank_pool(cands).join(meta, "chunk_id")
    age = scoring.age_days(F.col("ingested_at"), as_of)
    boost = scoring.entity_boost(F.col("department"), F.col("repository"), F.col("content"), F.col("source_file"))
    scored = scoring.add_final_score(cands.withColumns({
        "rerank_score": scoring.logistic(F.col("raw")), "entity_boost": boost,
        "freshness": scoring.freshness_decay(age), "age": age, "doc_key": F.col("source_file")})).drop("content")
    final = scoring.select_final(scored)
    packed = context.pack(context.gather(final, context.is_stale(F.col("age"))))
    picked = context.picked_rows(packed)
    with_text = chunks.withColumns({"section_title": F.lit("General"), "page_number": F.lit(0)})
    texts = context.assemble(picked, with_text)
    out = queries.select("query_id", "text").join(packed.select("query_id", "used_tokens", F.size("picked").alias("n_chunks")),
                                                  "query_id", "left").join(texts, "query_id", "left")
    return out.select("query_id", F.col("text").alias("question"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
                      F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
                      F.coalesce("context_text", F.lit("")).alias("context_text"), "citations")
