"""Context building: budgeted packing, tier-1 guarantee, citations, prompts, document scope shortcuts.

A question's candidates are at most the re-rank pool, so they fit one array and the greedy packing is a fold over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.ranking import top_k
from docskein.functions.text import basename, let, words

ITEM = ("struct<pos:int,chunk_id:bigint,doc_key:string,token_count:int,priority_tier:int,final_score:double,"
        "stale:boolean>")


def gather(final: DataFrame, stale: Column | None = None) -> DataFrame:
    """One row per question with its final list in order as ``items``; the caller's selection bounds the list."""
    ranked = final.withColumn("pos", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.asc("chunk_id"))))
    item = F.struct(
        F.col("pos").cast("int").alias("pos"), F.col("chunk_id").cast("bigint").alias("chunk_id"),
        F.col("doc_key").cast("string").alias("doc_key"), F.col("token_count").cast("int").alias("token_count"),
        F.col("priority_tier").cast("int").alias("priority_tier"), F.col("final_score").alias("final_score"),
        (F.lit(False) if stale is None else stale).alias("stale"))
    extra = [F.first("intent").alias("intent")] if "intent" in final.columns else []
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).cast(f"array<{ITEM}>").alias("items"), *extra)


def _greedy(items: Column, budget: Column, max_chunks: Column, per_doc: Column) -> Column:
    """struct(used, picked): take items in order; skip what exceeds the document quota or the budget."""
    state = f"struct<used:int,picked:array<{ITEM}>>"

    def step(acc: Column, x: Column) -> Column:
        same = F.size(F.filter(acc["picked"], lambda p: p["doc_key"] == x["doc_key"]))
        fits = ((F.size(acc["picked"]) < max_chunks) & (same < per_doc)
                & (acc["used"] + x["token_count"] <= budget))
        return F.when(fits, F.struct((acc["used"] + x["token_count"]).alias("used"),
                                     F.concat(acc["picked"], F.array(x)).alias("picked")).cast(state)).otherwise(acc)

    return F.aggregate(items, F.struct(F.lit(0).alias("used"), F.array().alias("picked")).cast(state), step)


def _guarantee(pack: Column, items: Column, budget: Column) -> Column:
    """Swap the best tier-1 item for the lowest other pick when none was chosen and the budget allows."""
    state = f"struct<used:int,picked:array<{ITEM}>>"
    picked = pack["picked"]
    has = F.exists(picked, lambda p: p["priority_tier"] == 1)
    best = F.get(F.filter(items, lambda x: x["priority_tier"] == 1), F.lit(0))
    # lowest score, the earliest pick among equals
    low = F.array_min(F.transform(F.filter(picked, lambda p: p["priority_tier"] != 1),
                                  lambda p: F.struct(p["final_score"], p["pos"])))["pos"]

    def swap(b: Column) -> Column:
        old = F.get(F.filter(picked, lambda p: p["pos"] == low), F.lit(0))
        used = pack["used"] - old["token_count"] + b["token_count"]
        new = F.struct(used.alias("used"), F.transform(
            picked, lambda p: F.when(p["pos"] == low, b).otherwise(p)).alias("picked")).cast(state)
        return F.when(~has & b.isNotNull() & low.isNotNull() & (used <= budget), new).otherwise(pack)

    return let(best, swap)


def pack(gathered: DataFrame, max_tokens: int = 4096, max_chunks: int = 8, max_per_doc: int | Column = 3,
         guarantee: bool = True) -> DataFrame:
    """Greedy packing per question; summaries get 8192 tokens and 16 chunks. Adds ``used_tokens`` and ``picked``."""
    summary = F.col("intent") == "SUMMARIZE" if "intent" in gathered.columns else F.lit(False)
    budget = F.when(summary, max(max_tokens, 8192)).otherwise(max_tokens)
    slots = F.when(summary, max(max_chunks, 16)).otherwise(max_chunks)
    quota = max_per_doc if isinstance(max_per_doc, Column) else F.lit(max_per_doc)
    packed = _greedy(F.col("items"), budget, slots, quota)
    if guarantee:
        packed = let(packed, lambda p: _guarantee(p, F.col("items"), budget))
    return gathered.withColumn("_pack", packed).select(
        *gathered.columns, F.col("_pack.used").alias("used_tokens"), F.col("_pack.picked").alias("picked"))


def pack_simple(gathered: DataFrame, max_tokens: int = 4096, max_per_doc: int = 3) -> DataFrame:
    """Variant without intents, stale marks or tier-1 guarantee."""
    plain = gathered.drop("intent")
    return pack(plain, max_tokens, 8, max_per_doc, guarantee=False)


def picked_rows(packed: DataFrame, *more: str) -> DataFrame:
    """One row per picked chunk with its source number and ``more`` columns of its question."""
    return packed.select("query_id", *more, F.posexplode("picked").alias("i", "p")).select(
        "query_id", *more, (F.col("i") + 1).alias("source_no"), "p.*")


def source_label(no: Column, source_file: Column, section: Column, page: Column, repository: Column, stale: Column) -> Column:
    return F.concat(F.lit("[Source "), no.cast("string"), F.lit("] "), basename(source_file), F.lit(" | "),
                    F.coalesce(section, F.lit("General")), F.lit(" | p."), page.cast("string"), F.lit(" | "), repository,
                    F.when(stale, F.lit(" [STALE – verify before actioning]")).otherwise(F.lit("")))


def assemble(picked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Context text and citations per question. Chunk texts join in only for the few picked rows."""
    c = chunks.select("chunk_id", "content", "source_file", "repository", "department", "section_title", "page_number")
    repo = F.coalesce("repository", "department")
    rows = picked.join(c, "chunk_id").select(
        "query_id", "source_no", F.concat(
            source_label(F.col("source_no"), F.col("source_file"), F.col("section_title"), F.col("page_number"), repo,
                         F.col("stale")), F.lit("\n"), F.col("content")).alias("block"),
        citation(repo).alias("citation"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_no", "block", "citation"))).alias("r")).select(
        "query_id", F.array_join(F.transform("r", lambda x: x["block"]), "\n\n---\n\n").alias("context_text"),
        F.transform("r", lambda x: x["citation"]).alias("citations"))


def four_digits(score: Column) -> Column:
    """A six-digit score to four digits, halves upwards, in whole millionths: no engine sees a binary tie."""
    return F.floor((F.floor(score * 1e6 + 0.5) + 50) / 100) / F.lit(1e4)


def citation(repository: Column) -> Column:
    return F.struct(basename(F.col("source_file")).alias("source"), F.col("section_title").alias("section"),
                    F.col("page_number").alias("page"), repository.alias("repository"),
                    four_digits(F.col("final_score")).alias("score"), "priority_tier", "chunk_id", "stale")


def is_stale(age: Column) -> Column:
    return age > fixed.STALE_DAYS


def prompts(contexts: DataFrame, history: DataFrame, turns: int = 4, max_chars: int | None = None) -> DataFrame:
    """Prompt per session: its last turns (whole, or ``max_chars`` characters of each), the context and the question.

    ``history(session_id, turn, role, content)``; ``contexts(session_id, context_text, question)``.
    """
    last = top_k(history, ["session_id"], [F.desc("turn")], turns, "back")
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(who, F.lit(": "), F.col("content") if max_chars is None else F.substring("content", 1, max_chars))
    told = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("h"))
    head = F.concat(F.array_join(F.transform("h", lambda x: x["line"]), "\n"), F.lit("\n\n"))
    return contexts.join(told, "session_id", "left").select("session_id", F.concat(
        F.coalesce(head, F.lit("")), F.lit("CONTEXT FROM KNOWLEDGE BASE:\n"), "context_text",
        F.lit("\n\n---\nUSER QUESTION: "), "question",
        F.lit("\n\nAnswer based only on the context above. Include [Source N] citations.")).alias("prompt"))


def fallback_summary(text: Column, max_words: int) -> Column:
    """First 2·n words, with an ellipsis when more follow."""
    return let(words(text), lambda w: F.concat(
        F.array_join(F.slice(w, 1, 2 * max_words), " "), F.when(F.size(w) > 2 * max_words, "...").otherwise("")))


def doc_chunks(requested: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks of requested (doc_id, source_file): by id, or by file name when the id has none; document
    order, all of them or the first ``limit``."""
    by_id = requested.select("doc_id").join(chunks, "doc_id")
    missing = requested.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
    by_file = (missing.select(F.col("doc_id").alias("_want"), basename(F.col("source_file")).alias("source_file"))
               .join(chunks.drop("doc_id"), "source_file").withColumnRenamed("_want", "doc_id"))
    both = by_id.unionByName(by_file.select(*by_id.columns))
    order = [F.asc_nulls_last("chunk_index"), F.asc("chunk_id")]
    if limit is None:
        return both.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return top_k(both, ["doc_id"], order, limit, "position")


def doc_outline(chunks: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Outline per document: "- title: summary" lines in order, whole or cut to ``max_chars``.

    Lines are at most as many as the document has chunks, so the group is bounded by one document.
    """
    label = F.coalesce("section_title", F.concat(F.lit("Section "), F.col("chunk_index").cast("string")))
    summary = F.trim(F.coalesce("chunk_summary", F.lit("")))
    line = F.concat(F.lit("- "), label, F.when(summary != "", F.concat(F.lit(": "), summary)).otherwise(""))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", line.alias("line")))).alias("l")).select(
        "doc_id", (text if max_chars is None else F.substring(text, 1, max_chars)).alias("outline"))


def even_sample(chunks: DataFrame, n: int = 8) -> DataFrame:
    """At most ``n`` evenly spaced chunks per document: positions floor(i · len / n).

    Positions are counted, since ``chunk_index`` has gaps where a page was empty. Only ids and positions are shuffled;
    the few sampled chunks meet their rows again by id.
    """
    ids = chunks.select("doc_id", "chunk_index", "chunk_id")
    own = Window.partitionBy("doc_id")
    placed = ids.withColumns({"_at": F.row_number().over(own.orderBy("chunk_index", "chunk_id")).cast("bigint") - 1,
                              "_len": F.count("*").over(own)})
    take = F.least(F.col("_len"), F.lit(n))
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), take - 1), lambda i: F.floor(i * (F.col("_len") / take)))
    return chunks.join(placed.filter(F.array_contains(at, F.col("_at"))).select("chunk_id"), "chunk_id", "left_semi")


def scope_escape(results: DataFrame) -> DataFrame:
    """Add ``scope_escaped``: a question scoped to documents was answered from a wider level."""
    scoped = F.size(F.coalesce("scope_doc_ids", F.array().cast("array<bigint>"))) > 0
    return results.withColumn("scope_escaped", scoped & (F.col("level") != 1))
