"""Fusion, re-ranking and score adjustments. Lists carry ids and scores; chunk attributes join in afterwards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.ranking import top_k


def _by_tier(tier: Column, table: dict[int, float], default: float) -> Column:
    out = F.when(tier == 1, table[1])
    for t in (2, 3, 4):
        out = out.when(tier == t, table[t])
    return out.otherwise(default)


def rrf_fuse(lists: list[tuple[str, DataFrame]], chunk_tiers: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, chunk_id, rank): (query_id, chunk_id, rrf_score, sources).

    The tier boost belongs to the chunk, so it multiplies the sum once, after the lists are merged.
    """
    rows = None
    for no, (name, ranked) in enumerate(lists):
        weight = F.lit(fixed.SOURCE_MULTIPLIER.get(name, 1.0)) / (F.lit(k) + F.col("rank"))
        source = F.col("source") if "source" in ranked.columns else F.lit(name)
        part = ranked.select("query_id", "chunk_id", weight.alias("w"), F.struct(
            F.lit(no).alias("no"), source.alias("source")).alias("src"))
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.groupBy("query_id", "chunk_id").agg(F.sum("w").alias("w"), F.array_sort(F.collect_set("src")).alias("s"))
    boost = _by_tier(F.coalesce("priority_tier", F.lit(3)), fixed.TIER_RRF_BOOST, 1.0)
    return merged.join(chunk_tiers.select("chunk_id", "priority_tier"), "chunk_id", "left").select(
        "query_id", "chunk_id", F.round(F.col("w") * boost, 9).alias("rrf_score"),
        F.array_join(F.transform("s", lambda x: x["source"]), "+").alias("sources"))


def rerank_pool(candidates: DataFrame, pool: int = 44, summary_pool: int = 60) -> DataFrame:
    """Candidates that reach the costly scorer: top 44 per question by fused score, 60 for summaries."""
    ranked = top_k(candidates, ["query_id"], [F.desc("rrf_score"), F.asc("chunk_id")], max(pool, summary_pool),
                   "pool_rank")
    if "intent" not in candidates.columns:
        return ranked.filter(F.col("pool_rank") <= pool)
    return ranked.filter(F.col("pool_rank") <= F.when(F.col("intent") == "SUMMARIZE", summary_pool).otherwise(pool))


def logistic(raw: Column) -> Column:
    return F.round(1.0 / (1.0 + F.exp(-raw)), 6)


def pair_raw(best: Column | None = None) -> Column:
    """Offline stand-in for a pair model, graded from -3 to 3: the lexical score against the question's best one, damped
    where the chunk holds less than a quarter of the question's terms. For rows (query_id, score, overlap); ``best`` names
    the best score of a question where the rows may not hold it."""
    if best is None:
        best = F.max("score").over(Window.partitionBy("query_id"))
    return F.col("score") / best * F.least(F.lit(1.0), F.col("overlap") * 4.0) * 6.0 - 3.0


def score_pairs(pairs: DataFrame, model: Callable[[pd.DataFrame], pd.Series], query: str = "query_text",
                content: str = "content") -> DataFrame:
    """Raw scores of (question, chunk text) pairs from a batch function, which loads once per Python worker."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "raw_score": model(pdf)})

    return pairs.select("query_id", "chunk_id", query, content).mapInPandas(
        run, "query_id bigint, chunk_id bigint, raw_score double")


def age_days(ts: Column, as_of: str) -> Column:
    """Whole days from ``ts`` to ``as_of``, 0 when unknown or in the future."""
    return F.greatest(F.coalesce(F.datediff(F.to_timestamp(F.lit(as_of)), ts), F.lit(0)), F.lit(0))


def freshness_decay(days: Column) -> Column:
    """−.01 per full half year of age, not below −.08."""
    return F.greatest(F.lit(-0.08), F.lit(-0.01) * F.floor(days / 30.0 / 6.0))


def entity_boost(department: Column, repository: Column, content: Column, source_file: Column,
                 keywords: Column | None = None, tech_terms: Column | None = None) -> Column:
    """Soft boost of a chunk for a question's departments, repositories, terms and ticket ids, capped at .30.

    The row holds the question's ``departments, repositories, ticket_ids`` and weight maps.
    """
    none = F.lit(0.0)
    boost = F.when(F.array_contains("departments", department), fixed.BOOST_DEPARTMENT).otherwise(0.0)
    boost = boost + F.when(F.array_contains("repositories", repository), fixed.BOOST_REPOSITORY).otherwise(0.0)
    low, file = F.lower(content), F.lower(source_file)
    if tech_terms is not None:
        kws = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), F.lower)
        hit = F.exists(tech_terms, lambda x: F.array_contains(kws, x) | F.contains(low, x))
        boost = boost + F.when(hit, fixed.BOOST_TERM).otherwise(0.0)
    named = F.exists("ticket_ids", lambda x: F.contains(low, F.lower(x)) | F.contains(file, F.lower(x)))
    boost = boost + F.when(named, fixed.BOOST_TICKET).otherwise(0.0)
    boost = boost + F.coalesce(F.try_element_at("repository_weight", repository), none)
    boost = boost + F.coalesce(F.try_element_at("department_weight", department), none)
    return F.round(F.least(boost, F.lit(fixed.BOOST_CAP)), 6)


def add_final_score(candidates: DataFrame) -> DataFrame:
    """final_score = rerank + tier + freshness + feedback + entity; absent parts count 0."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in candidates.columns else F.lit(0.0)
    tier = _by_tier(F.col("priority_tier"), fixed.TIER_ADDITIVE, 0.0)
    return candidates.withColumn("final_score", F.round(
        F.col("rerank_score") + tier + part("freshness") + part("feedback_boost") + part("entity_boost"), 6))


def select_final(scored: DataFrame, k: int = 8, summary_k: int = 16) -> DataFrame:
    """Rows at or above the threshold, top 8 per question (16 for summaries)."""
    kept = scored.filter(F.col("final_score") >= fixed.FINAL_THRESHOLD)
    order = [F.desc("final_score"), F.asc("chunk_id")]
    if "intent" not in scored.columns:
        return top_k(kept, ["query_id"], order, k, "final_rank")
    ranked = top_k(kept, ["query_id"], order, max(k, summary_k), "final_rank")
    return ranked.filter(F.col("final_rank") <= F.when(F.col("intent") == "SUMMARIZE", max(k, summary_k)).otherwise(k))


def confidence(queries: DataFrame, final: DataFrame) -> DataFrame:
    """Best score and chunk count of every question, including those without any chunk."""
    best = final.groupBy("query_id").agg(F.max("final_score").alias("best"), F.count("*").alias("n"))
    out = queries.select("query_id").join(best, "query_id", "left")
    conf = F.coalesce("best", F.lit(0.0))
    n = F.coalesce("n", F.lit(0))
    return out.select("query_id", conf.alias("confidence"), (conf < fixed.LOW_CONFIDENCE).alias("low_confidence"),
                      n.alias("chunks"), (n < 3).alias("chunk_count_low"))


def trace(queries: DataFrame, lists: dict[str, DataFrame], scored: DataFrame) -> DataFrame:
    """Per question: size of each list, candidates, rerank score range and rows under the threshold."""
    out = queries.select("query_id")
    rows = None
    for name, df in lists.items():
        part = df.select("query_id", F.lit(name).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("query_id").agg(*[F.count_if(F.col("list") == n).alias(f"n_{n}") for n in lists])
    stats = scored.groupBy("query_id").agg(
        F.count("*").alias("reranked"), F.max("rerank_score").alias("rerank_max"), F.min("rerank_score").alias("rerank_min"),
        F.avg("rerank_score").alias("rerank_avg"),
        F.count_if(F.col("final_score") < fixed.FINAL_THRESHOLD).alias("below_threshold"))
    return out.join(sizes, "query_id", "left").join(stats, "query_id", "left").na.fill(0).na.fill(0.0)


def answer_confidence(rows: DataFrame, max_chunks: int = 8) -> DataFrame:
    """Composite confidence from ``top_score, candidates, chunks_used, spread`` with its label."""
    rerank = F.least(F.col("top_score"), F.lit(1.0))
    n = F.col("candidates")
    coverage = (F.when(n >= 20, 1.0).when(n >= 10, 0.75).when(n >= 5, 0.50).when(n >= 2, 0.30).otherwise(0.0))
    fill = F.col("chunks_used") / F.lit(max_chunks)
    step = F.when(fill >= 0.75, 1.0).when(fill >= 0.5, 0.75).when(fill >= 0.25, 0.50).otherwise(0.20)
    step = step * F.when((F.col("chunks_used") >= 2) & (F.col("spread") > 0.40), 0.85).otherwise(1.0)
    overall = F.least(F.lit(0.5) * rerank + F.lit(0.3) * coverage + F.lit(0.2) * step, F.lit(1.0))
    label = (F.when(F.col("overall") >= 0.75, "HIGH").when(F.col("overall") >= 0.55, "MEDIUM")
             .when(F.col("overall") >= 0.35, "LOW").otherwise("VERY_LOW"))
    return rows.withColumns({"rerank_part": F.round(rerank, 3), "coverage_part": F.round(coverage, 3),
                             "fill_part": F.round(step, 3), "overall": F.bround(F.round(overall, 9), 3)}
                            ).withColumn("label", label)
