"""Usage, evaluation and knowledge-gap metrics over a query log. Every clock is the ``as_of`` argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions.ranking import latest, top_k, value_at_fraction


def within(ts: str, as_of: str, days: int) -> Column:
    """``ts`` newer than ``as_of`` minus ``days``; a plain comparison with a literal, so it reaches the scan."""
    return F.col(ts) > F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))


def lookback(log: DataFrame, as_of: str, days: int, ts: str = "ts") -> DataFrame:
    return log.filter(within(ts, as_of, days))


def ratio(num: Column, den: Column) -> Column:
    """``num/den`` as double, 0 when the denominator is 0."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def dashboard_overall(log: DataFrame) -> DataFrame:
    n = F.count("*")
    low = F.count_if(F.col("low_confidence"))
    return log.agg(
        n.alias("total_queries"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("avg_latency_ms"),
        F.round(F.coalesce(F.avg("chunks_retrieved"), F.lit(0.0)), 6).alias("avg_chunks"),
        low.alias("low_confidence_count"),
        F.round(ratio(low, n), 6).alias("low_confidence_rate"),
    )


def repo_usage(log: DataFrame) -> DataFrame:
    return (log.select(F.explode("repositories_searched").alias("repository"))
            .groupBy("repository").agg(F.count("*").alias("queries")))


def daily_queries(log: DataFrame) -> DataFrame:
    return (log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
            .agg(F.count("*").alias("queries"), F.round(F.avg("confidence"), 6).alias("avg_confidence")))


def intent_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy("intent").agg(F.count("*").alias("queries"))


def recent_queries(log: DataFrame, per_user: int = 10) -> DataFrame:
    """Latest queries of every user."""
    cols = ["user_id", "id", "query_text", "intent", "confidence", "latency_ms", "ts"]
    return top_k(log.select(*cols), ["user_id"], [F.desc("ts"), F.desc("id")], per_user)


def reconstruct_scores(log: DataFrame) -> DataFrame:
    """Score list of a logged query: its top score, then the confidence falling by .05 per further chunk (≤ 5)."""
    n = F.least(F.coalesce(F.col("chunks_retrieved"), F.lit(1)), F.lit(5))
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    rest = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1),
                                     lambda i: F.greatest(F.lit(0.0), conf - F.lit(0.05) * i)))
    return log.withColumn(
        "top_scores",
        F.concat(F.array(F.coalesce(F.col("reranker_top_score"), F.lit(0.0))),
                 F.coalesce(rest, F.array().cast("array<double>"))),
    ).withColumn("total_candidates", F.greatest(F.coalesce(F.col("chunks_retrieved"), F.lit(0)) * 3, F.lit(5)))


def precision_recall(scored: DataFrame, threshold: float = 0.50, k: int = 5) -> DataFrame:
    """P@k, approximate R@k, MRR and hit rate with score ≥ threshold as relevance."""
    head = F.slice("top_scores", 1, k)
    rel = F.size(F.filter(head, lambda s: s >= threshold))
    first = F.array_position(F.transform(head, lambda s: s >= threshold), F.lit(True))
    row = scored.select(
        rel.alias("rel"),
        ratio(rel, F.size(head)).alias("prec"),
        F.when(first > 0, 1.0 / first).otherwise(0.0).alias("rr"),
        F.col("total_candidates").alias("cand"),
    )
    recall = F.least(F.avg("rel") / F.greatest(F.avg("cand") * 0.3, F.lit(1.0)), F.lit(1.0))
    return row.agg(
        F.count("*").alias("total_evaluated"),
        F.round(F.avg("prec"), 6).alias("precision_at_k"),
        F.round(recall, 6).alias("recall_at_k"),
        F.round(F.avg("rr"), 6).alias("mrr"),
        F.round(F.avg((F.col("rel") > 0).cast("double")), 6).alias("hit_rate"),
    )


def latency_profile(log: DataFrame) -> DataFrame:
    """Mean, p95 and p99 latency; the percentile is ``sorted[floor(n·p)]``."""
    ranks = value_at_fraction(log, "latency_ms", {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99})
    mean = log.agg(F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"))
    return ranks.select(mean.scalar().alias("avg_latency_ms"), "p95_latency_ms", "p99_latency_ms")


def buckets(score: Column, edges: tuple[float, float, float]) -> list[Column]:
    """Counts of scores in the four bands cut at ``edges`` (high to low)."""
    hi, mid, lo = edges
    return [
        F.count_if(score >= hi).alias("high"),
        F.count_if((score >= mid) & (score < hi)).alias("medium"),
        F.count_if((score >= lo) & (score < mid)).alias("low"),
        F.count_if(score < lo).alias("very_low"),
    ]


def eval_confidence(scored: DataFrame) -> DataFrame:
    best = F.array_max("top_scores")
    return scored.agg(
        F.round(F.avg(best), 6).alias("avg_confidence"),
        F.round(F.avg(F.col("low_confidence").cast("double")), 6).alias("low_confidence_rate"),
        *buckets(best, (0.75, 0.55, 0.35)),
    )


def eval_simple(log: DataFrame, last: int = 500) -> DataFrame:
    """Metrics over the ``last`` logged queries; the report is defined on that tail."""
    tail = log.orderBy(F.desc("ts"), F.desc("id")).limit(last)
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    p95 = value_at_fraction(tail, "latency_ms", {"p95": 0.95}).scalar()
    return tail.agg(
        F.count("*").alias("total_evaluated"),
        F.round(F.avg((conf >= 0.5).cast("double")), 6).alias("hit_rate"),
        F.round(F.avg(conf), 6).alias("avg_confidence"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.round(F.avg(F.col("low_confidence").cast("double")), 6).alias("low_confidence_rate"),
        *buckets(conf, (0.75, 0.50, 0.35)),
    ).withColumn("p95_latency_ms", p95)


def bucket_share(bucket_row: DataFrame) -> DataFrame:
    """Share of each confidence band in the total, one row per band."""
    total = F.greatest(F.col("high") + F.col("medium") + F.col("low") + F.col("very_low"), F.lit(1))
    return bucket_row.select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n"), F.round(F.col(b) / total, 6).alias("share"))
        for b in ("high", "medium", "low", "very_low")
    ])).alias("s")).select("s.*")


def gap_detect(log: DataFrame, min_chunks: int = 3, min_confidence: float = 0.30) -> DataFrame:
    """Logged queries that count as knowledge gaps."""
    return log.filter(
        (F.col("intent") != "SMALLTALK")
        & ((F.col("chunks_retrieved") < min_chunks) | (F.col("confidence") < min_confidence))
    )


def gap_key(text: Column) -> Column:
    return F.md5(F.lower(F.trim(text)))


def gap_rollup(gaps: DataFrame) -> DataFrame:
    """One row per normalised question: how often it failed, its first wording and when it was last seen."""
    order = F.struct("ts", "id")
    return gaps.groupBy(gap_key(F.col("query_text")).alias("query_hash")).agg(
        F.count("*").alias("frequency"),
        F.min_by("query_text", order).alias("query_text"),
        F.min_by("intent", order).alias("intent"),
        F.max("ts").alias("last_seen"),
        F.min("ts").alias("created_at"),
    )


def gap_resolve(gaps: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Mark gaps named in ``resolutions(query_hash)`` as resolved."""
    done = resolutions.select("query_hash", F.lit(True).alias("_done")).dropDuplicates(["query_hash"])
    return (gaps.join(done, "query_hash", "left")
            .withColumn("resolved", F.coalesce(F.col("_done"), F.lit(False))).drop("_done"))


def gap_list(gaps: DataFrame, limit: int = 20) -> DataFrame:
    return (gaps.filter(~F.col("resolved"))
            .orderBy(F.desc("frequency"), F.desc("last_seen"), "query_hash").limit(limit))


def gap_open_count(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count_if(~F.col("resolved")).alias("open_gaps"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    n, pos = F.count("*"), F.count_if(F.col("rating") == 1)
    return feedback.agg(
        n.alias("total_feedback"),
        pos.alias("positive"),
        F.count_if(F.col("rating") == -1).alias("negative"),
        F.round(ratio(pos, n), 6).alias("satisfaction_rate"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"),
    )


def top_negative_queries(feedback: DataFrame, limit: int = 5) -> DataFrame:
    return (feedback.filter(F.col("rating") == -1).groupBy("query_text").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "query_text").limit(limit))


def audit_metrics(log: DataFrame, action: str, names: list[str]) -> DataFrame:
    """One counter per action name."""
    return log.agg(*[F.count_if(F.col(action) == a).alias(f"n_{a}") for a in names])


def role_union(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Append granted roles to each user's role array, without duplicates."""
    extra = grants.groupBy("user_id").agg(F.array_sort(F.collect_set("resource_name")).alias("_new"))
    none = F.array().cast("array<string>")
    return users.join(extra, "user_id", "left").withColumn(
        "access_roles",
        F.array_union(F.coalesce(F.col("access_roles"), none), F.coalesce(F.col("_new"), none)),
    ).drop("_new")


def faq_votes(votes: DataFrame) -> DataFrame:
    """Net votes per item, counting only the latest vote of each user."""
    last = votes.groupBy("user_id", "faq_id").agg(F.max_by("vote", F.struct("ts", "seq")).alias("vote"))
    return last.groupBy("faq_id").agg(F.sum("vote").alias("net_votes"), F.count("*").alias("voters"))


def latest_draft(issues: DataFrame) -> DataFrame:
    """Latest draft per (user, chat)."""
    drafts = issues.filter(F.col("status") == "draft")
    return latest(drafts, ["user_id", "chat_id"], [F.desc("updated_at"), F.desc("issue_id")])
