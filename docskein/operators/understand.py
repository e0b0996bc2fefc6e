"""Query understanding as column expressions over a table of questions (``query_id, text``)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.ranking import top_k
from docskein.functions.text import fold_spaces, keyword_hits, needs_nfc, nfc, words


def normalise(queries: DataFrame) -> DataFrame:
    """Add ``cleaned``: NFC, whitespace folded. Only texts that can change under NFC travel to Python."""
    composed = F.coalesce(nfc(F.when(needs_nfc(F.col("text")), F.col("text"))), F.col("text"))
    return queries.withColumn("cleaned", fold_spaces(composed))


def scrub(queries: DataFrame) -> DataFrame:
    """Add ``safe`` with e-mails and phone numbers labelled, and ``pii_types``."""
    mail = F.col("cleaned").rlike(fixed.QUERY_EMAIL)
    no_mail = F.regexp_replace("cleaned", fixed.QUERY_EMAIL, "<EMAIL_REDACTED>")
    return queries.withColumn("safe", F.regexp_replace(no_mail, fixed.QUERY_PHONE, "<PHONE_REDACTED>")).withColumn(
        "pii_types", F.array_compact(F.array(F.when(mail, "email"), F.when(no_mail.rlike(fixed.QUERY_PHONE), "phone"))))


def intent_rule(lowered: Column, fold_case: bool = False) -> Column:
    """Intent of the first matching rule family, or null.

    Rules hold upper-case alternatives that never match lowered text; ``fold_case`` makes them match.
    """
    flag = "(?i)" if fold_case else ""
    rule = None
    for name, patterns in fixed.INTENT_RULES:
        hit = lowered.rlike(flag + patterns[0])
        for p in patterns[1:]:
            hit = hit | lowered.rlike(flag + p)
        if name == "TICKET_ANALYTICS_FOLLOW_UP":
            hit, name = hit & ~lowered.rlike(fixed.FIRST_PERSON), "TICKET_ANALYTICS"
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return rule


def intent_signal(lowered: Column) -> Column:
    """struct(intent, score) of the best keyword family; the earlier family wins a tie; null without hits."""
    scored = []
    for i, (name, signals) in enumerate(fixed.INTENT_SIGNALS):
        hits = keyword_hits(lowered, signals)
        score = F.when(hits > 0, F.round(F.least(F.lit(0.50) + hits * F.lit(0.12), F.lit(0.85)), 6))
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("tie"), F.lit(name).alias("intent")))
    return F.array_max(F.filter(F.array(*scored), lambda s: s["score"].isNotNull()))


def intents(queries: DataFrame) -> DataFrame:
    """Add intent, intent_confidence, low_confidence and needs_clarification."""
    lowered = F.lower("safe")
    q = queries.withColumns({"_rule": intent_rule(lowered), "_sig": intent_signal(lowered)})
    use = (F.col("_sig.score") >= 0.55) & F.col("_rule").isNull()
    use = F.coalesce(use, F.lit(False))
    conf = (F.when(F.col("_rule").isNotNull(), fixed.INTENT_RULE_CONFIDENCE)
            .when(use, F.col("_sig.score")).otherwise(0.95))
    return q.withColumns({
        "intent": F.coalesce("_rule", F.when(use, F.col("_sig.intent")), F.lit("SEARCH")),
        "intent_confidence": conf,
        "low_confidence": F.when(F.col("_rule").isNotNull(), False).when(use, F.col("_sig.score") < 0.70).otherwise(True),
        "needs_clarification": conf < 0.55,
    }).drop("_rule", "_sig")


def ticket_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.TICKET_ID), F.lit(1))


def structural_filters(queries: DataFrame) -> DataFrame:
    """Add ``doc_type_filter`` and ``ticket_ids`` for ticket lookups."""
    lookup = F.col("intent") == "TICKET_LOOKUP"
    return queries.withColumns({
        "doc_type_filter": F.when(lookup, "Ticket"),
        "ticket_ids": F.when(lookup, ticket_ids(F.col("safe"))).otherwise(F.array().cast("array<string>")),
    })


def _named_hits(lowered: Column, table: list[tuple[str, list[str]]]) -> Column:
    """Names whose keywords occur, in table order. Keywords keep their case, so upper-case ones never match."""
    def hit(keywords: list[str]) -> Column:
        cond = lowered.contains(keywords[0])
        for k in keywords[1:]:
            cond = cond | lowered.contains(k)
        return cond

    return F.array_compact(F.array(*[F.when(hit(kws), name) for name, kws in table]))


def soft_weights(queries: DataFrame) -> DataFrame:
    """Add repositories, departments and their preference maps. They rank; they never filter."""
    lowered = F.lower("safe")
    q = queries.withColumns({"repositories": _named_hits(lowered, fixed.REPOSITORY_WORDS),
                             "departments": _named_hits(lowered, fixed.DEPARTMENT_WORDS)})
    weigh = lambda names, w: F.map_from_arrays(names, F.array_repeat(F.lit(w), F.size(names)))
    return q.withColumns({"repository_weight": weigh(F.col("repositories"), fixed.REPOSITORY_WEIGHT),
                          "department_weight": weigh(F.col("departments"), fixed.DEPARTMENT_WEIGHT)})


def _first_synonyms(lowered: Column, table) -> Column:
    found = None
    for key, synonyms in table:
        value = F.array(*[F.lit(s) for s in synonyms[:3]])
        found = F.when(lowered.contains(key), value) if found is None else found.when(lowered.contains(key), value)
    return F.coalesce(found, F.array().cast("array<string>"))


def expand(text: Column) -> Column:
    """The query and up to three synonyms of the first known term that it does not already contain."""
    lowered = F.lower(text)
    fresh = F.filter(_first_synonyms(lowered, fixed.EXPANSIONS), lambda s: ~F.contains(lowered, s))
    return F.slice(F.array_distinct(F.concat(F.array(text), fresh)), 1, 4)


def expand_with_repository(text: Column, repositories: Column) -> Column:
    """Variant with a repository prefix when exactly one repository is named; at most five."""
    lowered = F.lower(text)
    repo = F.lower(F.get(repositories, F.lit(0)))
    prefix = F.when((F.size(repositories) == 1) & ~F.contains(lowered, repo), F.array(F.concat(repo, F.lit(" "), text)))
    parts = F.concat(F.array(text), _first_synonyms(lowered, fixed.REPOSITORY_EXPANSIONS),
                     F.coalesce(prefix, F.array().cast("array<string>")))
    return F.slice(F.array_distinct(parts), 1, 5)


def decompose(text: Column) -> Column:
    """Two sub-queries around a comparison word, or around a strong conjunction in more than 12 words; else empty."""
    def halves(pattern: str) -> list[Column]:
        whole = r"(?is)^(.*?)" + pattern + r"(.*)$"
        return [F.trim(F.regexp_extract(text, whole, 1)), F.trim(F.regexp_extract(text, whole, 3))]

    def both_long(parts: list[Column]) -> Column:
        return (F.length(parts[0]) > 5) & (F.length(parts[1]) > 5)

    comparison, conjunction = halves(fixed.COMPARISONS), halves(fixed.CONJUNCTIONS)
    lowered = F.lower(text)
    return (F.when(lowered.rlike(fixed.COMPARISONS) & both_long(comparison), F.array(*comparison))
            .when(lowered.rlike(fixed.CONJUNCTIONS) & (F.size(words(text)) > 12) & both_long(conjunction),
                  F.array(*conjunction))
            .otherwise(F.array().cast("array<string>")))


def route_repositories(queries: DataFrame, keep: int = 2) -> DataFrame:
    """Best repositories per query by keyword hits plus 3 for a mentioned department; one row per (query, rank)."""
    lowered = F.lower("safe")
    scores = []
    for i, (repo, kws) in enumerate(fixed.ROUTING_WORDS):
        depts = [d for d, r in fixed.DEPARTMENT_REPOSITORY.items() if r == repo]
        named = F.lit(0)
        for d in depts:
            named = named + F.when(F.array_contains("departments", d), 3).otherwise(0)
        hits = keyword_hits(lowered, kws)
        # repositories found by keyword come before those only named by a department, each in table order
        scores.append(F.struct((hits + named).alias("score"), F.when(hits > 0, 0).otherwise(1).alias("late"),
                               F.lit(i).alias("ordinal"), F.lit(repo).alias("repository")))
    rows = queries.select("query_id", F.explode(F.filter(F.array(*scores), lambda s: s["score"] > 0)).alias("s")).select(
        "query_id", "s.*")
    return top_k(rows, ["query_id"], [F.desc("score"), F.asc("late"), F.asc("ordinal")], keep).select(
        "query_id", "repository", "score", "rank")


def ambiguous(text: Column) -> Column:
    """At most three words, or at least 30 % vague words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0))
    vague = F.size(F.filter(found, lambda w: w.isin(*fixed.VAGUE_WORDS)))
    return (F.size(words(text)) <= 3) | F.coalesce(
        F.when(F.size(found) > 0, vague / F.size(found) >= 0.3), F.lit(False))


def hyde_trigger(queries: DataFrame, first_pass: DataFrame) -> DataFrame:
    """Add ``use_passage``: the first internal hit is weak, or the query is vague or short.

    ``first_pass(query_id, cosine)`` holds the best internal score. A passage text, where used, is an input column.
    """
    q = queries.join(first_pass.select("query_id", F.col("cosine").alias("first_pass_score")), "query_id", "left")
    score = F.coalesce("first_pass_score", F.lit(0.0))
    return q.withColumn("first_pass_score", score).withColumn(
        "use_passage", (score < fixed.INTERNAL_MIN_COSINE) | (score < fixed.LOW_CONFIDENCE)
        | ambiguous(F.col("cleaned")) | (F.size(words(F.col("cleaned"))) < 5))


def fanout(primary: Column, expanded: Column, sub_queries: Column) -> Column:
    """Texts to search: the primary one, two expansions, two sub-queries, without repeats."""
    return F.array_distinct(F.concat(F.array(primary), F.slice(expanded, 2, 2), F.slice(sub_queries, 1, 2)))


def _first_word(lowered: Column, table: list[tuple[str, str]]) -> Column:
    found = None
    for word, value in table:
        cond = lowered.rlike(rf"\b{re.escape(word)}\b")
        found = F.when(cond, value) if found is None else found.when(cond, value)
    return found


def ticket_filters(text: Column) -> Column:
    """struct(status, priority, category) named in a question; longer status words are tried first."""
    lowered = F.lower(text)
    return F.struct(_first_word(lowered, fixed.FILTER_STATUS).alias("status"),
                    _first_word(lowered, fixed.FILTER_PRIORITY).alias("priority"),
                    _first_word(lowered, fixed.FILTER_CATEGORY).alias("category"))


def describe_filters(f: Column) -> Column:
    """Readable label of a ticket filter."""
    return F.concat_ws(
        " ", F.concat(F.lower(f["priority"]), F.lit(" priority")), F.replace(f["status"], F.lit("_"), F.lit(" ")),
        F.lit("tickets"), F.concat(F.lit("in "), f["category"]))


def understand(queries: DataFrame) -> DataFrame:
    """All steps in one projection chain over the questions."""
    q = soft_weights(structural_filters(intents(scrub(normalise(queries)))))
    return q.withColumns({"expanded": expand(F.col("safe")), "sub_queries": decompose(F.col("safe"))})


