"""Pseudonymisation of personal data with built-in expressions.

For each pattern in order the text is split at its matches; the gaps are zipped with one token per match and joined
again. Eight such columns in a chain, all narrow: no UDF and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.text import let

HIT = "array<struct<pii_type:string,token:string,value:string>>"


def hash_token(prefix: str, value: Column, salt: str, token_hex: int) -> Column:
    """Same value, same token: salted SHA-256 of the trimmed, lower-cased value."""
    digest = F.sha2(F.concat(F.lit(salt), F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))), 256)
    return F.concat(F.lit(f"{prefix}_HASH_"), F.upper(F.substring(digest, 1, token_hex)))


def technical_context(doc_type: Column, department: Column) -> Column:
    """Operational content whose addresses and extensions must survive."""
    return F.coalesce(department.isin(*fixed.TECHNICAL_DEPARTMENTS), F.lit(False)) | F.coalesce(
        doc_type.isin(*fixed.TECHNICAL_DOC_TYPES), F.lit(False))


def pseudonymise(docs: DataFrame, text: str = "text", salt: str = "docskein", token_hex: int = 6,
                 skip: Column | None = None, parity_card: bool = False, spans: str | None = None) -> DataFrame:
    """Replace personal data in ``text`` by tokens and add ``pii_hits`` (type, token, value) in order of replacement.

    ``skip`` is true for rows whose IP addresses and phone numbers stay. ``token_hex`` is the token length; six digits
    collide at about five thousand distinct values, so use 16 on a large corpus. ``spans`` names an optional array
    column of (start, length, type) found by a model; those are replaced before the patterns.
    """
    state = F.struct(F.col(text).alias("text"), F.array().cast(HIT).alias("hits"))
    if spans is not None:
        state = _replace_spans(F.col(text), F.col(spans), salt, token_hex)
    for pii_type, prefix, pattern in fixed.PII_PATTERNS:
        if pii_type == "credit_card" and parity_card:
            pattern = fixed.PARITY_CARD_PATTERN
        keep = skip if pii_type in fixed.TECHNICAL_TYPES else None
        # each stage reads the one before as a lambda variable, so the expression stays linear in the number of patterns
        state = let(state, _stage(pii_type, prefix, pattern, keep, salt, token_hex))
    out = docs.withColumn("_pii", state)
    return out.withColumn(text, F.col("_pii.text")).withColumn("pii_hits", F.col("_pii.hits")).drop("_pii")


def _stage(pii_type: str, prefix: str, pattern: str, keep: Column | None, salt: str, token_hex: int):
    """Function from struct(text, hits) to the same struct with one pattern replaced."""
    def run(cur: Column) -> Column:
        on = cur["text"].rlike(pattern)
        if keep is not None:
            on = on & ~keep
        found = F.regexp_extract_all(cur["text"], F.lit(pattern), F.lit(0))
        hits = F.transform(found, lambda v: F.struct(
            F.lit(pii_type).alias("pii_type"), hash_token(prefix, v, salt, token_hex).alias("token"), v.alias("value")))

        def replace(h: Column) -> Column:
            parts = F.zip_with(F.split(cur["text"], pattern, -1), h,
                               lambda g, t: F.concat(g, F.coalesce(t["token"], F.lit(""))))
            return F.struct(F.array_join(parts, "").alias("text"), F.concat(cur["hits"], h).alias("hits"))

        return F.when(on, let(hits, replace)).otherwise(cur)

    return run


def _replace_spans(text: Column, spans: Column, salt: str, token_hex: int) -> Column:
    """Replace (start, length, type) spans, 1-based and not overlapping, from the last to the first."""
    state = f"struct<text:string,hits:{HIT}>"
    kind = F.lit("_HASH_")

    def step(acc: Column, s: Column) -> Column:
        value = F.substr(text, s["start"], s["length"])
        digest = F.upper(F.substring(F.sha2(F.concat(F.lit(salt), F.lower(F.trim(value))), 256), 1, token_hex))
        token = F.concat(F.upper(s["type"]), kind, digest)
        return F.struct(
            F.concat(F.substr(acc["text"], F.lit(1), s["start"] - 1), token,
                     F.substr(acc["text"], s["start"] + s["length"])).alias("text"),
            F.concat(F.array(F.struct(s["type"].alias("pii_type"), token.alias("token"), value.alias("value"))),
                     acc["hits"]).alias("hits")).cast(state)

    ordered = F.reverse(F.array_sort(F.coalesce(spans, F.array().cast("array<struct<start:int,length:int,type:string>>"))))
    return F.aggregate(ordered, F.struct(text.alias("text"), F.array().cast(HIT).alias("hits")).cast(state), step)


def hash_map(hits: Column) -> Column:
    """token → type map that travels with a chunk; it holds no original value."""
    return F.map_from_entries(F.array_distinct(F.transform(hits, lambda h: F.struct(h["token"], h["pii_type"]))))


def audit(redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Replacements per (document, type)."""
    return (redacted.select(key, F.explode("pii_hits").alias("h"))
            .groupBy(key, F.col("h.pii_type").alias("pii_type")).agg(F.count("*").alias("n")))


def vault(redacted: DataFrame) -> DataFrame:
    """Protected table token → original, first occurrence kept, keyed on (token, normalised value)."""
    hits = redacted.select("doc_id", F.posexplode("pii_hits").alias("pos", "h")).select("doc_id", "pos", "h.*")
    first = F.min_by(F.struct("value", "doc_id"), F.struct("doc_id", "pos"))
    return (hits.groupBy("token", "pii_type", F.lower(F.trim("value")).alias("normalised"))
            .agg(first.alias("f"), F.count("*").alias("uses"))
            .select("token", "pii_type", F.col("f.value").alias("original_value"), F.col("f.doc_id").alias("doc_id"), "uses"))


def collisions(vault_rows: DataFrame) -> DataFrame:
    """Tokens that stand for more than one value."""
    return vault_rows.groupBy("token").agg(F.count("*").alias("n_values")).filter("n_values > 1")
