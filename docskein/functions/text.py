"""Text expressions, all JVM-side except Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docskein.functions.fixed import STOP_WORDS

# letters and digits of any script; spelled out because \w is ASCII in Java and RE2 but Unicode in Python
TOKEN = r"[a-z0-9][\p{L}\p{N}_.\-]*"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Catalyst merges a projection into the next one when a column is used once, even when that use sits inside a lambda
    that runs per element; binding the value as a lambda variable keeps it to one evaluation per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def basename(path: Column) -> Column:
    """Last part of a path with ``/`` or ``\\`` separators."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def doc_title(source_file: Column) -> Column:
    """File stem with ``_`` and ``-`` read as spaces."""
    return F.translate(F.regexp_replace(source_file, r"\.[^.]*$", ""), "_-", "  ")


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Default length measure for token budgets; any integer expression can take its place."""
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Search tokens: lower case, stop words and single characters dropped, identifiers kept whole."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def any_keyword(lowered: Column, keywords: list[str]) -> Column:
    """Any keyword occurs as a substring."""
    hit = lowered.contains(keywords[0].lower())
    for k in keywords[1:]:
        hit = hit | lowered.contains(k.lower())
    return hit


def keyword_hits(lowered: Column, keywords: list[str]) -> Column:
    """Number of keywords that occur as substrings."""
    hits = F.lit(0)
    for k in keywords:
        hits = hits + lowered.contains(k).cast("int")
    return hits


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no built-in for it."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def needs_nfc(text: Column) -> Column:
    """Only text outside Latin-1 can change under NFC."""
    return text.rlike(r"[^\x00-\xFF]")


def fold_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))
