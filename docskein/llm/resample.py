"""Resampling documents towards a target corpus by importance weights over hashed word n-grams.

Every run of one to ``n`` consecutive words is a feature; its bucket is the CRC-32 of its bytes modulo ``buckets``. A text
is written once as its words joined by single spaces and scanned once for running CRCs; the CRC of any n-gram then comes
from those at its two ends (``crc.py``). Bucket counts of the raw and of the target texts give a gain per bucket, the floored
logarithm of a smoothed ratio; a document's weight is the floored mean gain of its features. Documents are drawn without
replacement by weight plus Gumbel noise from a hash of the id, highest scores first.

Counts cover all texts; a task sends one row per bucket it met. The gains are ``buckets`` numbers whatever the corpus, and
go to the tasks. Places among the drawn are counted by ranges (``ordinals``), so no task ranks the table.

Defined cases: a null or empty text has no words, no features and weight 0. A null id hashes as an empty one and comes
last among equal scores. Rows that repeat are rows of their own; equal rows take neighbouring ranks. An empty table, target or
draw leaves all ranks null and is no error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch
from docskein.llm.crc import Running, substring
from docskein.llm.ordinals import numbered
from docskein.llm.words import LOWER, Words, per_doc, slices, text_bytes, words_in
from docskein.session import ship, stored

BUCKETS, LONGEST, FEWEST_WORDS, DRAW_PERCENT, SEED = 10_000, 2, 20, 25, 7
_BREAK = np.ones(256, dtype=bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False  # 0-9, a-z and every byte of a character beyond ASCII


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of the texts and, per n-gram length, (word at which it starts, bucket)."""
    buf, offsets = text_bytes(texts)
    w = words_in(LOWER[buf], offsets, _BREAK)
    n = len(w.start)
    if n == 0:
        return w, []
    size = w.end - w.start
    end = np.cumsum(size + 1) - 1  # places in the joined text: one separator after each word
    start = end - size
    joined = np.full(int(end[-1]) + 1, 32, dtype=np.uint8)
    kept = np.flatnonzero(~_BREAK[w.buf])
    joined[np.arange(len(kept)) + np.repeat(np.arange(n), size)] = w.buf[kept]
    running = Running(joined)
    before_start, before_end = running.at(start), running.at(end)
    last = np.repeat(w.first[1:], w.counts)  # one past the last word of the document of each word
    out = []
    for k in range(longest):
        at = np.flatnonzero(np.arange(n) + k < last)
        code = substring(before_start[at], before_end[at + k], end[at + k] - start[at])
        out.append((at, (code % np.uint32(buckets)).astype(np.int64)))
    return w, out


def _counter(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for rows in slices(batches):
            for _, code in features(rows.column(0), buckets, longest)[1]:
                total += np.bincount(code, minlength=buckets)
        met = np.flatnonzero(total)
        yield batch(pa.schema([("bucket", pa.int64()), ("n", pa.int64())]), met, total[met])

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all features of all texts; buckets without features are left out."""
    return docs.select(docs["text"].cast("string")).mapInArrow(_counter(buckets, longest), "bucket long, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, gain) for each of the ``buckets``: how much likelier the target texts hold it than the raw ones."""
    ship(docs.sparkSession)
    raw = stored(bucket_counts(docs, buckets, longest), "raw-buckets")
    goal = stored(bucket_counts(target, buckets, longest), "target-buckets")

    def total(t: DataFrame) -> Column:
        return F.coalesce(t.agg(F.sum("n")).scalar(), F.lit(0)).cast("double") + buckets

    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") + 1 for c in ("_s", "_t"))
    ratio = (t * total(raw)) / (s * total(goal))
    return every.join(raw.withColumnRenamed("n", "_s"), "bucket", "left").join(
        goal.withColumnRenamed("n", "_t"), "bucket", "left").select(
        "bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def _weigher(gains: np.ndarray, longest: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            w, found = features(rows.column(1), len(gains), longest)
            number, gain = np.zeros(len(w.start), dtype=np.int64), np.zeros(len(w.start), dtype=np.int64)
            for at, code in found:
                number[at] += 1
                gain[at] += gains[code]
            n, total = per_doc(number, w.first), per_doc(gain, w.first)
            yield batch(schema, rows.column(0), w.counts, n, np.where(n > 0, total // np.maximum(n, 1), 0))

    return run


def weigh(docs: DataFrame, gains: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    table = gains.orderBy("bucket").toArrow()  # one number per bucket
    gain = table.column("gain").to_numpy().astype(np.int64)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        _weigher(gain, longest), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g), g a Gumbel number from the first 32 bits of SHA-256 of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-F.log(-F.log(u)) * 1000)


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT, fewest_words: int = FEWEST_WORDS,
              buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank from 1 among the drawn, else null."""
    gains = stored(bucket_gains(docs, target, buckets, longest), "gains")
    scored = stored(weigh(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= fewest_words
    ranked = numbered(scored.filter(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    drawn = F.floor(scored.filter(able).agg(F.count("*")).scalar() * percent / F.lit(100))
    cols = ["doc_id", "n_words", "n_features", "weight", "score"]
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    return ranked.select(*cols, rank.alias("rank")).unionByName(
        scored.filter(~able).select(*cols, F.lit(None).cast("long").alias("rank")))
