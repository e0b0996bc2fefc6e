"""Quality by hierarchical empirical Bayes: classifier evidence of a document with posteriors of its host and path.

The classifier is a naive Bayes over hashed byte n-grams, fitted on a bounded sample of labelled rows (``SAMPLE`` per
class). Its evidence is the mean log-likelihood ratio of a text, cut into ``BINS`` bins of equal labelled mass; a bin's
smoothed counts of good and bad labelled rows give the log Bayes factor of the documents in it.

Hosts and paths are grouped aggregates. Every document counts with its label or else with its probability under the
evidence. A host's posterior mean is (good + k * global) / (n + k), a path's (good + k' * host) / (n + k'); the strengths
k and k' come by the method of moments from the spread of the group means beyond their sampling noise, so sites with few
documents shrink to the level above. A document's own count is left out of its site's. The final log odds are those of
its path plus its evidence.

Defined cases: a null or empty text has evidence 0 and takes its site's probability. Null hosts and paths are groups of
their own. Without labels of both classes every probability is the prior of .5 and everything is kept. Labels that repeat
count once, with the lowest quality. Rows without ``doc_id`` are unlabelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch, same
from docskein.llm.quality import labelled_sample
from docskein.llm.words import per_doc, slices, text_bytes
from docskein.session import stored

SAMPLE = 2000  # labelled rows per class that fit the classifier
BITS, BINS = 17, 40
MIN_PROBABILITY = 0.5
STRENGTH = (2.0, 1000.0)  # bounds of the strengths of priors


def _grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every window of five bytes, first window of each document)."""
    n = len(buf)
    if n < 5:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    b = buf.astype(np.uint64)
    key = b[:-4] | b[1:-3] << np.uint64(8) | b[2:-2] << np.uint64(16) | b[3:-1] << np.uint64(24) | b[4:] << np.uint64(32)
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    keep = np.ones(len(bucket), dtype=bool)
    for back in (1, 2, 3, 4):  # windows that would reach into the next text
        at = offsets[1:] - back
        keep[at[(at >= offsets[:-1]) & (at < len(bucket))]] = False
    return bucket[keep], np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - 4, 0))])


def _ratios(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    bucket, first = _grams(*text_bytes(texts))
    return per_doc(table[bucket], first) / np.maximum(np.diff(first), 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[dict | None, DataFrame]:
    """(classifier, one label per id). Fitted in one task on the bounded sample."""
    sample, one = labelled_sample(docs, labels, per_class)
    counts = {r["quality"]: r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None, one
    prior = counts[1] / (counts[0] + counts[1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").drop_duplicates("doc_id")
        y = pdf["quality"].to_numpy()
        if len(y) < 20 or y.min() == y.max():
            return pd.DataFrame({"table": [None], "edges": [None], "factor": [None]})
        texts, fold = pdf["text"].tolist(), np.arange(len(y)) % 2

        def train(rows: np.ndarray) -> np.ndarray:
            share = []
            for c in (0, 1):
                count = np.full(1 << BITS, 0.05)
                for i in rows[y[rows] == c]:
                    bucket, _ = _grams(*text_bytes(pa.array([texts[i]])))
                    if len(bucket):  # every document weighs the same
                        count += np.bincount(bucket, minlength=1 << BITS) * (500 / len(bucket))
                share.append(count / count.sum())
            return np.log(share[1] / share[0])

        # bins from ratios of rows that the table in use has not seen
        ratio = np.empty(len(y))
        for f in (0, 1):
            table = train(np.flatnonzero(fold != f))
            for i in np.flatnonzero(fold == f):
                ratio[i] = _ratios(pa.array([texts[i]]), table)[0]
        edges = np.unique(np.quantile(ratio, np.linspace(0, 1, BINS + 1)[1:-1]))
        bin_ = np.searchsorted(edges, ratio, side="right")
        good = np.bincount(bin_[y == 1], minlength=len(edges) + 1) + 0.5
        bad = np.bincount(bin_[y == 0], minlength=len(edges) + 1) + 0.5
        # factors rise with the ratio: pool neighbours that do not
        blocks = [[g, b, 1] for g, b in zip(good / good.sum(), bad / bad.sum(), strict=True)]
        k = 1
        while k < len(blocks):
            if blocks[k][0] * blocks[k - 1][1] < blocks[k - 1][0] * blocks[k][1]:
                nxt = blocks.pop(k)
                blocks[k - 1] = [x + z for x, z in zip(blocks[k - 1], nxt, strict=True)]
                k = max(1, k - 1)
            else:
                k += 1
        factor = np.repeat([np.log(g / b) for g, b, _ in blocks], [n for *_, n in blocks])
        return pd.DataFrame({"table": [train(np.arange(len(y))).astype(np.float32).tobytes()], "edges": [edges.tolist()], "factor": [factor.tolist()]})

    found = sample.groupBy().applyInPandas(run, "table binary, edges array<double>, factor array<double>").collect()
    if not found or found[0]["table"] is None:
        return None, one
    return {"table": np.frombuffer(found[0]["table"], dtype=np.float32), "edges": np.array(found[0]["edges"]),
            "factor": np.array(found[0]["factor"]), "prior": prior}, one


def evidence(docs: DataFrame, model: dict | None, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, evidence): log Bayes factor of good quality of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            found = np.zeros(rows.num_rows)
            if model is not None:
                ratio = _ratios(rows.column(3), model["table"].astype(np.float64))
                found = model["factor"][np.searchsorted(model["edges"], ratio, side="right")]
                found = np.where(np.diff(text_bytes(rows.column(3))[1]) >= 5, found, 0.0)
            yield batch(schema, rows.column(0), rows.column(1), rows.column(2), found)

    return docs.select(F.col("doc_id").cast("long"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                       F.col("text").cast("string")).mapInArrow(run, "doc_id long, host string, path string, evidence double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str) -> Column:
    """Strength of the prior: moments of the group means around ``mean``, as a scalar subquery."""
    q = F.col(mean)
    noise = q * (1 - q) / F.col("n")
    gap = (F.col("good") / F.col("n") - q) ** 2
    between = F.greatest(F.sum(F.col("n") * (gap - noise)) / F.sum("n"), F.lit(1e-9))
    within = F.sum(F.col("n") * q * (1 - q)) / F.sum("n")
    k = F.least(F.greatest(within / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
    return F.coalesce(groups.agg(k.alias("k")).scalar(), F.lit(STRENGTH[1]))


def posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """(doc_id, host, path, evidence, host_quality, path_quality, probability, kept) of every row of ``docs``."""
    model, one = fit(docs, labels)
    prior = min(max(model["prior"] if model else 0.5, 1e-3), 1 - 1e-3)
    rows = stored(evidence(docs, model, host, path), "evidence")
    known = one.select(F.col("doc_id").alias("_id"), "quality")
    # the soft count of a document: its label, else its probability before its site is known
    alone = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(float(np.log(prior / (1 - prior)))))))
    rows = stored(rows.join(known, F.col("doc_id") == F.col("_id"), "left").withColumn(
        "soft", F.coalesce(F.col("quality").cast("double"), alone)).drop("_id", "quality"), "soft")
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("soft").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = paths.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("q")).scalar()
    hosts = stored(hosts.withColumn("q", whole), "hosts")
    hosts = hosts.select(F.col("host").alias("_host"), F.col("n").alias("host_n"), F.col("good").alias("host_good"), "q",
                         _strength(hosts, "q").alias("host_k"))
    host_mean = (F.col("host_good") + F.col("host_k") * F.col("q")) / (F.col("host_n") + F.col("host_k"))
    paths = stored(paths.join(hosts, same("host", "_host")).drop("_host").withColumn("host_quality", host_mean), "path-hosts")
    table = paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "good", "host_n", "host_good", "host_k", "q",
                         "host_quality", _strength(paths, "host_quality").alias("path_k"))
    out = rows.join(table, same("host", "_host") & same("path", "_path")).drop("_host", "_path")
    # a document does not vouch for its own site
    own_host = (F.col("host_good") - F.col("soft") + F.col("host_k") * F.col("q")) / (F.col("host_n") - 1 + F.col("host_k"))
    own_path = (F.col("good") - F.col("soft") + F.col("path_k") * own_host) / (F.col("n") - 1 + F.col("path_k"))
    own_path = F.least(F.greatest(own_path, F.lit(1e-6)), F.lit(1 - 1e-6))
    p = 1 / (1 + F.exp(-(F.col("evidence") + _logit(own_path))))
    path_mean = (F.col("good") + F.col("path_k") * F.col("host_quality")) / (F.col("n") + F.col("path_k"))
    return out.select("doc_id", "host", "path", "evidence", "host_quality", path_mean.alias("path_quality"), p.alias("probability"),
                      (p >= min_probability).alias("kept"))
