"""Quality rules: base measures of whole texts and a calibrated n-gram logistic regression.

Every document gets the base measures (words, their letters, symbols, repeated lines, repeated three-word windows) and a
score of a logistic regression over hashed word, word-pair and byte n-gram frequencies. The model is trained on a bounded
sample of labelled rows (``SAMPLE`` per class, those of smallest hash), by mini-batches with per-weight step sizes; a
fifth of the sample, held out of training, calibrates its probability, and class counts over all labels correct for the
sample's class balance. Because features are relative frequencies, a score is a mean of weights over a text's n-grams:
scoring reads each text once, in Arrow batches, and keeps a few arrays per slice.

Defined cases: null and empty texts have no words and fail the base rule. Without labels of both classes there is no
verdict of the model and the base rule decides alone. Labels of unknown documents are ignored, null labels too; of labels
that repeat, the lowest quality counts. Rows without ``doc_id`` are scored like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch
from docskein.llm.words import chain, per_doc, slices, words
from docskein.session import stored

SAMPLE = 2000  # labelled rows per class that train and calibrate
BITS = 16  # log2 of the weights of each feature family
MIN_WORDS, MAX_REPEATED = 50, 0.50  # base rule
MIN_PROBABILITY = 0.5  # of good quality
FAMILIES = ("word", "pair", "bytes")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


def features(w, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per family (bucket of every occurrence, first occurrence of each document)."""
    mask = _U((1 << BITS) - 1)
    pair = chain(hashes[:-1], hashes[1:]) if len(hashes) > 1 else hashes[:0]
    crossing = np.zeros(max(0, len(hashes) - 1), dtype=bool)
    inner = w.first[1:-1]
    inner = inner[(inner > 0) & (inner < len(hashes))]
    crossing[inner - 1] = True
    pair = pair[~crossing]
    pairs = np.concatenate([[0], np.cumsum(np.maximum(w.counts - 1, 0))])
    # four bytes at a time, white space included, so that runs of signs and letter case show
    b = w.buf.astype(np.uint32)
    n = len(b)
    gram = (b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)) if n > 3 else b[:0]
    gram = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    # the windows that cross a border belong to the text they begin in, up to three bytes short of its end
    size = np.diff(w.offsets)
    have = np.maximum(size - 3, 0)
    keep = np.ones(len(gram), dtype=bool)
    for back in (1, 2, 3):
        at = w.offsets[1:] - back
        at = at[(at >= w.offsets[:-1]) & (at < len(gram))]
        keep[at] = False
    return [((hashes & mask).astype(np.int64), w.first), ((pair & mask).astype(np.int64), pairs),
            (gram[keep], np.concatenate([[0], np.cumsum(have)]))]


def raw_scores(w, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over families of the mean weight of a document's n-grams."""
    total = np.zeros(len(w.first) - 1)
    for table, (bucket, first) in zip(weights, features(w, hashes), strict=True):
        total += per_doc(table[bucket].astype(np.float64), first) / np.maximum(np.diff(first), 1)
    return total


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, value, row begins) of the training rows, families side by side."""
    rows = []
    for at in range(0, len(texts), 64):
        w = words(pa.array(texts[at:at + 64], pa.large_string()))
        found = features(w, w.hashes())
        for k in range(len(w.first) - 1):
            parts = []
            for family, (bucket, first) in enumerate(found):
                own, n = np.unique(bucket[first[k]:first[k + 1]], return_counts=True)
                parts.append((own + (family << BITS), n / max(1, first[k + 1] - first[k])))
            rows.append((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
    begins = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int64)
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), begins


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str], good: np.ndarray, prior: float, epochs: int = 12, rate: float = 0.5) -> dict:
    """Weights and calibration (slope, shift) from labelled texts; ``prior`` is the share of good rows in all labels."""
    column, value, begins = _sparse(texts)
    held = np.arange(len(texts)) % 5 == 4
    weights, seen, bias = np.zeros(len(FAMILIES) << BITS), np.full(len(FAMILIES) << BITS, 1e-8), 0.0
    fit = np.flatnonzero(~held)
    rng = np.random.Generator(np.random.PCG64(7))
    share = max(1e-6, good[fit].mean()), max(1e-6, 1 - good[fit].mean())
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            size = begins[part + 1] - begins[part]
            at = np.repeat(begins[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            c, v = column[at], value[at]
            first = np.concatenate([[0], np.cumsum(size)])
            p = _sigmoid(per_doc(weights[c] * v, first) + bias)
            g = (p - good[part]) * np.where(good[part] == 1, 0.5 / share[0], 0.5 / share[1]) / len(part)
            own, where = np.unique(c, return_inverse=True)
            grad = np.bincount(where, np.repeat(g, size) * v)
            seen[own] += grad * grad
            weights[own] -= rate * grad / np.sqrt(seen[own])
            bias -= rate * g.sum()
    z = per_doc(weights[column] * value, begins)[held]
    y = good[held]
    # Platt scaling with the classes at their share of all labels, by Newton steps
    weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum())) * len(y)
    scale = max(float(np.std(z)), 1e-6)
    x = np.stack([z / scale, np.ones(len(z))], axis=1)
    ab = np.zeros(2)
    for _ in range(25):
        p = _sigmoid(x @ ab)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-4])
        ab -= np.linalg.solve(hess, x.T @ (weight * (p - y)) + np.array([1e-2, 1e-4]) * ab)
    return {"weights": weights.reshape(len(FAMILIES), -1).astype(np.float32), "slope": float(ab[0] / scale), "shift": float(ab[1])}


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(sample with text and quality, one row per labelled id). The sample holds the ids of smallest hash."""
    one = stored(labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(
        F.col("doc_id").cast("long")).agg(F.min("quality").alias("quality")), "labels")
    picked = None
    for c in (0, 1):
        top = one.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = top if picked is None else picked.unionByName(top)
    # at most 2 * per_class ids, written so that Spark knows how few they are
    picked = stored(picked.select(F.col("doc_id").alias("_id"), "quality"), "sample-ids")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(picked), F.col("doc_id") == F.col("_id")).filter(F.col("text").isNotNull())
    return texts.select("doc_id", "text", "quality"), one


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> dict | None:
    """The model, or None without labelled texts of both classes. Training runs in one task, on the bounded sample."""
    sample, one = labelled_sample(docs, labels, per_class)
    counts = {r["quality"]: r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    prior = counts[1] / (counts[0] + counts[1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").drop_duplicates("doc_id")
        good = pdf["quality"].to_numpy(dtype=np.float64)
        # alternate over classes, so that the held-out fifth has both
        order = np.argsort(np.where(good == 1, np.cumsum(good == 1), np.cumsum(good == 0)), kind="stable")
        if good.min() == good.max() or len(good) < 20:
            return pd.DataFrame({"weights": [None], "slope": [0.0], "shift": [0.0]})
        m = train(pdf["text"].to_numpy()[order].tolist(), good[order], prior)
        return pd.DataFrame({"weights": [m["weights"].tobytes()], "slope": [m["slope"]], "shift": [m["shift"]]})

    found = sample.groupBy().applyInPandas(run, "weights binary, slope double, shift double").collect()
    if not found or found[0]["weights"] is None:
        return None
    weights = np.frombuffer(bytes(found[0]["weights"]), dtype=np.float32).reshape(len(FAMILIES), -1)
    return {"weights": weights, "slope": found[0]["slope"], "shift": found[0]["shift"]}


def repeated_windows(w, hashes: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each document that lie in a window found twice or more in it."""
    n = len(hashes)
    covered = np.zeros(n, dtype=bool)
    if n >= width:
        window = chain(*[hashes[k:n - width + 1 + k] for k in range(width)])
        doc = w.doc
        whole = np.flatnonzero(doc[:n - width + 1] == doc[width - 1:])
        key = chain(window[whole], doc[whole].astype(np.uint64))
        order = np.argsort(key)
        k = key[order]
        twice = np.zeros(len(k), dtype=bool)
        equal = k[1:] == k[:-1]
        twice[1:] |= equal
        twice[:-1] |= equal
        at = whole[order[twice]]
        for step in range(width):
            covered[at + step] = True
    return per_doc(covered, w.first)


def repeated_lines(buf: np.ndarray, offsets: np.ndarray, w) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    from docskein.llm.words import lines_in, span_hashes

    start, end, doc = lines_in(buf, offsets)
    filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[filled], end[filled], doc[filled]
    key = chain(span_hashes(buf, start, end), doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(doc[again], minlength=len(offsets) - 1)


def _assess(model: dict | None, min_words: int, max_repeated: float, min_probability: float):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()),
                        ("probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            w = words(rows.column(1))
            hashes = w.hashes()
            n = w.counts
            points = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
            chars = per_doc(points[w.end] - points[w.start], w.first)
            repeated = repeated_windows(w, hashes)
            failed = (n < min_words) | (repeated > max_repeated * n)
            p = np.ones(len(n)) if model is None else _sigmoid(
                raw_scores(w, hashes, model["weights"]) * model["slope"] + model["shift"])
            yield batch(schema, rows.column(0), n, chars, per_doc(_SYMBOL[w.buf], w.offsets),
                        repeated_lines(w.buf, w.offsets, w), repeated, failed,
                        pa.nulls(len(n), pa.float64()) if model is None else p, ~failed & (p >= min_probability))

    return run


def assess(docs: DataFrame, model: dict | None, min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED,
           min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Base measures, the model's probability of good quality and the verdict for every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _assess(model, min_words, max_repeated, min_probability),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep, in one pass, all columns unchanged."""
    model = fit(docs, labels)
    judge = _assess(model, MIN_WORDS, MAX_REPEATED, MIN_PROBABILITY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            ids = pa.array(np.zeros(rows.num_rows, dtype=np.int64))
            seen = pa.RecordBatch.from_arrays([ids, rows.column(rows.schema.get_field_index("text"))], names=["doc_id", "text"])
            for out in judge(iter([seen])):
                yield rows.filter(out.column(out.schema.get_field_index("kept")))

    return docs.mapInArrow(run, docs.schema)
