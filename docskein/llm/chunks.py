"""Substring deduplication by content-defined chunks.

A gear hash rolls over the word hashes of a text: it is shifted by one bit and the next word hash is added, so its lowest
``WINDOW`` bits depend on as many words. A chunk ends where those bits fall below a bound and did not one word earlier;
without such a place it ends after ``LONGEST`` words. Chunk borders therefore depend on the words around them and not on
their place: what is inserted before a passage moves it and leaves its inner chunks alone.

Chunks are deduplicated by a 64-bit digest of their words; the occurrence of smallest (doc_id, place) stays. Later ones
that stand next to each other form runs. Within a run, chunks whose first occurrences lie in one document at one distance
are on a diagonal; what a diagonal spans is removed if it has at least ``min_words`` and half of them are on it. It lies
within a passage repeated from that document, of which at most a chunk at either end is left. Short chunks that occur by
chance, each elsewhere, stay, however many of them stand together.

First occurrences are aggregated before the shuffle; occurrences meet them by a join on the digest, whose left side
adaptive execution may split where it is large enough to.

Defined cases: null and empty texts have no chunk. Rows without ``doc_id`` take no part and stay as they are. Rows that
repeat an id and its text count as one document, rows that repeat an id with another text as different ones: a text is named by
its id and a 64-bit hash (``text_key``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch
from docskein.llm.words import mix, slices, words
from docskein.session import stored

WINDOW, BELOW, LONGEST, MIN_WORDS = 4, 3, 64, 20
_U = np.uint64
_P, _INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)


def gear(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """h[i] = sum of hashes[i - j] << j over the last ``window`` words."""
    out = hashes.copy()
    for j in range(1, window):
        out[j:] += hashes[:-j] << _U(j) if j < len(hashes) else _U(0)
    return out & _U((1 << window) - 1)


def borders(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, below: int = BELOW, longest: int = LONGEST):
    """(start, end, doc) of every chunk, as word positions."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(n) - first[doc]
    low = (gear(hashes, window) < below) & (place >= window - 1)  # a full window inside the text
    cut = low.copy()
    cut[1:] &= ~low[:-1]
    cut[first[1:][np.diff(first) > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], ends[:-1]]) if n else ends
    # stretches without a border are cut after every ``longest`` words
    parts = -(-(ends - starts) // longest)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(starts, parts) + number * longest
    end = np.minimum(start + longest, np.repeat(ends, parts))
    return start, end, doc[start] if n else start


def digests(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digest of each run of words."""
    n = len(hashes)
    power = np.full(n + 1, _P, dtype=np.uint64)
    back = np.full(n + 1, _INV, dtype=np.uint64)
    power[0] = back[0] = 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * np.multiply.accumulate(power)[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * np.multiply.accumulate(back)[start] + (end - start).astype(np.uint64))


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("digest", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
    for rows in slices(batches):
        w = words(rows.column(1))
        hashes = w.hashes()
        start, end, doc = borders(hashes, w.first)
        yield batch(schema, digests(hashes, start, end).view(np.int64), rows.column(0).take(pa.array(doc)), rows.column(2).take(pa.array(doc)),
                    start - w.first[doc], end - start)


def chunks(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, text_key, start, n): chunks of every text with an id, places and lengths in words."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter(
        "doc_id IS NOT NULL").withColumn("text_key", F.xxhash64("text")).mapInArrow(
        _chunk, "digest long, doc_id long, text_key long, start int, n int")


_RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("first_doc_id", pa.int64()),
                   ("first_start", pa.int32()), ("text_key", pa.int64())])


def confirmed(owner: np.ndarray, start: np.ndarray, n: np.ndarray, first: np.ndarray, gap: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, from, to) of the spans that one earlier document confirms; ``chunk`` is one on the diagonal.

    Chunks come in order of owner and start; ``first`` numbers the document of first occurrence, ``gap`` is its place less
    the own one. Spans of one owner may overlap where several documents confirm a stretch.
    """
    head = np.ones(len(start), dtype=bool)
    head[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + n[:-1])
    run = np.cumsum(head)
    order = np.lexsort((start, gap, first, run))
    r, f, g = run[order], first[order], gap[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    begin = start[order][at]
    end = np.maximum.reduceat(start[order] + n[order], at)
    cover = np.add.reduceat(n[order], at)
    ok = (end - begin >= min_words) & (2 * cover >= end - begin)
    return order[at][ok], begin[ok], end[ok]


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, n_words, first_doc_id, first_start, text_key): repeated stretches and where they were seen first."""
    cut = stored(chunks(docs), "chunks")
    place = F.struct("doc_id", "text_key", "start")
    firsts = cut.groupBy("digest").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter(F.col("f") != F.col("l"))
    again = cut.join(firsts.select("digest", "f"), "digest").filter(place != F.col("f")).select("doc_id", "text_key", F.struct(
        "start", "n", F.col("f.doc_id").alias("fd"), F.col("f.text_key").alias("fk"), F.col("f.start").alias("fs")).alias("c"))
    # a document's own chunks, at most
    per_doc = again.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("c")).alias("cs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(2)
            flat = lists.flatten()
            if not len(flat):
                continue
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            start, n, fd, fk, fs = (flat.field(k).to_numpy() for k in range(5))
            document = np.unique(np.stack([fd, fk], axis=1), axis=0, return_inverse=True)[1].ravel()
            chunk, begin, end = confirmed(owner, start, n, document, fs.astype(np.int64) - start, min_words)
            # overlapping spans of a document become one, named by the first
            order = np.lexsort((end, begin, owner[chunk]))
            spans: list[list[int]] = []
            for k in order.tolist():
                row = int(owner[chunk[k]])
                if spans and spans[-1][0] == row and begin[k] < spans[-1][2]:
                    spans[-1][2] = max(spans[-1][2], int(end[k]))
                else:
                    spans.append([row, int(begin[k]), int(end[k]), int(chunk[k])])
            if spans:
                row, lo, hi, at = np.array(spans).T
                yield batch(_RUNS, rows.column(0).take(pa.array(row)), lo, hi - lo, fd[at], fs[at], rows.column(1).take(pa.array(row)))

    return per_doc.mapInArrow(merge, "doc_id long, start int, n_words int, first_doc_id long, first_start int, text_key long")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the runs cut out of the texts; other columns and texts without a run are unchanged."""
    runs = repeated_runs(docs, min_words).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "n_words"))).alias("_runs")).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    own = (docs["doc_id"] == runs["_id"]) & (F.xxhash64(docs["text"].cast("string")) == runs["_key"])
    joined = docs.join(runs, own, "left").select(*[docs[c] for c in docs.columns], runs["_runs"].alias("__runs"))
    names = docs.columns
    at, last = names.index("text"), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            w = words(rows.column(at))
            data = w.buf.tobytes()
            lists = rows.column(last).to_pylist()
            texts = rows.column(at).to_pylist()
            for k, spans in enumerate(lists):
                if spans:
                    lo, own, parts, begin = int(w.first[k]), int(w.counts[k]), [], int(w.offsets[k])
                    for span in spans:
                        a, b = span["start"], span["start"] + span["n_words"]
                        parts.append(data[begin:int(w.start[lo + a])])
                        begin = int(w.start[lo + b]) if b < own else int(w.offsets[k + 1])
                    texts[k] = (b"".join(parts) + data[begin:int(w.offsets[k + 1])]).decode()
            columns = [rows.column(i) if i != at else pa.array(texts, rows.column(at).type) for i in range(last)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)
