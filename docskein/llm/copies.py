"""Near copies of documents: five-word shingles, banded minima, and an exact Jaccard similarity of what they propose.

A document is the set of its word shingles. ``BANDS`` keys per text, each of ``ROWS`` minima of its hashed shingles, put
texts into buckets: two of similarity s share one with odds 1 - (1 - s**ROWS)**BANDS, that is 0.99997 at s = 0.8 and more
above. Every member of a bucket is compared with the member of smallest digest. Where that leaves a bucket with more than
one component, the members outside the component of that smallest one are compared with all of the other components. So
every pair of a bucket is compared or known to hang together, while a bucket that is one group costs one pair a member.
Pairs are confirmed on the whole shingle sets, in integers: 9 |A ∩ B| >= 4 (|A| + |B|) is a similarity of 0.8.

Exact copies, which have the same words in the same order, collapse first and enter once. Components are closed by star
contraction on tables.

Defined cases: words are lower-cased; fewer words than ``width`` form one shingle; null, empty and wordless texts are
copies of each other. Rows without ``doc_id`` take no part and have no component. Rows that repeat an id enter each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch, components
from docskein.llm.chunks import digests
from docskein.llm.words import Words, chain, mix, slices, words
from docskein.session import stored

WIDTH, BANDS, ROWS = 5, 20, 4
_U = np.uint64
_FACTORS = np.random.Generator(np.random.PCG64(20240307)).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * _U(2) + _U(1)


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, first shingle of each text): a text with fewer words than ``width`` has one, without words none."""
    counts = w.counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
    return digests(w.hashes(), at, at + np.repeat(np.minimum(counts, width), n)), first


def _whole(w: Words) -> np.ndarray:
    """Digest of all words of each text."""
    return digests(w.hashes(), w.first[:-1], w.first[1:]).view(np.int64)


def _keys(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            w = words(rows.column(1), lower=True)
            hashes, first = shingles(w, width)
            has = np.flatnonzero(np.diff(first))
            lows = np.full((BANDS * ROWS, rows.num_rows), np.iinfo(np.uint64).max, dtype=np.uint64)
            if len(has):
                for k, (factor, more) in enumerate(_FACTORS.T):
                    lows[k, has] = np.minimum.reduceat(hashes * factor + more, first[has])
            bands = np.stack([chain(mix(np.full(rows.num_rows, b, dtype=np.uint64)), *lows[b * ROWS:(b + 1) * ROWS])
                              for b in range(BANDS)], axis=1).ravel().view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1) * BANDS, pa.int32()), pa.array(bands))
            yield batch(schema, rows.column(0), _whole(w), lists)

    return run


def _sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            w = words(rows.column(1), lower=True)
            hashes, first = shingles(w, width)
            own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(own)))
            yield batch(schema, _whole(w), lists)

    return run


def confirmed(pairs: DataFrame, names: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The ``pairs(a, b)`` of nodes whose shingle sets have a Jaccard similarity of 0.8 at least."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = ends.join(names, "node").select("doc_id").distinct()
    sets = stored(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "node long, shingles array<long>").join(
        ends, "node", "left_semi").dropDuplicates(["node"]), "shingles")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return stored(pairs.join(one, "a").join(other, "b").filter(
        F.size(F.array_intersect("x", "y")).cast("long") * 9 >= (F.size("x").cast("long") + F.size("y")) * 4).select("a", "b"), "confirmed")


def near_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs(doc_id, text)`` with an id: the smallest id that confirmed pairs reach."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    keys = stored(texts.mapInArrow(_keys(width), "doc_id long, digest long, bands array<long>"), "keys")
    names = stored(keys.groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "names")
    spread = names.select("node", F.explode("bands").alias("band"))
    firsts = spread.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("band", "low")
    members = stored(spread.join(firsts, "band"), "buckets")
    pairs = members.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    names = names.select("node", "doc_id")
    links = confirmed(stored(pairs, "pairs"), names, texts, width)
    roots = stored(components(links), "roots")
    # buckets that are more than one component: who is not with the smallest meets all others
    of = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = roots.select(F.col("node").alias("low"), F.col("root").alias("low_root"))
    placed = stored(of.join(low, "low", "left").withColumn("low_root", F.coalesce("low_root", "low")), "placed")
    apart = placed.filter("root <> low_root")
    rest = apart.select("band", F.col("node").alias("n"), F.col("root").alias("r")).join(placed.filter("node <> low"), "band").filter(
        F.col("r") != F.col("root")).select(F.greatest("n", "node").alias("a"), F.least("n", "node").alias("b")).distinct()
    rest = stored(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = confirmed(rest, names, texts, width)
        roots = stored(components(links.unionByName(more)), "roots")
    named = names.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(least, "root").select(F.col("node").alias("digest"), "component_id")
    return keys.select("doc_id", "digest").join(labels, "digest").select("doc_id", "component_id")
