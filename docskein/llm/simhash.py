"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints.

``fingerprints`` hashes the word shingles of whole texts. ``near_components`` links fingerprints within ``radius``
bits. A vantage-point tree of fixed size, built from a bounded sample, deals the distinct fingerprints to shards: at
each node a fingerprint goes to the near or the far side of its median distance (its home), and one whose distance lies
within ``radius`` of the border also visits the other side as a query. By the triangle inequality no pair within
``radius`` is separated otherwise, so the result is exact whatever the sample. A shard is searched by a tree of its own;
a branch is pruned when the bounds exclude it, and accepted whole when they prove every pair in it.

Exact copies share one fingerprint and enter once. A shard returns a spanning forest of its links, not its pairs, and
components are closed by star contraction on tables. A shard never holds more than its own fingerprints, eight bytes
each, split further while the sample can tell them apart.

Defined cases: a null or empty text, or one without a word, has fingerprint 0 and is linked like any other. Fewer words
than ``width`` form one shingle. Rows without ``doc_id`` keep their fingerprint and join the component of their
fingerprint; ids that repeat are treated alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch, components
from docskein.llm.words import per_doc, slices, words
from docskein.session import stored

SEED = 42
SAMPLE = 16_384  # fingerprints that shape the shard tree
SHARD = 8_192  # fingerprints a shard should hold
LEAF = 96  # fingerprints compared with each other directly
_U = np.uint64
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_ONE = np.arange(64, dtype=np.uint64)


def _bits_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority bit per document, for documents with one hash at least."""
    counts = np.diff(first)
    out = np.zeros(len(counts), dtype=np.uint64)
    has = np.flatnonzero(counts)
    step = 1 << 16  # hashes unpacked at once
    at = 0
    while at < len(has):
        to = max(at + 1, int(np.searchsorted(first[has + 1], first[has[at]] + step, side="right")))
        docs = has[at:to]
        lo, hi = int(first[docs[0]]), int(first[docs[-1] + 1])
        ones = np.zeros((len(docs), 64), dtype=np.int64)
        for a in range(lo, hi, 1 << 20):  # one very long document in bounded steps
            b = min(hi, a + (1 << 20))
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cuts = np.clip(first[docs], a, b) - a
            live = np.flatnonzero(np.clip(first[docs + 1], a, b) - a > cuts)
            ones[live] += np.add.reduceat(bits, cuts[live], axis=0, dtype=np.int32)
        major = ones * 2 > counts[docs][:, None]
        out[docs] = (major.astype(np.uint64) << _ONE).sum(axis=1, dtype=np.uint64)
        at = to
    return out


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for rows in slices(batches):
            w = words(rows.column(1), lower=True)
            counts = w.counts
            # words of the slice, joined by one space: a shingle is then one run of bytes
            size = w.end - w.start
            begin = np.cumsum(size + 1) - (size + 1)
            joined = np.full(int(begin[-1] + size[-1] + 1) if len(size) else 0, 32, dtype=np.uint8)
            if len(size):
                inside = np.repeat(w.start - begin, size + 1) + np.arange(len(joined))
                keep = np.ones(len(joined), dtype=bool)
                keep[begin + size] = False
                joined[keep] = w.buf[inside[keep]]
            n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
            first = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
            last = at + np.repeat(np.minimum(counts, width), n) - 1
            view = memoryview(joined.tobytes())
            hashes = np.fromiter((digest(view[a:b], SEED) for a, b in
                                  zip(begin[at].tolist(), (begin[last] + size[last]).tolist(), strict=True)),
                                 dtype=np.uint64, count=len(at))
            yield batch(_FP, rows.column(0), _bits_of(hashes, first).view(np.int64))

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): bit b of ``fp`` is 1 when it is set in over half of the shingle hashes (XXH64, seed 42)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints(width), "doc_id long, fp long")


def hex_digits(fp):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, leaf: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, border, near, far) of a vantage-point tree; a leaf has border -1 and its number as vantage."""
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def grow(points: np.ndarray, depth: int) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        if len(points) > leaf and depth < 40:
            # of a few vantage points, the one whose distances spread most leaves fewest at the border
            tried = points[:: max(1, len(points) // 8)][:8]
            spread = [distance(points, v).astype(float).std() for v in tried]
            vantage = tried[int(np.argmax(spread))]
            d = distance(points, vantage)
            border = int(np.median(d)) or 1
            if (d < border).any() and (d >= border).any():
                near = grow(points[d < border], depth + 1)
                far = grow(points[d >= border], depth + 1)
                nodes[at] = (int(vantage), border, near, far)
                return at
        nodes[at] = (leaves, -1, 0, 0)
        leaves += 1
        return at

    grow(np.sort(sample), 0)
    return nodes


def _deal(nodes: list, radius: int):
    schema = pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("node", pa.int64()), ("home", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fp = rows.column(0).to_numpy().view(np.uint64)
            node = rows.column(1).to_numpy()
            todo = [(0, np.arange(len(fp)), np.ones(len(fp), dtype=bool))]
            while todo:
                at, idx, home = todo.pop()
                vantage, border, near, far = nodes[at]
                if border < 0:
                    if len(idx):
                        yield batch(schema, np.full(len(idx), vantage, np.int32), fp[idx].view(np.int64), node[idx], home)
                    continue
                d = distance(fp[idx], _U(vantage)).astype(np.int32)
                inside = d < border
                # a pair is found on the far side: only the near one visits, and a visitor goes wherever bounds allow
                go_near = inside | (~home & (d - radius < border))
                go_far = ~inside | (d + radius >= border)
                todo.append((near, idx[go_near], home[go_near]))
                todo.append((far, idx[go_far], home[go_far] & ~inside[go_far]))

    return run


class _Forest:
    """Union-find over positions; ``link`` keeps the edges that join two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.edges.append((i, j))

    def link_all(self, members: np.ndarray) -> None:
        """All members belong together."""
        if len(members) > 1:
            self.link(members[1:], np.full(len(members) - 1, members[0]))


def links_within(fp: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs (home, any) within ``radius``, by a vantage-point tree with triangle bounds."""
    forest = _Forest(len(fp))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guests = todo.pop()
        if len(own) == 0 or len(own) + len(guests) < 2:
            continue
        if len(own) > LEAF:
            tried = own[:: max(1, len(own) // 4)][:4]
            near = [distance(fp[own], fp[v]) for v in tried]
            pick = int(np.argmax([x.astype(float).std() for x in near]))
            vantage, d = tried[pick], near[pick].astype(np.int32)
            border = int(np.median(d)) or 1
            g = distance(fp[guests], fp[vantage]).astype(np.int32)
            # upper bound: two points within radius/2 of the vantage are within radius of each other
            tight, tight_g = own[d <= radius // 2], guests[g <= radius // 2]
            forest.link_all(np.concatenate([tight, tight_g]))
            forest.link(own[d <= radius], np.full(int((d <= radius).sum()), vantage))
            forest.link(guests[g <= radius], np.full(int((g <= radius).sum()), vantage))
            inside = d < border
            if inside.any() and not inside.all():
                # lower bounds: a near point visits the far side when it lies within radius of the border
                todo.append((own[inside], guests[g - radius < border]))
                todo.append((own[~inside], np.concatenate([guests[g + radius >= border],
                                                           own[inside & (d + radius >= border)]])))
                continue
        # no border tells these apart, or they are few: compare in blocks
        rest = np.concatenate([own, guests])
        for a in range(0, len(own), 256):
            block = own[a:a + 256]
            for b in range(a, len(rest), 4096):
                other = rest[b:b + 4096]
                i, j = np.nonzero(distance(fp[block][:, None], fp[other][None, :]) <= radius)
                ok = block[i] != other[j]
                i, j = block[i[ok]], other[j[ok]]
                if len(i) > 1024:  # dense: those that already hang together need no look at every pair
                    root = np.array([forest.find(int(x)) for x in np.concatenate([block, other])])
                    known = dict(zip(np.concatenate([block, other]).tolist(), root.tolist(), strict=True))
                    pair = np.unique(np.array([[known[x], known[y]] for x, y in zip(i.tolist(), j.tolist(), strict=True)
                                               if known[x] != known[y]], dtype=np.int64).reshape(-1, 2), axis=0)
                    i, j = pair[:, 0], pair[:, 1]
                forest.link(i, j)
    return forest.edges


def _search(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        node = table.column("node").to_numpy()
        edges = np.array(links_within(fp, table.column("home").to_numpy(), radius), dtype=np.int64).reshape(-1, 2)
        # every node of a tree is linked to one of it: paths stay short, so few rounds close the components
        forest = _Forest(len(fp))
        forest.link(edges[:, 0], edges[:, 1])
        at = np.unique(edges)
        root = np.array([forest.find(i) for i in at.tolist()], dtype=np.int64)
        return pa.table([node[at[at != root]], node[root[at != root]]], schema=schema)

    return run


def near_links(distinct: DataFrame, radius: int = 2, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links between nodes of ``distinct(fp, node)`` that span every component of pairs within ``radius``."""
    total = distinct.count()
    some = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").toArrow()["fp"].to_numpy()
    leaf = max(4, int(len(some) * min(1.0, shard / max(total, 1))))
    nodes = build_tree(some.view(np.uint64), leaf)
    dealt = distinct.select("fp", "node").mapInArrow(_deal(nodes, radius), "shard int, fp long, node long, home boolean")
    return dealt.groupBy("shard").applyInArrow(_search(radius), "a long, b long")


def near_components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``prints(doc_id, fp)`` with ``component_id``: the smallest doc_id that links within ``radius`` reach.

    Fingerprints whose documents all lack an id stand for themselves with a null component unless they reach an id.
    """
    # nodes get small numbers by fingerprint: the smallest id of its documents, or a negative stand-in without one
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    edges = near_links(distinct.select("fp", F.col("fp").alias("node")), radius)
    roots = stored(components(edges), "roots")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    labels = named.groupBy("root").agg(F.min("low").alias("component_id")).join(named.select("fp", "root"), "root")
    return prints.join(labels.select("fp", "component_id"), "fp", "left")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs(doc_id, text)``."""
    return near_components(stored(fingerprints(docs, width), "simhash"), radius)


def one_per_group(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with the document of smallest id of each group; of rows that repeat that id, one. Without an id none of
    a row's copies can be named, so such rows stay."""
    return smallest_of(docs, stored(near_duplicates(docs, width, radius), "near-duplicates"))


def joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found(doc_id, component_id)`` with the components of ``more(doc_id, component_id)`` joined in: a row's component is
    the smallest id that both reach together, null without an id."""
    found = stored(found.select("doc_id", "component_id"), "components")
    links = found.unionByName(more.select("doc_id", "component_id")).filter("doc_id IS NOT NULL AND component_id IS NOT NULL")
    roots = components(links.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    named = found.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def smallest_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one document for each component of ``found(doc_id, component_id)``, and all without an id."""
    drop = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(drop, "doc_id", "left_anti")
    ids = found.filter(F.col("doc_id") == F.col("component_id")).agg(F.count("*"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1]:
        return kept
    named = kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(kept.filter(F.col("doc_id").isNull()))
