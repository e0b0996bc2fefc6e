"""SimHash against brute force, and its defined cases."""

import re

import numpy as np
import xxhash

from docskein.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    ids = [i for i, _ in rows]
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, inputs):
    from docskein.llm.queries import QUERIES

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, inputs.sf_dir).collect()}
    rows = [(r.doc_id, brute(r.text)) for r in inputs.documents.collect()]
    want = brute_components(rows)
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in rows}
    assert any(c != i for i, (_, c) in got.items())


def test_tree_is_exact_for_any_cut():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    one = np.uint64(1)
    near = base[:200] ^ (one << rng.integers(0, 63, 200).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near, np.uint64(7) ^ (one << rng.integers(0, 63, 400).astype(np.uint64))]))
    edges = simhash.links_within(fp, np.ones(len(fp), bool), 2)
    want = brute_components([(i, int(f)) for i, f in enumerate(fp)])
    up = list(range(len(fp)))
    for _ in range(len(fp)):
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
        if not changed:
            break
    assert up == [want[i] for i in range(len(fp))]


def test_shards_lose_no_link(spark, docs_of):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 300)
    fps = sorted({int(x) for x in base} | {int(x) ^ (1 << int(b)) for x, b in zip(base, rng.integers(0, 60, 300))})
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    links = simhash.near_links(frame.select("fp", F_node()), shard=20, sample=200).collect()
    edges = {(r.a, r.b) for r in links}
    want = brute_components(list(enumerate(fps)))
    assert len(edges) >= sum(1 for i, c in want.items() if i != c)
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)


def F_node():
    from pyspark.sql import functions as F
    return F.col("fp").alias("node")


def test_defined_cases(docs_of):
    long = "wort " * 50_000
    d = docs_of([(1, None), (2, ""), (3, " \t\n"), (4, "One  Two"), (5, "one two"), (6, long), (7, long), (5, "one two"),
                 (None, "one two"), (8, "a b c d e f g h i j")])
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(d).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (7, 6), (8, 8)]
    kept = sorted((r.doc_id or -1) for r in simhash.one_per_group(d).collect())
    assert kept == [-1, 1, 4, 6, 8]
    assert simhash.near_duplicates(d.limit(0)).count() == 0
    assert simhash.one_per_group(docs_of([(1, "a b"), (1, "a b"), (2, "c d")])).count() == 2
