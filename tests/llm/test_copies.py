"""Near copies of the pipeline against brute force over all pairs of shingle sets."""

import re

import numpy as np

import corpus_pipeline
from docskein.llm import copies, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    return frozenset(" ".join(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def brute(rows):
    """Smallest id that pairs of similarity 0.8 reach, of every id."""
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingle_set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def rows_of(seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(60):  # copies of which each changes words of the one before it or of the first
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(30, 400)))]
        last = base
        for _ in range(int(rng.integers(1, 6))):
            last = list(last if rng.random() < 0.5 else base)
            for _ in range(int(rng.integers(0, 1 + len(last) // 40))):
                last[int(rng.integers(0, len(last)))] = f"n{rng.integers(0, 10**6)}"
            out.append(" ".join(last))
    order = rng.permutation(len(out))
    return [(int(i), out[k]) for i, k in enumerate(order)]


def test_equals_brute_force_and_finds_what_two_bits_miss(docs_of, spark, inputs):
    rows = rows_of(7)
    want = brute(rows)
    d = docs_of(rows)
    assert {r.doc_id: r.component_id for r in copies.near_copies(d).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, inputs.sf_dir).collect()}
    assert kept == {i for i, c in want.items() if i == c}
    assert len(kept) < simhash.one_per_group(d).count()


def test_the_stage_links_fingerprints_too(docs_of, spark, inputs):
    # one word triple holds the majority of both fingerprints; their sets of five-word shingles share one of seven
    d = docs_of([(1, "x " * 100 + "p q r"), (2, "x " * 100 + "s t u"), (3, "another text of its own words")])
    assert {r.component_id for r in copies.near_copies(d).collect()} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, inputs.sf_dir).collect()} == {1, 3}


def test_joined_components(spark):
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (None, 4), (None, None)], "doc_id long, component_id long")
    two = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4)], "doc_id long, component_id long")
    got = sorted(((r.doc_id or 0), (r.component_id or 0)) for r in simhash.joined(one, two).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_defined_cases(docs_of):
    d = docs_of([(1, None), (2, ""), (3, " \t\n"), (4, "One  Two"), (5, "one two"), (5, "one two"), (None, "one two"),
                 (8, "a b c d e f g h i j"), (9, "one two three")])
    got = sorted((r.doc_id, r.component_id) for r in copies.near_copies(d).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (8, 8), (9, 9)]
    assert sorted((r.doc_id or -1) for r in simhash.smallest_of(d, copies.near_copies(d)).collect()) == [-1, 1, 4, 8, 9]
    assert copies.near_copies(d.limit(0)).count() == 0
