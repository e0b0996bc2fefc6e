"""Line deduplication against brute force over all pairs of lines, and defined cases."""

import re

import numpy as np
import pyarrow as pa
import pytest

from docskein.llm import setjoin
from docskein.llm.words import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Lines that match an earlier line, with the earliest one that does."""
    lines = sorted((i, k, frozenset(WORD.findall(x))) for i, t in rows if t is not None and i is not None for k, x in enumerate(t.split("\n")))
    seen, out = [], {}
    for i, k, s in lines:
        if not s:
            continue
        for j, m, o in seen:
            if (i, k) != (j, m) and 5 * len(s & o) >= 4 * len(s | o):
                out[i, k] = (j, m)
                break
        seen.append((i, k, s))
    return out


def rows_of(seed, docs=120):
    rng = np.random.default_rng(seed)
    common = [f"c{i}" for i in range(12)]
    base = [[f"w{rng.integers(0, 400)}" for _ in range(n)] for n in (4, 5, 6, 9, 12, 25, 60, 170, 180, 700)]
    out = []
    for d in range(docs):
        text = []
        for _ in range(int(rng.integers(1, 6))):
            x = list(base[int(rng.integers(0, len(base)))]) if rng.random() < 0.6 else [
                common[int(rng.integers(0, 12))] for _ in range(int(rng.integers(1, 9)))]
            for _ in range(int(rng.integers(0, 1 + len(x) // 6))):
                x[int(rng.integers(0, len(x)))] = f"n{rng.integers(0, 10**6)}"
            if rng.random() < 0.3:
                x = x[: max(1, int(len(x) * 0.85))]
            text.append(" ".join(x))
        out.append((d, "\n".join(text)))
    return out


@pytest.mark.parametrize("seed,kept", [(1, 3), (2, 1)])
def test_equals_brute_force(docs_of, seed, kept):
    rows = rows_of(seed)
    want = brute(rows)
    got = {(r.doc_id, r.line): (r.first_doc, r.first_line) for r in setjoin.repeated_lines(docs_of(rows), kept).collect()}
    assert set(got) == set(want) and len(want) > 50


def test_second_pass_finds_what_the_first_left(docs_of, monkeypatch):
    # short sketches that seldom tell sets apart make early candidates fail
    monkeypatch.setattr(setjoin, "CLASSES", ((160, 1),))
    rows = [(i, "\n".join(x for x in t.split("\n") if len(x.split()) < 150)) for i, t in rows_of(5, 60)]
    got = {(r.doc_id, r.line) for r in setjoin.repeated_lines(docs_of(rows), 1).collect()}
    assert got == set(brute(rows))


def test_defined_cases(docs_of, spark, inputs):
    a = "one two three four five\n\n \nsix"
    rows = [(1, None), (2, ""), (3, a), (3, a), (4, a), (None, a), (5, "long " * 40_000 + "\nfive four three two one"), (6, "x\n" * 3000)]
    got = {}
    for r in setjoin.line_report(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_lines, list(r.removed)))
    assert got[1] == [(0, [])] and got[2] == [(1, [])] and got[3] == [(4, []), (4, [])] and got[4] == [(4, [0, 3])]
    assert got[5] == [(2, [1])] and got[6] == [(3001, list(range(1, 3000)))] and got[None] == [(4, [])]
    out = setjoin.without_repeated_lines(docs_of(rows))
    texts = {r.doc_id: r.text for r in out.collect()}
    assert out.columns[-1] == "fp" and texts[4] == "\n " and texts[1] is None and texts[6] == "x\n" and texts[None] == a
    e = docs_of(rows).limit(0)
    assert setjoin.line_report(e).count() == 0 and setjoin.without_repeated_lines(e).count() == 0


def test_query_equals_brute_force(spark, inputs):
    from docskein.llm.queries import QUERIES

    want = {}
    for (i, k), (j, _) in brute([(r.doc_id, r.text) for r in inputs.documents.collect()]).items():
        want.setdefault(i, set()).add(k)
    got = {r.doc_id: set(r.removed) for r in QUERIES["op7_line_dedup"](spark, inputs.sf_dir).collect()}
    assert {i: s for i, s in got.items() if s} == want and len(got) == inputs.documents.count()


def test_ids_that_repeat_with_other_texts(docs_of):
    """Rows of one id and unequal texts are documents of their own, in whatever order they come."""
    line = lambda k, n=24: " ".join(f"w{k}x{j}" for j in range(n))
    six = "\n".join(line(k) for k in range(6))
    near = "\n".join(line(k) + f" other{k}" for k in range(6))
    rows = [(1, six), (3, near), (3, line(99))]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.n_lines): (r.removed, r.first_docs) for r in setjoin.line_report(docs_of(order)).collect()}
        assert got == {(1, 6): ([], []), (3, 6): ([0, 1, 2, 3, 4, 5], [1]), (3, 1): ([], [])}
        texts = sorted(r.text for r in setjoin.without_repeated_lines(docs_of(order)).collect())
        assert texts == sorted(["", line(99), six])
    # equal rows of an id stay one document beside another text of it
    again = [(1, six), (1, six), (1, "else"), (2, "else")]
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in setjoin.line_report(docs_of(again)).collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 6), (1, 6), (2, 1)] and all(g[2] == [] for g in got[1:3])


def test_sets_of_lines_and_clashing_digests(monkeypatch):
    texts = ["b a b\n\na c", "", "a\n \nd b", ""]
    counters = np.arange(1 << setjoin.COUNTERS)
    for given in (None, counters):
        sets = setjoin.LineSets(pa.array(texts), given)
        lines = [(i, k, x.split()) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
        assert list(zip(sets.doc, sets.number, sets.size, strict=True)) == [(i, k, len(set(w))) for i, k, w in lines]
        found = [frozenset(sets.token[a:b].tolist()) for a, b in zip(sets.first[:-1], sets.first[1:], strict=True)]
        assert len(set().union(*found)) == 4 and found[0] == found[2] - found[2] | found[0] and len(found[0] & found[2]) == 1
    # two lines of one set, one of another, and one of a third that matches none: all mixed hashes equal
    rows = np.array([(1, 10, 0, 0, 5, 77), (1, 10, 0, 0, 3, 77), (1, 10, 0, 1, 3, 88), (2, 10, 0, 2, 9, 99)], dtype=setjoin.ROW)
    sketch = np.zeros((4, 2), dtype=np.uint64)
    plain = sorted(map(tuple, np.concatenate(list(setjoin.candidates_in(rows, sketch, 0, 3))).tolist()))
    monkeypatch.setattr(setjoin, "mix", lambda h: h * np.uint64(0))
    clashing = sorted(map(tuple, np.concatenate(list(setjoin.candidates_in(rows, sketch, 0, 3))).tolist()))
    assert plain == clashing == [(3, 1, 3, 0), (5, 0, 3, 0)]


def test_texts_are_read_for_candidates_once(docs_of, monkeypatch):
    """Lines whose first candidates fail meet the others without another pass over the texts, unless there are very many."""
    names = [f"x{k}" for k in range(4000)]
    bit = setjoin.mix(words(pa.array([" ".join(names)])).hashes()) & np.uint64(127)
    one, two = ([x for x, b in zip(names, bit.tolist(), strict=True) if b == k][:6] for k in (5, 9))
    # variants that share 8 of 12 words, with equal sketches; the last line is like the last variant
    lines = [" ".join([f"s{k}" for k in range(8)] + list(x)) for x in zip(one, two, strict=True)]
    rows = list(enumerate([*lines, lines[-1] + " more"])) + [(100 + i, " ".join([x] * 50)) for i, x in enumerate(one + two)]
    passes, checks, emit, check = [], [], setjoin._emit, setjoin.verified
    monkeypatch.setattr(setjoin, "_emit", lambda *given: passes.append(len(given)) or emit(*given))
    monkeypatch.setattr(setjoin, "verified", lambda *given: checks.append(1) or check(*given))
    for wide, emitted, verified in ((setjoin.WIDE, [2], 2), (1, [2, 3], 3)):
        got = [(r.doc_id, r.line, r.first_doc) for r in setjoin.repeated_lines(docs_of(rows), 1, wide).collect()]
        assert got == [(6, 0, 5)] and passes == emitted and len(checks) == verified
        passes.clear(), checks.clear()


def test_found_pairs_of_a_line_are_picked_together():
    pairs = [(7, 1, 9, 0, False), (7, 1, 2, 0, False), (7, 1, 2, 0, False), (7, 1, 3, 4, False), (8, 0, 5, 5, False), (8, 0, 6, 1, True), (8, 0, 4, 2, True)]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs, strict=True)], names=list(setjoin.FOUND_NAMES))
    (out,) = setjoin._pick(2)(iter([rows.slice(0, 3), rows.slice(3)]))
    assert list(zip(*(c.to_pylist() for c in out.columns), strict=True)) == [
        (7, 1, 2, 0, False, 0, 3), (7, 1, 3, 4, False, 1, 3), (8, 0, 4, 2, True, 0, 3)]
