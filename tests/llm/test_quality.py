"""Base measures against a plain count, held-out accuracy of the model, defined cases."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docskein.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_measures(spark, inputs):
    from docskein.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, inputs.sf_dir).collect()}
    docs = inputs.documents.collect()
    assert len(got) == len(docs)
    for d in docs:
        r, want = got[d.doc_id], plain(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_model_on_rows_it_has_not_seen(spark):
    from docskein.llm.queries import Inputs

    t = Inputs(spark, "/root/testdata/sf0.01")
    texts = {r.doc_id: r.text for r in t.documents.collect()}
    rows = sorted((r.doc_id, r.quality) for r in t.labels.collect())
    fit, test = rows[::2], rows[1::2]
    m = quality.train([texts[i] for i, _ in fit], np.array([float(y) for _, y in fit]), 0.85)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in test]), pa.array([texts[i] for i, _ in test])], names=["doc_id", "text"])
    out = pa.Table.from_batches(list(quality._assess(m, 0, 1.0, 0.5)(iter([batch])))).column("kept").to_pylist()
    right = [k == bool(y) for k, (_, y) in zip(out, test)]
    assert np.mean(right) >= 0.95


def test_defined_cases(spark, docs_of, inputs):
    d = docs_of([(1, None), (2, ""), (3, "a b c\na b c\n\n \na b c"), (4, "ü" * 30 + " |x|\n" * 3), (None, "q " * 200), (5, "w%d " * 5)])
    none = inputs.labels.limit(0)
    assert quality.fit(d, none) is None
    got = {r.doc_id: r for r in quality.assess(d, None).collect()}
    for i, t in ((1, None), (3, "a b c\na b c\n\n \na b c"), (4, "ü" * 30 + " |x|\n" * 3)):
        assert tuple(got[i])[1:6] == plain(t)
    assert got[1].base_failed and not got[1].kept and got[None].base_failed
    kept = quality.keep_good(docs_of([(7, " ".join(f"w{i}" for i in range(80))), (8, "x")]), none)
    assert [r.doc_id for r in kept.collect()] == [7] and kept.columns[-1] == "fp"
    assert quality.assess(d.limit(0), None).count() == 0
    assert quality.keep_good(d.limit(0), none).count() == 0
