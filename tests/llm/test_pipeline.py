"""Every stage of the pipeline against a plain version of it, on its own input."""

from collections import Counter

import public_tokenizers
import pytest
from test_setjoin import brute as brute_lines
from test_simhash import brute as brute_print
from test_simhash import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from docskein.llm import mixing, quality
from docskein.session import stored


@pytest.fixture(scope="module")
def tables(spark, inputs):
    """Input of each stage and the result of the last."""
    docs = [spark.read.parquet(f"{inputs.sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], inputs.sf_dir), name))
    return docs


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "pack_sequences"]
    assert all(t.columns == tables[0].columns for t in tables[1:-1])


def test_quality(tables, inputs):
    verdict = {r.doc_id: r.kept for r in quality.assess(tables[0], quality.fit(tables[0], inputs.labels)).collect()}
    assert set(texts(tables[1])) == {i for i, k in verdict.items() if k}
    assert 0 < len(texts(tables[1])) < len(verdict)


def test_lines(tables):
    before, after = texts(tables[1]), texts(tables[2])
    gone = brute_lines(list(before.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in before.items()}
    assert after == want and any(before[i] != t for i, t in after.items())
    assert all(r.n_chars == len(r.text) for r in tables[2].collect())


def test_near_duplicates(tables):
    before, after = texts(tables[2]), texts(tables[3])
    root = brute_components([(i, brute_print(t)) for i, t in before.items()])
    assert after == {i: t for i, t in before.items() if root[i] == i}


def test_mix(tables):
    plan = {r.doc_id: r.epochs + (r.extra > 0) for r in mixing.mixed(tables[3], [3, 1, 2], 1.5, 2.0, whole=True).collect()}
    times = Counter(r.doc_id for r in tables[4].collect())
    assert times == Counter({i: n for i, n in plan.items() if n})
    sums, size = Counter(), {r.doc_id: (r.source, r.size, r.target) for r in mixing.mixed(tables[3], [3, 1, 2], 1.5, 2.0).collect()}
    for i, n in times.items():
        sums[size[i][0]] += n * size[i][1]
    largest = {}
    for s, n, _ in size.values():
        largest[s] = max(n, largest.get(s, 0))
    assert all(abs(sums[s] - t) <= largest[s] / 2 + 1 for s, _, t in size.values())


def test_packing(tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = tables[5].collect()
    docs = texts(tables[4])
    times = Counter(r.doc_id for r in tables[4].collect())
    assert Counter(r.doc_id for r in rows if r.piece == 0) == times
    once, seen = [], set()
    for r in rows:
        if (r.doc_id, r.piece) not in seen:
            seen.add((r.doc_id, r.piece))
            once.append(r)
    ids = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    assert sum(r.length for r in rows) == sum(ids[i] * n for i, n in times.items())
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * sum(fill.values()) / 1024 + 2


def test_run_and_clashing_columns(spark, inputs, docs_of, tables):
    odd = docs_of([(1, None, None), (2, "", "a"), (2, "", "a"), (None, "w " * 90, "b"), (3, " ".join(f"w{i}" for i in range(90)), "b")])
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, inputs.sf_dir), name)
    assert {r.doc_id for r in docs.collect()} == {3}
    assert corpus_pipeline.STAGES[1][1](spark, odd, inputs.sf_dir).count() == 5
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, inputs.sf_dir).count() == 0
