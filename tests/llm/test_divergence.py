"""Source divergence against a plain version in exact arithmetic, any number of shards and blocks, defined cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docskein.llm import divergence


def plain(rows, fewest=3, top=200):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in in_docs[lang].items() if n >= fewest]
        whole = {w: sum(counts[lang, s][w] for s in sources) for w in kept}

        def p(of, kept=kept):
            total = sum(of[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (of[w] + 1) // total for w in kept}

        q, ps = p(whole), {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((ps[s][w] - ps[o][w]) ** 2 // ps[o][w] for w in kept), o) for o in sources if o != s]
            terms = [((ps[s][w] - q[w]) ** 2 // q[w], w) for w in kept if counts[lang, s][w] and ps[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    say = ["Größe", "katze", "KATZE", "naïve", "ÉTÉ", "tests", "don't", "a1b2", "日本語", "fox", "rare", "x"]
    out = []
    for i in range(240):
        n = 5 + i * 7 % 60
        text = " ".join(say[(i * k + k * k + i % 5) % (6 + i % 7)] for k in range(n)) + f" only{i % 90} w{chr(97 + i % 26)}z"
        out.append((text, ("en", "de", None)[i % 3], ("s1", "s2", "ü", None, "s3")[i * i % 11 % 5]))
    return out + [(None, "en", "silent"), ("", "fr", "alone"), ("q r", "zz", "one"), ("r q", "zz", "two"), ("A-Z" * 40_000, "en", "s1")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, *r, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term long")


@pytest.mark.parametrize("cells, block, top", [(1 << 21, 256, 200), (16, 2, 200), (64, 1, 3)])
def test_equal_to_plain(frame, rows, cells, block, top):
    got = divergence.audit(frame, top=top, cells=cells, block=block).collect()
    assert sorted(map(tuple, got)) == plain(rows, top=top)


def test_long_runs_are_merged_and_sent(frame, rows, monkeypatch, spark):
    batches = frame.select("lang", "source", "text").toArrow().to_batches(max_chunksize=7)
    monkeypatch.setattr(divergence, "HELD_ROWS", 20)
    sent = list(divergence._partials(iter(batches)))
    assert len(sent) > 5
    monkeypatch.setattr(divergence, "HELD_ROWS", 10**9)
    whole = list(divergence._partials(iter(batches)))
    fold = lambda bs: sorted(map(str, divergence._merge([divergence.pa.Table.from_batches(bs)]).to_pylist()))
    assert fold(sent) == fold(whole)


def test_probabilities_are_exact():
    rng = np.random.default_rng(1)
    count = rng.integers(0, 4 * 10**13, 2000)
    total = count + rng.integers(0, 10**12, 2000)
    got = divergence.probabilities(count, total, 12_345)
    assert got.tolist() == [1 + 10**9 * (int(c) + 1) // (int(t) + 12_345) for c, t in zip(count, total, strict=True)]


def test_defined_cases(frame, spark):
    assert divergence.audit(frame.limit(0)).count() == 0
    same = frame.filter("lang = 'en'").withColumn("doc_id", F.lit(5)).unionByName(frame.filter("lang = 'en'"))
    again = divergence.audit(same, fewest_docs=6).collect()
    once = divergence.audit(frame.filter("lang = 'en'"), fewest_docs=3).collect()
    assert {(r.source, r.item) for r in again if r.part == "pair"} == {(r.source, r.item) for r in once if r.part == "pair"}
    words = frame.select(F.lit(1).alias("doc_id"), F.lit("only here").alias("text"), F.lit("l").alias("lang"), "source")
    assert all(r.value == 0 for r in divergence.audit(words, fewest_docs=10**6).collect())
