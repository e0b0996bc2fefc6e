"""Importance resampling against a plain version, CRCs against zlib, defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docskein.llm import resample
from docskein.llm.crc import Running, shifted, substring


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.data())
def test_crc_of_substrings(raw, data):
    run = Running(np.frombuffer(raw, dtype=np.uint8))
    a = data.draw(st.integers(0, len(raw)))
    b = data.draw(st.integers(a, len(raw)))
    ends = run.at(np.array([a, b]))
    assert ends.tolist() == [zlib.crc32(raw[:a]), zlib.crc32(raw[:b])]
    assert substring(ends[:1], ends[1:], np.array([b - a]))[0] == zlib.crc32(raw[a:b])


def test_long_shift():
    got = shifted(np.array([1, 0xDEADBEEF], dtype=np.uint32), np.array([5_000_011, 0]))
    zeros = np.array([zlib.crc32(b"\0" * 5_000_011, 0)], dtype=np.uint32)
    assert got[1] == 0xDEADBEEF and got[0] ^ zeros[0] == zlib.crc32(b"\0" * 5_000_011, 1)


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain(rows, target):
    s, t = (Counter(b for text in texts for b in buckets_of(text)) for texts in ([r[1] for r in rows], target))
    total_s, total_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for doc_id, text in rows:
        found = buckets_of(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc_id, len(words_of(text)), len(found), weight, score])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[:25 * len(able) // 100])}
    return [(*r, drawn.get(id(r))) for r in out]


@pytest.fixture(scope="module")
def rows():
    say = ["Größe", "der", "KATZE", "x1", "naïve", "Überall", "tests", "42", "zebra", "quick", "日本語", "fox"]
    out = [(i, " ,".join(say[(i * k + k * k) % 12] for k in range(1, 10 + i % 40)) + ("\n--" if i % 3 else "")) for i in range(300)]
    return out + [(900, None), (901, ""), (902, "... --- !!"), (903, "one"), (None, "a b " * 30), (904, "ab" * 60_000 + " tail " + "w " * 30_000)]


def test_equal_to_plain(docs_of, spark, rows):
    target = ["zebra quick fox tests", None, "Größe der Katze 日本語"]
    t = spark.createDataFrame([(i, x, "s") for i, x in enumerate(target)], "item_id long, text string, score string")
    d = docs_of(rows).withColumns({n: F.lit(n) for n in ("score", "weight", "rank", "bucket", "place", "n")})
    got = resample.resampled(d, t).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain(rows, target), key=key)


def test_repeated_rows_and_empty_tables(docs_of, spark):
    text = "word " * 25
    d = docs_of([(7, text)] * 40 + [(8, "other " * 30)] * 4)
    t = d.select(F.col("doc_id").alias("item_id"), "text").limit(0)
    got = resample.resampled(d, t).collect()
    assert len(got) == 44 and sorted(r.rank for r in got if r.rank) == list(range(1, 12))
    assert len({(r.weight, r.score) for r in got if r.doc_id == 7}) == 1
    assert resample.resampled(d.limit(0), t).count() == 0
