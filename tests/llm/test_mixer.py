"""Base scores against a plain count; the model as a probability, better than chance and than the base; defined cases."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from docskein.llm import mixer, phrases, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def plain(docs):
    c = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                sum(log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in docs}


@pytest.mark.parametrize("frequent", [mixer.FREQUENT, 50])
def test_base_scores(inputs, frequent):
    docs = [(r.doc_id, r.text) for r in inputs.documents.collect()]
    want = plain(docs)
    rows = mixer.score(inputs.documents, mixer.fit(inputs.documents, frequent=frequent)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score < 0
    sizes = {i: sum(len(x.encode()) + 1 for x in tokens(t)) for i, t in docs}
    bits = -sum(r.score for r in rows if r.held_out) / log10(2) / sum(sizes[r.doc_id] for r in rows if r.held_out)
    assert bits < 3.2  # bits a byte on documents it has not seen


def test_is_a_distribution():
    tables = np.zeros((mixer.PREDICTORS, 1 << mixer.SLOTS, 2))
    words = [b"abc", b"abd", b"b", b""]
    mixer.count_bits(words, np.array([0, 1, 0, 0]), np.array([5, 3, 9, 2]), tables)
    model = mixer.Model(**mixer.Model.arrays(tables)).leave_out(tables)
    for _ in range(5):
        model.learn(words, np.array([0, 1, 0, 0]), np.array([5, 3, 9, 2]), 0.3)
    one = [b""] + [bytes([b]) for b in range(1, 256) if b != 32]
    p = 10 ** model.log10(one, np.zeros(len(one), np.int64))
    assert 0 < p.sum() <= 1 and p[one.index(b"b")] > 0.05
    assert model.log10([b"x" * 30_000], np.zeros(1, np.int64))[0] < 0


def test_whole_long_words_are_learned():
    rng = np.random.default_rng(3)
    long, other = (bytes(rng.integers(97, 123, 3000, dtype=np.uint8)) for _ in range(2))
    groups = np.zeros(1, np.int64)
    tables = np.zeros((mixer.PREDICTORS, 1 << mixer.SLOTS, 2))
    mixer.count_bits([long], groups, np.array([4]), tables)
    assert tables[:, :, :].sum() == mixer.PREDICTORS * 8 * 3001 * 4
    model = mixer.Model(**mixer.Model.arrays(tables))
    assert model.log10([long[-1000:]], groups)[0] > 0.5 * model.log10([other[-1000:]], groups)[0]
    # segments of a word in one run and in many give the same
    pieces = mixer.Pieces([long, b"ab", b""])
    one, many = list(pieces.runs()), list(pieces.runs(300))
    assert len(one) == 1 and len(many) > 5 and b"".join(b"".join(d) for d, _, _ in many) == long + b" ab \x00"
    table = np.zeros_like(tables)
    for data, lead, token in many:
        stream = mixer.BitStream(data, lead, groups[token * 0])
        for bit in range(8):
            for k in range(mixer.PREDICTORS):
                np.add.at(table[k].reshape(-1), stream.slots[bit, k] * 2 + stream.bits[bit], stream.repeat(np.full(len(data), 4.0)))
    assert (table[:, :, :].sum(axis=(1, 2)) >= tables.sum(axis=(1, 2))).all()


def plain_phrases(docs, letters):
    """Contexts, phrases and the price of every text by dictionaries, given the letter model's price of a word."""
    def cut(t):
        w = tokens(t)[:-1]
        h = np.array([int(words.words(pa.array([x])).hashes()[0]) for x in w], dtype=np.uint64)
        prior = np.concatenate([[phrases._START], h[:-1]]) if len(h) else h
        two = words.chain(prior, h) if len(h) else h
        at = [i for i in range(len(w)) if i == 0 or int(two[i]) % phrases.RATE == 0]
        for i, j in zip(at, at[1:] + [None], strict=True):
            yield (w[i - 1] if i else None, w[i]), tuple(w[i + 1:] + [""] if j is None else w[i + 1:j + 1])

    seen = {}
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for ctx, phrase in cut(t):
                seen.setdefault(ctx, Counter())[phrase] += 1
    return cut, seen


@pytest.mark.parametrize("frequent", [1000, 3])
def test_phrases_equal_a_plain_version(docs_of, frequent):
    rng = np.random.default_rng(5)
    shared = " ".join(f"w{x}" for x in rng.integers(0, 60, 200))
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 25, 120)) + (" " + shared if i % 3 else "")) for i in range(60)]
    cut, seen = plain_phrases(docs, None)
    d = docs_of(docs)
    look = d.select("doc_id", "text").mapInArrow(mixer._first_look, "ctx long, key long, c long").filter("ctx IS NOT NULL")
    spoken = phrases.fit(look, mixer.most_frequent, frequent=frequent)
    leave = {r.ctx: r.miss for r in spoken.contexts.collect()}
    priced = {r.key: r for r in spoken.phrases.collect()}
    price = {k: r.lp for k, r in priced.items()}
    assert len(leave) == len(seen) and len(price) == sum(map(len, seen.values()))
    # hit and shares of a context sum to what is left of leaving it
    total = sum(10 ** v for v in price.values())
    assert total == pytest.approx(sum(1 - 10 ** v for v in leave.values()), rel=1e-6)
    # the rows of a join and the frequent arrays price a text alike: 1.0 a phrase by the letters
    text = pa.array([t for _, t in docs])
    w = words.words(text, lower=True)
    c = phrases.Cut(w, w.hashes())
    spark = d.sparkSession
    got = dict(phrases.settled(spark.createDataFrame(
        [(int(r), zlib.crc32(str(r).encode()) % 7 == 2, int(x), int(k), -1.0, None) for r, x, k in zip(c.doc, c.context.view(np.int64), c.key.view(np.int64), strict=True)],
        "row long, held_out boolean, ctx long, key long, words double, miss double"), spoken).collect())
    for row, (_, t) in enumerate(docs):
        want = 0.0
        own = c.doc == row
        keys, contexts = c.key[own].view(np.int64), c.context[own].view(np.int64)
        parts = list(cut(t))
        assert len(parts) == len(keys)
        for (ctx, phrase), key, context in zip(parts, keys.tolist(), contexts.tolist(), strict=True):
            assert (phrase in seen.get(ctx, {})) == (key in price)
            times = seen.get(ctx, {}).get(phrase, 0)
            if zlib.crc32(str(row).encode()) % 7 == 2:
                want += price[key] if times else -1.0 + leave.get(context, 0.0)
            else:  # its own occurrence is left out
                n = sum(seen[ctx].values())
                want += priced[key].own - (times == 1)
                assert priced[key].once == (times == 1) and (n > 1 or priced[key].own == 0)
                assert times < 2 or priced[key].own < log10((times - 1) / (n - 1)) + 1e-12
        assert got.get(row, 0.0) == pytest.approx(want, rel=1e-9)


def test_repeated_documents_are_told_apart_and_tables_grow(docs_of):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"v{x}" for x in rng.zipf(1.3, 300) % 3000) for _ in range(80)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:20])]
    rows = mixer.score(docs_of(docs), mixer.fit(docs_of(docs))).collect()
    trained = {r.doc_id: r.score / r.n_tokens for r in rows if not r.held_out}
    twice = [v for k, v in trained.items() if k >= 1000 and k - 1000 in trained]
    once = [v for k, v in trained.items() if 20 <= k < 1000]
    held = [r.score / r.n_tokens for r in rows if r.held_out and 20 <= r.doc_id < 1000]
    better = np.mean([a > b for a in twice for b in once])
    assert better == 1 and np.mean(once) < 1.5 * np.mean(twice)
    assert abs(np.mean(once) - np.mean(held)) < 0.3 * abs(np.mean(held))  # not known by heart
    small = mixer.fit(docs_of(docs[:20])).spoken.phrases.count()
    assert small < 0.4 * mixer.fit(docs_of(docs)).spoken.phrases.count()


def test_defined_cases(docs_of):
    d = docs_of([(1, None), (2, ""), (3, "Ab ab AB cd"), (3, "ab"), (None, "ab"), (4, "w" * 20_000), (5, "ab " * 30_000)])
    rows = mixer.score(d, mixer.fit(d)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (1, 1), (2, 1), (3, 2), (3, 5), (4, 2), (5, 30_001)]
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    e = d.limit(0)
    assert mixer.score(e, mixer.fit(e)).count() == 0
    held = docs_of([(i, "x y") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])
    got = mixer.score(held, mixer.fit(held)).collect()
    assert got and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)


def test_counter_blocks_travel_packed():
    half = (2 << mixer.SLOTS) // mixer.BLOCKS
    counts = np.zeros(half, dtype=np.float32)
    counts[[3, 70]] = 2, 5
    blob = pa.compress(counts.tobytes(), codec="zstd", asbytes=True)
    rows = pa.RecordBatch.from_arrays([pa.array([17, 17], pa.int32()), pa.array([4, 4], pa.int32()), pa.array([blob, blob], pa.binary())],
                                      names=["block", "wide", "counts"])
    (out,) = mixer._sum_blocks(iter([rows]))
    packed = out.column(1)[0].as_py()
    assert len(packed) < counts.nbytes // 100
    table = mixer.Packed({out.column(0)[0].as_py(): packed}).table(1).ravel()
    assert np.flatnonzero(table).tolist() == [half + 3, half + 70] and table[[half + 3, half + 70]].tolist() == [4, 10]
    assert not mixer.Packed({}).table(0).any()


def test_common_beginnings_are_looked_at_once():
    rng = np.random.default_rng(7)
    long = b"q" * 700
    tokens = [b"abcd", b"abce", b"ab", b"abcdefghij", b"abcdefghik", b"", long, long[:300], long + b"z", "ééa".encode(), "ééb".encode()] * 2
    groups, times = rng.integers(0, 3, len(tokens)), rng.integers(1, 4, len(tokens))
    order = mixer.by_prefix(tokens, groups)
    assert sorted(order.tolist()) == list(range(len(tokens)))
    tables = np.zeros((mixer.PREDICTORS, 1 << mixer.SLOTS, 2))
    mixer.count_bits(tokens, groups, times, tables)
    alone = np.zeros_like(tables)
    for i in range(len(tokens)):
        mixer.count_bits(tokens[i:i + 1], groups[i:i + 1], times[i:i + 1], alone)
    assert (tables == alone).all()
    model = mixer.Model(**mixer.Model.arrays(tables)).leave_out(tables)
    model.learn(tokens, groups, times, 0.3)
    one = np.concatenate([model.log10(tokens[i:i + 1], groups[i:i + 1]) for i in range(len(tokens))])
    assert model.log10(tokens, groups) == pytest.approx(one, rel=1e-12)
    # words that begin alike share the slots of their beginning
    stream = mixer.BitStream([b"abcd ", b"abce ", b"abce "], [b"    "] * 3, np.array([1, 1, 2]))
    assert stream.bits.shape[1] == 5 + 2 + 5 and stream.place.tolist() == [0, 1, 2, 3, 4, 0, 1, 2, 5, 6, 7, 8, 9, 10, 11]
    assert stream.repeat(np.array([1.0, 2.0, 4.0])).tolist() == [3, 3, 3, 1, 1, 2, 2, 4, 4, 4, 4, 4]
