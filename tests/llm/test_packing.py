"""Ids against the library, an exact round trip of pieces and places, and the number of sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docskein.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  x  y ", "It's Ωςά  ΑΣ <|endoftext|>foo <|endoftext|> bar", "é é  à 　 b\n \nc a", "x\x1c y\x1fz\x00",
       "word " * 40_000, "a" * 5000, "word " * 1023, "日本語 テキスト 👩‍👩‍👧"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts, library):
    """Every document's ids come back from its pieces; sequences have no gap and no overflow."""
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    at = {}
    for r in rows:
        own = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert len(own) == r.length <= 1024 and zlib.crc32(own.tobytes()) == r.ids_crc32
        at.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for k, cut in at.items():
        cut.sort()
        assert [p for p, _, _ in cut] == list(range(len(cut))) and sum(n for _, _, n in cut) == len(ids[k])
        assert all(a[1] + a[2] == b[1] for a, b in zip(cut, cut[1:])) and all(n == 1024 for _, _, n in cut[1:])
    assert set(at) == set(ids)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert spans[-1][0] + spans[-1][1] <= 1024
    return len(places), -(-sum(map(len, ids.values())) // 1024)


def test_odd_texts(docs_of, library):
    rows = packing.packed_documents(docs_of(list(enumerate(ODD))), PATH).collect()
    check(rows, dict(enumerate(ODD)), library)
    again = packing.packed_documents(docs_of([(1, "a b"), (1, "a b"), (None, "c")]), PATH).collect()
    assert len(again) == 3 and {r.sequence_id for r in again} == {again[0].sequence_id}
    assert packing.packed_documents(docs_of([(1, "")]).limit(0), PATH).count() == 0


def test_query_round_trip(spark, inputs, library):
    from docskein.llm.queries import QUERIES

    rows = QUERIES["op3_pack_sequences"](spark, inputs.sf_dir).collect()
    used, least = check(rows, {r.doc_id: r.text for r in inputs.documents.collect()}, library)
    assert used <= 1.02 * least + 1


@pytest.mark.parametrize("low,high", [(1, 1023), (300, 600), (340, 345), (512, 514), (1, 40)])
def test_local_search_never_overfills(low, high):
    length = np.random.default_rng(low).integers(low, high, 1500)
    start = packing.best_fit(length, 1024)
    end = packing.improve(length, start, 1024)
    assert np.bincount(end, weights=length).max() <= 1024
    assert len(np.unique(end)) <= len(np.unique(start))
