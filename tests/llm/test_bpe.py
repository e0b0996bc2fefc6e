"""Token counts against the library."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "It's Ωςά ΑΣ <|endoftext|>foo<|ENDOFTEXT|> ab<|startoftext|>", "a" * 700 + " " + "ab" * 300,
       "é 12345 ½ ² don't we'll I'D \u0085z q", "日本語 ß İI ﬁ ǅ 𝔘𝔫 👩‍👩‍👧", "aaaa aaaaa aaaaaaa ....... !!!!!!!! ------",
       "x\x1cy\x1fz\x00q", "word " * 60_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_odd_texts(docs_of, library):
    from docskein.llm.bpe import token_counts

    d = docs_of([(i, t) for i, t in enumerate(ODD)] + [(None, "abc")])
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(d, PATH).collect()}
    for i, t in enumerate(ODD):
        assert got[i] == (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)), repr(t)[:60]
    assert got[None] == (3, len(library.encode("abc", add_special_tokens=False).ids))
    assert token_counts(d.limit(0), PATH).count() == 0


def test_query_equals_library(spark, inputs, library):
    from docskein.llm.queries import QUERIES

    rows = inputs.documents.collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op6_token_counts"](spark, inputs.sf_dir).collect()}
    sizes = [len(e.ids) for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    assert got == {r.doc_id: (len((r.text or "").encode()), n, n > 2048) for r, n in zip(rows, sizes)}
