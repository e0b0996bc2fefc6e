"""Extra columns that carry the names that operators use inside."""

from pyspark.sql import functions as F

from docskein.llm import bpe, chunks, mixer, mixing, packing, quality, setjoin, simhash, sites
from docskein.llm.queries import public_tokenizers

NAMES = ["_id", "_gone", "_runs", "times", "col", "fp", "size", "key", "cell", "row", "quality", "host", "path", "part", "lines", "words", "h", "c", "start",
         "evidence", "soft", "component_id", "root", "low", "extra", "taken", "bucket", "digest", "probability", "kept"]


def test_every_operator(docs_of, inputs):
    text = " ".join(f"word{i}" for i in range(90))
    d = docs_of([(1, text + "\nshared line of some words"), (2, text), (3, None), (3, "shared line of some words\nb"), (None, "x y")])
    d = d.withColumns({n: F.lit(n) for n in NAMES})
    names = d.columns
    assert simhash.near_duplicates(d).count() == 5 and mixing.mixed(d, [3, 1, 2], 1.5, 2.0).count() == 5
    assert setjoin.line_report(d).count() == 5 and bpe.token_counts(d, public_tokenizers.path("word_bpe_49k.json")).count() == 5
    assert packing.packed_documents(d, public_tokenizers.path("byte_bpe_50k.json")).count() >= 5
    assert quality.assess(d, quality.fit(d, inputs.labels)).count() == 5
    assert sites.posteriors(d, inputs.labels, F.col("source"), F.col("lang")).count() == 5
    assert mixer.score(d, mixer.fit(d)).count() == 5 and chunks.repeated_runs(d).count() == 1
    for out in (simhash.one_per_group(d), setjoin.without_repeated_lines(d), chunks.without_repeats(d), quality.keep_good(d, inputs.labels),
                mixing.mixed_documents(d, [3, 1, 2], 1.5, 2.0)):
        assert out.columns == names
        assert all(r["_id"] == "_id" and r["col"] == "col" and r["times"] == "times" for r in out.collect())
