"""How far the sources of a language stray from one another, and by which terms.

A pipeline of Arrow kernels inside ``mapInArrow`` lower-cases, splits, dictionary-encodes and hash-groups each slice of
texts into partial counts, which tasks merge before they send them. Spark sums them by language, source and term. Terms of
a language that enough of its documents hold are kept, dealt by hash into columnar shards of about ``CELLS`` numbers (terms
× sources), and every shard yields its part of each pair's divergence and its strongest terms of each source.

A count becomes the probability p = 1 + floor(10^9 (count + 1) / (N + V)), N the source's occurrences of kept terms, V
their number; the divergence of p from q is the sum of floor((p - q)² / q). All of it is integer arithmetic: sums stay below
2^63 because probabilities add up to about 10^9.

Sources of a language are worked on in blocks of ``BLOCK``, so a task holds BLOCK rows of pairs per source and never all
pairs; the result itself has every ordered pair, as asked for. A common word is one row per task and source before the
shuffle; no language, source or term is gathered whole.

Defined cases: null text, language or source read as ''. A source without terms still takes part; a language without kept
terms gives pairs of value 0 and no terms; one with a single source gives no pairs. Rows that repeat are documents of their
own, as are rows of one id. Long texts are slices of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docskein.llm.words import slices
from docskein.session import ship, stored

BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
FEWEST_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
CELLS, BLOCK, HELD_ROWS = 1 << 17, 256, 400_000
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEYS = ["lang", "source", "term"]


def _text(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def _slice_counts(rows: pa.RecordBatch) -> pa.Table:
    """Partial counts of one slice; a row of null term says that the source occurs."""
    lang, source = (_text(rows.column(i)).dictionary_encode() for i in (0, 1))
    split = pc.split_pattern_regex(pc.ascii_lower(_text(rows.column(2))), pattern=BREAK)
    doc, term = pc.list_parent_indices(split), pc.list_flatten(split)
    real = pc.not_equal(term, "")
    doc, term = doc.filter(real), term.filter(real).dictionary_encode()
    # once per document and term, then per language, source and term; all keys are codes
    each = pa.table({"doc": doc, "term": term.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    at = each.column("doc").combine_chunks()
    coded = pa.table({"lang": lang.indices.take(at), "source": source.indices.take(at), "term": each.column("term"),
                      "n": each.column("count_all")}).group_by(_KEYS).aggregate([("n", "sum"), ("n", "count")])
    seen = pa.table({"lang": lang.indices, "source": source.indices}).group_by(["lang", "source"]).aggregate([])

    def words_of(codes: pa.ChunkedArray, values: pa.DictionaryArray) -> pa.Array:
        return values.dictionary.take(codes.combine_chunks())

    counts = pa.table([words_of(coded.column("lang"), lang), words_of(coded.column("source"), source),
                       words_of(coded.column("term"), term), coded.column("n_sum").cast(pa.int64()),
                       coded.column("n_count").cast(pa.int64())], schema=_PARTIAL)
    none = pa.nulls(seen.num_rows, pa.string())
    zero = pa.array(np.zeros(seen.num_rows, dtype=np.int64))
    return pa.concat_tables([counts, pa.table([words_of(seen.column("lang"), lang), words_of(seen.column("source"), source),
                                               none, zero, zero], schema=_PARTIAL)])


def _merge(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns(_PARTIAL.names).cast(_PARTIAL)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for rows in slices(batches):
        held.append(_slice_counts(rows))
        if sum(t.num_rows for t in held) > HELD_ROWS:
            held = [_merge(held)]
            if held[0].num_rows > HELD_ROWS // 2:  # merging no longer shrinks it: send it on
                yield from held.pop().to_batches(max_chunksize=65_536)
    if held:
        yield from _merge(held).to_batches(max_chunksize=65_536)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null term for each source that occurs."""
    parts = docs.select(docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"),
                        docs["text"].cast("string").alias("text")).mapInArrow(
        _partials, "lang string, source string, term string, n long, docs long")
    return parts.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probabilities(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact while total + kept stays below 9 · 10^13."""
    top, below = count + 1, total + kept
    # 10^9 = 10^4 · 10^5, long division in two steps; every product stays below 10^5 × (total + kept)
    high, rest = np.divmod(top * 10_000, below)
    return 1 + high * 100_000 + rest * 100_000 // below


def _shard(block: int, top: int):
    """Function of (terms of one shard, sources of their language): partial pair sums and the strongest terms."""

    def run(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
        lang, _, part = (k.as_py() for k in key)
        sources = sources.sort_by("place")
        kept, lang_total = (int(sources.column(c)[0].as_py()) for c in ("kept", "lang_total"))
        total = sources.column("total").to_numpy()
        first = part * block
        mine = np.arange(first, min(first + block, len(total)))
        sums = np.zeros((len(mine), len(total)), dtype=np.int64)
        out_place, out_item, out_value = [], [], []
        if terms.num_rows:
            held = terms.column("by_source").combine_chunks()
            row = pc.list_parent_indices(held).to_numpy()
            flat = pc.list_flatten(held)
            count = np.zeros((len(total), terms.num_rows), dtype=np.int64)
            count[flat.field("place").to_numpy(), row] = flat.field("n").to_numpy()
            p = probabilities(count, total[:, None], kept)
            q = probabilities(terms.column("lang_n").to_numpy(), lang_total, kept)
            names = terms.column("term").combine_chunks()
            for i, g in enumerate(mine):
                gap = p[g] - p
                sums[i] = (gap * gap // p).sum(axis=1)
                at = np.flatnonzero((count[g] > 0) & (p[g] > q))
                gap = p[g][at] - q[at]
                best = pa.table({"item": names.take(pa.array(at)), "value": gap * gap // q[at]}).sort_by(
                    [("value", "descending"), ("item", "ascending")]).slice(0, top)
                out_place.append(np.full(best.num_rows, g))
                out_item.append(best.column("item").combine_chunks())
                out_value.append(best.column("value").to_numpy())
        pairs = len(mine) * len(total)
        place = np.concatenate([np.repeat(mine, len(total)), *out_place])
        other = np.concatenate([np.tile(np.arange(len(total)), len(mine)), np.full(len(place) - pairs, -1)])
        return pa.table({"lang": pa.array([lang] * len(place), pa.string()), "place": pa.array(place, pa.int32()),
                         "other": pa.array(other, pa.int32()), "item": pa.concat_arrays([pa.nulls(pairs, pa.string()), *out_item]),
                         "value": pa.array(np.concatenate([sums.ravel(), *out_value]), pa.int64())})

    return run


def audit(docs: DataFrame, fewest_docs: int = FEWEST_DOCS, top: int = TOP_TERMS, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from every other source and the terms that mark a source."""
    ship(docs.sparkSession)
    counts = stored(term_counts(docs), "term-counts")
    # one place per source of a language; languages have few sources beside terms
    listed = stored(counts.filter("term IS NULL").select("lang", "source", (F.row_number().over(
        Window.partitionBy("lang").orderBy("source")) - 1).alias("place")), "sources")
    by_term = counts.filter("term IS NOT NULL").join(listed, ["lang", "source"]).groupBy("lang", "term").agg(
        F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("place", "n")).alias("by_source"))
    kept = stored(by_term.filter(F.col("in_docs") >= fewest_docs).drop("in_docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = kept.select("lang", F.explode("by_source").alias("s")).groupBy("lang", F.col("s.place").alias("place")).agg(
        F.sum("s.n").alias("total"))
    none = F.lit(0).cast("long")
    sources = listed.join(totals, ["lang", "place"], "left").join(langs, "lang", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("total", "kept", "lang_total")}).withColumn(
        "n_sources", F.count("*").over(Window.partitionBy("lang")))
    shards = F.greatest(F.ceil(F.col("kept") * F.col("n_sources") / F.lit(cells)), F.lit(1))
    sources = stored(sources.withColumns({"shards": shards.cast("long"), "blocks": F.ceil(F.col("n_sources") / F.lit(block)).cast("long")}),
                     "sources-sized")
    layout = sources.select("lang", "shards", "blocks").distinct()
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    left = kept.join(layout, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), every_block,
                                            "term", "lang_n", "by_source")
    right = sources.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "blocks",
                           "place", "total", "kept", "lang_total").select(
        "lang", "shard", every_block, "place", "total", "kept", "lang_total")
    keys = ["lang", "shard", "block"]
    found = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _shard(block, top), "lang string, place int, other int, item string, value long"), "shard-parts")
    names = listed.select(F.col("lang").alias("_lang"), F.col("place").alias("_place"), F.col("source").alias("_source"))

    def named(t: DataFrame, place: str, name: str) -> DataFrame:
        return t.join(names, (F.col("lang") == F.col("_lang")) & (F.col(place) == F.col("_place"))).withColumn(
            name, F.col("_source")).drop("_lang", "_place", "_source")

    pairs = found.filter((F.col("other") >= 0) & (F.col("other") != F.col("place"))).groupBy("lang", "place", "other").agg(
        F.sum("value").alias("value"))
    pairs = named(pairs, "other", "item").select("lang", "place", F.lit("pair").alias("part"), "item", "value")
    terms = found.filter(F.col("other") < 0).select("lang", "place", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "place", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return named(ranked, "place", "source").select("lang", "source", "part", "item", "value", "rank")
