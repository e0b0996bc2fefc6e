"""Mixing sources to target weights by exponential keys.

Sources share a budget of words by weight; a source stops at ``most`` times its size and the excess goes to the others
by weight, until none is above (one level of water for all that are not full). A source then takes whole epochs first.
For the fraction that is left every document draws the key -ln(u) / w, with u a hash of its id and w its quality
weight (Efraimidis and Spirakis: the smallest keys are a weighted sample without replacement), and documents are taken
in the order of keys until the words add up to the rest of the target. With ``whole`` false the document at the border
gives just the words that are missing; with ``whole`` true it goes in when that brings the sum nearer to the target.

No source is ever sorted in one task. Keys are cut into ``cells`` of equal probability; sizes are summed per source and
cell before the shuffle, running sums over a source's cells find the one that holds the border, and only the documents
of that cell are ranked.

Defined cases: a null text has size 0, a null source is a source of its own, last in the order. Documents of size 0 take
no words (whole epochs still return them). Ids that repeat draw the same key; rows of equal id, source, size and weight
are interchangeable, and a running number among them keeps the sums exact. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.llm.base import batch, same
from docskein.llm.words import per_doc, slices, words
from docskein.session import stored

CELLS = 4096
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>!")] = True


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("symbols", pa.int64())])
    for rows in slices(batches):
        w = words(rows.column(2))
        yield batch(schema, rows.column(0), rows.column(1), w.counts, per_doc(_SYMBOL[w.buf], w.offsets))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, symbols): words and symbol characters of every text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(
        _measure, "doc_id long, source string, size long, symbols long")


def quality_weight() -> Column:
    """1 for plain prose, towards 0 as symbols per word grow."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(4.0) * F.col("symbols") / F.greatest(F.col("size"), F.lit(1)))


def unit(doc_id: Column, seed: str) -> Column:
    """Uniform number in (0, 1) from the first 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(measured: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target), one row per source; ``weights`` repeat over the sources by code point, null last.

    Reads one aggregated row per source, never documents.
    """
    by_source = stored(measured.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = by_source.withColumn("place", F.row_number().over(order) - 1)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    listed = listed.withColumn("weight", F.element_at(pattern, (F.col("place") % len(weights) + 1).cast("int"))).withColumn(
        "room", F.col("source_size") * F.lit(float(most)))
    # sources fill in the order of room per weight; the level is the first at which the rest holds what is left
    filling = Window.orderBy(F.col("room") / F.col("weight"), "place")
    run = listed.withColumns({
        "full_before": F.coalesce(F.sum("room").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "budget": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)),
        "weight_all": F.sum("weight").over(Window.partitionBy())})
    run = run.withColumn("level", (F.col("budget") - F.col("full_before")) / (F.col("weight_all") - F.col("weight_before")))
    fits = F.col("level") * F.col("weight") <= F.col("room")
    run = run.withColumn("settled", F.min(F.when(fits, F.struct(F.col("room") / F.col("weight"), "place", "level"))).over(
        Window.partitionBy())["level"])
    target = F.when(F.col("settled").isNull(), F.col("room")).otherwise(
        F.least(F.col("room"), F.col("settled") * F.col("weight")))
    return run.select("source", "source_size", target.alias("target"))


def mix(measured: DataFrame, goals: DataFrame, seed: str = "mix", whole: bool = False, cells: int = CELLS) -> DataFrame:
    """``measured(doc_id, source, size, symbols)`` with source_size, target, epochs, and ``taken`` words (all epochs)."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = stored(goals.withColumn("epochs", epochs).withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "targets")
    g = goals.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "rest")
    rows = measured.join(g, same("source", "_source")).drop("_source")
    key = -F.log(unit(F.col("doc_id"), seed)) / quality_weight()
    rows = rows.withColumn("key", key).withColumn("cell", F.floor((1 - F.exp(-F.col("key"))) * cells).cast("int"))
    per_cell = rows.groupBy("source", "rest", "cell").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source").orderBy("cell")  # at most ``cells`` rows of a source
    run = per_cell.withColumn("upto", F.sum("words").over(over))
    border = stored(run.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))).groupBy(
        "source").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("b")).select(
        F.col("source").alias("_source"), F.col("b.cell").alias("_cell"), F.col("b.before").alias("_before")), "borders")
    rows = rows.join(border, same("source", "_source"), "left").drop("_source")
    inside = F.coalesce(F.col("cell") < F.col("_cell"), F.col("rest") > 0)
    # dealt anew by source and cell, so that the join above stays free to split a large source
    at_border = rows.filter(F.col("cell") == F.col("_cell")).repartition("source", "cell")
    ranked = at_border.withColumn("upto", F.sum("size").over(
        Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(
            Window.unboundedPreceding, 0)) + F.col("_before"))
    start = F.col("upto") - F.col("size")
    part = F.least(F.col("size"), F.col("rest") - start)
    if whole:
        some = F.when(start + F.col("size") / 2 <= F.col("rest"), F.col("size")).otherwise(0)
    else:
        some = F.when(start < F.col("rest"), part).otherwise(0)
    other = rows.filter(F.col("_cell").isNull() | (F.col("cell") != F.col("_cell"))).withColumn(
        "extra", F.when(inside, F.col("size")).otherwise(0))
    cols = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    both = other.select(*cols, "extra").unionByName(ranked.select(*cols, some.alias("extra")))
    return both.select(*cols, "extra", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def mixed(docs: DataFrame, weights: list[float], share: float, most: float, seed: str = "mix", whole: bool = False) -> DataFrame:
    """Words that the mix takes of every document: (doc_id, source, size, source_size, target, epochs, extra, taken)."""
    measured = stored(sizes(docs), "sizes")
    return mix(measured, targets(measured, weights, share, most), seed, whole)


def mixed_documents(docs: DataFrame, weights: list[float], share: float, most: float, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it is taken whole. Rows without an id are taken by whole epochs of
    their source, for a later draw could not name them."""
    plan = mixed(docs, weights, share, most, seed, whole=True)
    times = plan.select("doc_id", (F.col("epochs") + (F.col("extra") > 0).cast("long")).alias("times"))
    by_id = times.groupBy("doc_id").agg(F.max("times").alias("times")).select(F.col("doc_id").alias("_id"), "times")
    # columns are named by their table: ``docs`` may have columns of the same names
    return docs.join(by_id, docs["doc_id"].eqNullSafe(by_id["_id"])).select(
        *[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), by_id["times"].cast("int"))).alias("__copy")).drop("__copy")
