"""Phrase bits: does the text go on as it went on before after these two words?

A word is an anchor when the hash of it and the word before it falls into one of ``RATE`` classes, so equal passages have
equal anchors wherever they stand; the first word of a document is one always. The phrase of an anchor runs to the next anchor of the document, included, or to the end
of the document, end token included. The context of a phrase is the pair of words at its anchor.

At an anchor one bit is coded: 1 when the phrase is one that its context had in training. A 1 is followed by the phrase
itself at its share of the context's occurrences, a 0 by the words at the letter model's price; a context never seen takes
no bit. The bit has two predictors, the counter of the hashed context and that of all contexts seen as often, mixed by
weights that this frequency selects. The counters count what training would have met: an occurrence is a hit when its
phrase occurs elsewhere too, so the single ones are the misses. Weights are learned online in mini-batches over the table
of contexts with each occurrence taken out of its own counters, in every task on its share, and averaged by mass.

A training document meets each of its phrases without that one occurrence, in the bit and in the share, so its price is that
of a text the model has not seen but for what occurs elsewhere too; otherwise every training document would be known by heart.

Phrases and contexts are Spark tables that grow with the corpus. The most frequent ones, bounded tables, are known to all
tasks; that also keeps any key that a large part of the corpus shares out of the join, which the rest goes through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch
from docskein.llm.chunks import digests
from docskein.llm.words import Words, chain, distinct, mix
from docskein.session import stored

RATE = 32  # one word in so many is an anchor
DEPTHS = np.array([1, 2, 3, 4, 8, 16, 64, 512, 4096])  # occurrences of a context that select the weights
FREQUENT = 1 << 18  # phrases, and contexts, whose prices travel to all tasks
_U = np.uint64
_START = _U(0x7F4A7C159E3779B9)


class Cut:
    """Phrases of a slice: word range ``begin:end``, whether the document ends there, document, context and own key."""

    def __init__(self, w: Words, hashes: np.ndarray):
        prior = np.concatenate([[_START], hashes[:-1]]) if len(hashes) else hashes
        begins = w.first[:-1][w.counts > 0]
        prior[begins] = _START
        two = chain(prior, hashes)
        chosen = two % _U(RATE) == 0
        chosen[begins] = True
        anchor = np.flatnonzero(chosen)
        stop = np.repeat(w.first[1:], w.counts)[anchor] if len(hashes) else anchor
        following = np.append(anchor[1:] + 1, np.iinfo(np.int64).max)[:len(anchor)]
        self.begin, self.end = anchor + 1, np.minimum(following, stop)
        self.closes = following > stop
        self.doc = w.doc[anchor]
        # mixed again: the anchors' own hashes share their low bits
        self.context = mix(two[anchor] + _U(1))
        self.key = chain(self.context, digests(hashes, self.begin, self.end), self.closes.astype(np.uint64))


def count(w: Words, hashes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, key, occurrences) of the phrases of the training documents of a slice."""
    cut = Cut(w, hashes)
    used = train[cut.doc]
    context, key = cut.context[used], cut.key[used]
    keys, first, place = distinct(key)
    return context[first], keys, np.bincount(place, minlength=len(keys))


def _odds(hits, misses):
    return np.log((np.maximum(hits, 0) + 0.4) / (np.maximum(misses, 0) + 0.4))


def _class(n):
    return np.maximum(np.searchsorted(DEPTHS, n, side="right") - 1, 0)


def _squash(z):
    return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def first_weights() -> np.ndarray:
    """(context's counter, class's counter, constant) by class, before learning."""
    return np.tile([0.5, 0.5, 0.0], (len(DEPTHS), 1))


def examples(n: np.ndarray, single: np.ndarray, twice: np.ndarray):
    """(occurrences without this one, its context's odds, bit, mass): single, double and other phrases of each context."""
    more = n - single - 2 * twice
    return [(n - 1, _odds(n - single, single - 1), 0, single), (n - 1, _odds(n - single - 2, single + 1), 1, 2 * twice),
            (n - 1, _odds(n - single - 1, single), 1, more)]


def _learn(classes: np.ndarray, rate: float):
    schema = pa.schema([("at", pa.int32()), ("value", pa.float64()), ("mass", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total, step = first_weights(), np.zeros(len(DEPTHS)), 0
        for rows in batches:
            for at in range(0, rows.num_rows, 4096):
                part = rows.slice(at, 4096)
                n, single, twice = (part.column(c).to_numpy().astype(np.int64) for c in range(3))
                for seen, own, bit, mass in examples(n, single, twice):
                    live = mass > 0
                    gate, own, mass = _class(seen[live]), own[live], mass[live].astype(np.float64)
                    x = np.stack([own, classes[gate], np.ones(len(own))], axis=1)
                    err = (bit - _squash((weights[gate] * x).sum(axis=1))) * mass
                    all_mass = np.bincount(gate, mass, len(DEPTHS))
                    # a batch of one kind of bit at a time: its share of the class's mass so far bounds the step
                    total += all_mass
                    pace = rate / (1 + step / 50) ** 0.5 / np.maximum(total, 1)
                    for k in range(3):
                        weights[:, k] += pace * np.bincount(gate, err * x[:, k], len(DEPTHS))
                step += 1
        if total.any():
            yield batch(schema, np.arange(weights.size), weights.ravel() * np.repeat(total, 3), np.repeat(total, 3))

    return run


class Prices:
    """The learned bit as column expressions over a context's occurrences ``n`` and its counter."""

    def __init__(self, classes: np.ndarray, weights: np.ndarray):
        self.offset = F.lit((weights[:, 1] * classes + weights[:, 2]).tolist())
        self.factor = F.lit(weights[:, 0].tolist())

    def hit(self, n: Column, hits: Column, misses: Column) -> Column:
        """Probability of a hit."""
        level = sum(((n >= d).cast("int") for d in DEPTHS[1:].tolist()), F.lit(1))
        odds = F.log((F.greatest(hits, F.lit(0)) + 0.4) / (F.greatest(misses, F.lit(0)) + 0.4))
        z = F.element_at(self.factor, level) * odds + F.element_at(self.offset, level)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))))

    def leave(self) -> Column:
        n, single = F.col("n"), F.col("single")
        return F.log10(1 - self.hit(n, n - single, single))

    def whole(self) -> Column:
        """Price of a phrase seen ``c`` times."""
        n, single = F.col("n"), F.col("single")
        return F.log10(self.hit(n, n - single, single)) + F.log10(F.col("c") / n)

    def own(self) -> Column:
        """The same without one of the ``c``: what is left of a single one is leaving its context."""
        n, single, c = F.col("n"), F.col("single"), F.col("c")
        rest = F.log10((c - 1) / (n - 1))
        return (F.when(n == 1, 0.0).when(c == 1, F.log10(1 - self.hit(n - 1, n - single, single - 1)))
                .when(c == 2, F.log10(self.hit(n - 1, n - single - 2, single + 1)) + rest)
                .otherwise(F.log10(self.hit(n - 1, n - single - 1, single)) + rest))


class Phrases:
    """Prices (log10) of phrases and of leaving a context's phrases: whole tables, and the frequent ones as sorted arrays."""

    def __init__(self, phrases: DataFrame, contexts: DataFrame, frequent: list[np.ndarray], leaving: list[np.ndarray]):
        self.phrases, self.contexts, self.frequent, self.leaving = phrases, contexts, frequent, leaving


def fit(seen: DataFrame, top, rate: float = 0.5, frequent: int = FREQUENT) -> Phrases:
    """Prices from ``seen(ctx, key, c)``, the phrases of training documents by slice; ``top(rows, most)`` picks by ``c``."""
    phrases = stored(seen.groupBy("ctx", "key").agg(F.sum("c").alias("c")), "phrases")
    contexts = stored(phrases.groupBy("ctx").agg(
        F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("single"), F.count_if(F.col("c") == 2).alias("twice")), "contexts")
    level = F.lit(0)
    for d in DEPTHS[1:].tolist():
        level = level + (F.col("n") >= d).cast("int")
    hits, misses = np.zeros(len(DEPTHS)), np.zeros(len(DEPTHS))
    for r in contexts.groupBy(level.alias("level")).agg(F.sum(F.col("n") - F.col("single")).alias("hits"),
                                                        F.sum("single").alias("misses")).collect():  # a row a class
        hits[r["level"]], misses[r["level"]] = r["hits"], r["misses"]
    classes = _odds(hits, misses)
    weights = first_weights()
    learned = contexts.filter("n > 1").select("n", "single", "twice").mapInArrow(
        _learn(classes, rate), "at int, value double, mass double").groupBy("at").agg(F.sum("value"), F.sum("mass"))
    for at, value, mass in learned.collect():  # three rows a class
        if mass:
            weights.ravel()[at] = value / mass
    prices = Prices(classes, weights)
    # a context has as many rows of phrases as it has phrases: AQE splits the few that are very frequent
    priced = stored(phrases.join(contexts.select("ctx", "n", "single"), "ctx").select(
        "key", "c", prices.whole().alias("lp"), prices.own().alias("own")), "phrase-prices").withColumn("once", F.col("c") == 1)
    leaving = contexts.select("ctx", F.col("n").alias("c"), prices.leave().alias("miss"))
    return Phrases(priced.drop("c"), leaving.drop("c"), _sorted(top(priced, frequent), "key", "lp", "own", "once"),
                   _sorted(top(leaving, frequent), "ctx", "miss"))


def _sorted(rows: DataFrame, key: str, *values: str) -> list[np.ndarray]:
    got = rows.select(key, *values).toArrow()  # at most ``frequent`` rows of 32 bytes
    keys = got[key].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return [keys[order]] + [got[v].to_numpy()[order] for v in values]


def settled(open_: DataFrame, model: Phrases) -> DataFrame:
    """(row, price): sum of the prices of ``open_(row, held_out, ctx, key, words, miss)``, whose phrases are not frequent.

    ``words`` is the letter model's price; ``miss`` that of leaving the context, null where it is not a frequent one.
    """
    found = F.when(F.col("held_out"), F.col("lp")).when(F.col("once"), F.col("own") + F.col("words")).otherwise(F.col("own"))
    met = stored(open_.join(model.phrases, "key", "left").select(
        "row", F.when(F.col("lp").isNull() & F.col("miss").isNull(), F.col("ctx")).alias("ctx"),
        F.when(F.col("lp").isNotNull(), found).otherwise(F.col("words") + F.col("miss")).alias("price"), "words"), "met")
    left = met.filter("price IS NULL").join(model.contexts, "ctx", "left").select(
        "row", (F.col("words") + F.coalesce("miss", F.lit(0.0))).alias("price"))
    return met.filter("price IS NOT NULL").select("row", "price").unionByName(left).groupBy("row").agg(F.sum("price").alias("price"))
