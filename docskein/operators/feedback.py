"""Learned chunk boosts: an ordered walk that is clamped after every event, so it is not a clamped sum.

The walk of one chunk could be arbitrarily long, so it is never gathered into one group. A step ``x -> clamp(x + d)``
is a function of the form ``x -> min(hi, max(lo, x + shift))``; such functions are closed under composition, which
lets each time slice of a chunk be folded to one small row, and the slices to one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER, UPPER = -0.05, 0.10
GAIN, LOSS = 0.02, -0.01


def _compose(first: Column, then: Column) -> Column:
    """The walk ``first`` followed by the walk ``then``, each a struct(shift, lo, hi)."""
    clamp = lambda v: F.greatest(then["lo"], F.least(then["hi"], v + then["shift"]))
    return F.struct(
        (first["shift"] + then["shift"]).alias("shift"),
        clamp(first["lo"]).alias("lo"),
        clamp(first["hi"]).alias("hi"),
    )


_WALK = "struct<shift:double,lo:double,hi:double>"


def _identity() -> Column:
    return F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))


def _fold(pieces: Column) -> Column:
    return F.aggregate(pieces, _identity().cast(_WALK), lambda acc, p: _compose(acc, p["walk"]).cast(_WALK))


GRAINS = ("second", "hour", "month")


def chunk_walks(feedback: DataFrame, grains: tuple[str, ...] = GRAINS) -> DataFrame:
    """(chunk_id, feedback_count, walk): all events of a chunk composed to one clamped step.

    Neutral ratings do not move the walk and are left out. Composition is associative, so events are folded per second,
    seconds per hour and so on: a group holds what one chunk gets in one second, or the slices of one grain, and never
    all events of a chunk that a third of all feedback cites.
    """
    keyed = feedback.filter(F.col("rating") != 0).select(
        F.posexplode("cited_chunk_ids").alias("pos", "chunk_id"), "created_at", "feedback_id",
        F.date_trunc(grains[0], "created_at").alias("slice"),
        F.when(F.col("rating") > 0, F.lit(GAIN)).otherwise(F.lit(LOSS)).alias("delta"),
    )
    step = F.struct(F.col("delta").alias("shift"), F.lit(LOWER).alias("lo"), F.lit(UPPER).alias("hi"))
    parts = keyed.groupBy("chunk_id", "slice").agg(
        F.count("*").alias("n"),
        _fold(F.array_sort(F.collect_list(F.struct("created_at", "feedback_id", "pos", step.alias("walk")))))
        .alias("walk"),
    )
    for grain in grains[1:]:
        parts = parts.groupBy("chunk_id", F.date_trunc(grain, "slice").alias("coarse")).agg(
            F.sum("n").alias("n"), _fold(F.array_sort(F.collect_list(F.struct("slice", "walk")))).alias("walk")).withColumnRenamed("coarse", "slice")
    return parts.groupBy("chunk_id").agg(
        F.sum("n").alias("feedback_count"),
        _fold(F.array_sort(F.collect_list(F.struct("slice", "walk")))).alias("walk"),
    )


def apply_walk(start: Column, walk: Column) -> Column:
    """Where the walk leads from ``start``."""
    return F.round(F.greatest(walk["lo"], F.least(walk["hi"], start + walk["shift"])), 6)


def chunk_boosts(feedback: DataFrame, grains: tuple[str, ...] = GRAINS) -> DataFrame:
    """Boost and event count per cited chunk."""
    return chunk_walks(feedback, grains).select(
        "chunk_id", apply_walk(F.lit(0.0), F.col("walk")).alias("boost_score"), "feedback_count")


def active_boosts(boosts: DataFrame, floor: float = 0.001) -> DataFrame:
    """Boosts large enough to matter."""
    return boosts.filter(F.abs("boost_score") > floor)


def join_boosts(chunks: DataFrame, boosts: DataFrame) -> DataFrame:
    """Attach the learned boost of each chunk, 0 without feedback."""
    b = active_boosts(boosts).select("chunk_id", F.col("boost_score").alias("feedback_boost"))
    return chunks.join(b, "chunk_id", "left").withColumn(
        "feedback_boost", F.coalesce(F.col("feedback_boost"), F.lit(0.0)))
