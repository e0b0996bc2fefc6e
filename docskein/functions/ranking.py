"""Ranking helpers that every operator shares: each order ends in a unique key, so results never depend on placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round6(x: Column) -> Column:
    """Six decimals by scaling, inside generated code; for the many rows that are scored before ranking."""
    return F.floor(x * 1e6 + 0.5) / F.lit(1e6)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. A literal ``k`` lets Spark keep k rows per task and key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``."""
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def value_at_fraction(df: DataFrame, column: str, fractions: dict[str, float]) -> DataFrame:
    """``sorted(values)[floor(n·p)]`` for each named p, in one row; nulls are no values, and without values all are null.

    Every rank is bracketed by the mergeable summary behind ``percentile_approx``, then the rows below the bracket and on its
    lower edge are counted exactly; each pass leaves about a thousandth of the rows of the one before, so a few aggregations
    do. Rows are never sorted or gathered, whether the values are integers or doubles, and a few numbers a pass reach the driver.
    """
    values, v = df.select(F.col(column).alias("v")).filter("v IS NOT NULL"), F.col("v")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    rank = {name: min(int(n * p) + 1, n) for name, p in fractions.items()}
    found = dict.fromkeys(fractions, low)
    # name → lowest and highest value that the rank may have, rows below the lowest, rows between
    open_ = {name: (low, high, 0, n) for name in fractions if n and low != high}
    while open_:
        names = list(open_)
        near = values.agg(*[
            F.percentile_approx(F.when(v.between(lo, hi), v), [max((rank[m] - below) / inside - 5e-4, 0.0),
                                                              min((rank[m] - below) / inside + 5e-4, 1.0)], 10_000)
            for m, (lo, hi, below, inside) in open_.items()]).first()
        edges = dict(zip(names, near, strict=True))
        counted = values.agg(*[x for m in names for x in (
            F.count_if(v < edges[m][0]), F.count_if(v == edges[m][0]), F.count_if(v <= edges[m][1]), F.min(F.when(v > edges[m][0], v)))]).first()
        for i, m in enumerate(names):
            (lo, hi, below, _), (left, right) = open_.pop(m), edges[m]
            under, on, upto, following = counted[4 * i:4 * i + 4]
            if under < rank[m] <= under + on:
                found[m] = left
                continue
            if rank[m] <= under:  # outside the bracket, which the summary's bound excludes
                lo, hi, below, last = lo, left, below, under + on
            elif rank[m] <= upto:
                lo, hi, below, last = following, right, under + on, upto
            else:
                lo, below, last = following, under + on, n
            found[m] = lo
            if lo != hi:
                open_[m] = (lo, hi, below, last - below)
    kind = values.schema["v"].dataType
    return df.sparkSession.range(1).select(*[F.lit(found[m] if n else None).cast(kind).alias(m) for m in fractions])
