"""Gapless numbers over a whole table in a given order, without one sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.session import stored

_WITHIN = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place inside its partition in the low 33 bits


def numbered(rows: DataFrame, order: list[Column], name: str, within: str | None = None) -> DataFrame:
    """``rows`` with ``name``: the place from 0 in ``order``, counted anew for each value of ``within`` if that is given.

    Rows are dealt by ranges of the order, so a task sorts only its range; the running sum goes over one row per
    partition. A stored row number ends the order, hence rows that tie in everything, be they a third of the table, are
    spread over several ranges, and a task that runs again meets the same numbers. ``within`` must not be null.
    """
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "rows-to-number")
    keys = ([F.col(within)] if within else []) + order + [F.col("__row")]
    ranged = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "__at", F.monotonically_increasing_id()).withColumns({
            "__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit(_WITHIN))}), "numbered-ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = ranged.join(stored(starts, "range-starts"), "__part").withColumn(name, F.col("__start") + F.col("__at"))
    if within:
        first = placed.groupBy(within).agg(F.min(name).alias("__first"))
        placed = placed.join(stored(first, "first-places"), within).withColumn(name, F.col(name) - F.col("__first"))
    return placed.drop("__part", "__start", "__at", "__first", "__row")
