"""Shared pieces of the operators: narrow inputs, stored steps, connected components, joins that accept null keys."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.session import stored


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Give a task's free memory back to the system when it ends: idle workers stay alive for a minute and would keep it."""
    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return tidied


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                                       for c, f in zip(columns, schema, strict=True)], schema=schema)


def same(left: str, right: str) -> Column:
    """Equality under which two nulls agree; Spark uses it as a join key."""
    return F.col(left).eqNullSafe(F.col(right))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: the smallest node that it is connected to.

    Large-star and small-star steps alternate. The minimum per node is aggregated before the shuffle and joined back, so
    the neighbours of a node of any degree are never gathered. Each round is a written table, so a lost executor costs
    one round. Rounds grow with the logarithm of the longest path.
    """
    edges = stored(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: every neighbour above a node moves to the smallest one around that node
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter(F.col("a") != F.col("b")).distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            down.select("a", F.col("m").alias("b")))
        edges = stored(moved.filter(F.col("a") != F.col("b")).distinct(), "edges")
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
