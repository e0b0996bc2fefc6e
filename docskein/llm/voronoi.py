"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become integers floor(scale * x). Pivots, a bounded sample of the candidates, cut the space into cells; every
vector belongs to the cell of its nearest pivot. Cells are summarised by the distances of their closest vectors: of the
``k + 1`` closest ids, the ``k`` closest rows each. For a query q, a pivot p and a vector y at distance r from p,

    q·p - |q| r  <=  q·y  <=  q·p + |q| r.

From the left, the closest of each cell, without those of the query's own id, give it a floor under its k-th best score;
the pivots themselves, which are vectors of the table, raise it. From the right, a vector whose bound lies under the floor of every query of a group
cannot matter to it. Queries are grouped by cell, in blocks of bounded size; candidates are copied only to the groups
that may need them and meet their queries there. Groups are cut into bounded pieces of candidates by a hash, whatever
their cell, so a cell that holds a third of all rows is many tasks. Each piece returns its own best k per query, and the
final ranking merges pieces.

Integer products are exact: they are formed in doubles while all sums stay below 2**53, else in Python integers.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; neither do those without
an id. Vectors of different lengths do not meet. Ids that repeat are separate rows, and a query meets no row of its own id.
A query with fewer than ``k`` partners gets all of them. Scores beyond a long stand at its limit. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docskein.llm.base import batch, empty
from docskein.session import stored

SCALE = 1024
PIVOTS = 128
QUERIES_PER_BLOCK = 256
ROWS_PER_PIECE = 16_384
EXACT = 2.0**53
LIMIT = 2**63 - 1


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<double>): whole numbers floor(scale * x) of the usable vectors."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as doubles where they fit and as Python integers beyond."""
    top = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT:
        return a @ b.T
    whole = [[int(x) for x in row] for row in b]
    return np.array([[sum(int(p) * q for p, q in zip(row, other, strict=True)) for other in whole] for row in a], dtype=object).reshape(len(a), len(b))


def _assign(pivots: np.ndarray):
    """(cell, distance) of each row, nearest pivot first by number."""
    norms = (pivots ** 2).sum(axis=1)

    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = norms[None, :] - 2 * x @ pivots.T
        cell = d2.argmin(axis=1)
        return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))

    return of


def _cells(pivots: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("distance", pa.float64())])
    of = _assign(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                cell, distance = of(_matrix(rows.column(1)))
                yield batch(schema, rows.column(0), rows.column(1), cell, distance)

    return run


def _floors(pivots: np.ndarray, pivot_ids: np.ndarray, at: np.ndarray, near_ids: np.ndarray, distance: np.ndarray, k: int):
    """Each query's floor under its k-th best score, from the closest rows (cell, id, distance) and from the pivots."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("floor", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            q, ids = _matrix(rows.column(1)), rows.column(0).to_numpy()
            norm = np.sqrt((q ** 2).sum(axis=1))[:, None]
            dots = q @ pivots.T
            # rows of the query's own id are no partners, however many there are; likewise pivots of its id
            low = np.where(near_ids[None, :] == ids[:, None], -np.inf, dots[:, at] - norm * distance[None, :])
            floor = np.full(len(q), -np.inf)
            if low.shape[1] >= k:
                floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            real = np.where(pivot_ids[None, :] == ids[:, None], -np.inf, dots)
            if real.shape[1] >= k:
                floor = np.maximum(floor, np.partition(real, real.shape[1] - k, axis=1)[:, real.shape[1] - k])
            slack = 1e-9 * (np.abs(dots).max(axis=1, initial=0) + norm[:, 0] * max(1.0, float(distance.max(initial=0)))) + 1e-6
            yield batch(schema, rows.column(0), rows.column(1), rows.column(2), floor - slack)

    return run


def _copies(pivots: np.ndarray, groups: list[dict], pieces: int):
    """Copy each candidate to the groups in which it may be among a query's best."""
    schema = pa.schema([("task", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])
    # of a group: per cell, the largest admissible slack. y is needed when |y - p| >= (floor - q·p) / |q| for some q
    reach = np.array([g["reach"] for g in groups]).reshape(len(groups), len(pivots))
    number = np.array([g["group"] for g in groups], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, cell, distance = (rows.column(k).to_numpy() for k in (0, 2, 3))
            piece = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % pieces
            salted = (piece + np.arange(len(ids))) % pieces  # rows of one id spread too
            for a in range(0, len(ids), 512):
                need = distance[None, a:a + 512] >= reach[:, cell[a:a + 512]]
                g, i = np.nonzero(need)
                if len(i):
                    i = i + a
                    yield batch(schema, number[g] * pieces + salted[i], rows.column(0).take(pa.array(i)), rows.column(1).take(pa.array(i)))

    return run


def _reach(pivots: np.ndarray):
    """Per group of queries and cell: the least distance to the pivot at which a vector may matter."""
    schema = pa.schema([("group", pa.int64()), ("reach", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            q, floor, group = _matrix(rows.column(0)), rows.column(1).to_numpy(), rows.column(2).to_numpy()
            norm = np.maximum(np.sqrt((q ** 2).sum(axis=1)), 1e-12)
            need = (floor[:, None] - q @ pivots.T) / norm[:, None]
            names, where = np.unique(group, return_inverse=True)
            least = np.full((len(names), need.shape[1]), np.inf)
            np.minimum.at(least, where, need)
            yield batch(schema, names, least.tolist())

    return run


def _solve(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return schema.empty_table()
        q, ids, place = _matrix(queries.column("v")), queries.column("id").to_numpy(), queries.column("row").to_numpy()
        y, names = _matrix(rows.column("v")), rows.column("id").to_numpy()
        order = np.argsort(names, kind="stable")  # ties to the smaller id by stable sorting
        y, names = y[order], names[order]
        out = []
        for a in range(0, len(q), 32):
            score = products(q[a:a + 32], y)
            for r in range(len(score)):
                able = np.flatnonzero(names != ids[a + r])
                own = score[r][able]
                if own.dtype != object and len(own) > k:
                    cut = np.partition(own, len(own) - k)[len(own) - k]
                    able, own = able[own >= cut], own[own >= cut]
                best = sorted(range(len(own)), key=lambda i: (-own[i], names[able[i]]))[:k]
                out += [(int(ids[a + r]), int(place[a + r]), int(names[able[i]]), min(max(int(own[i]), -LIMIT), LIMIT)) for i in best]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _one_length(queries: DataFrame, rows: DataFrame, k: int, pivots: int) -> DataFrame:
    spark = rows.sparkSession
    result = "query_id long, query_row long, vec_id long, score long"
    total = rows.count()
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow()  # bounded
    if not chosen.num_rows:
        return empty(spark, result)
    points, point_ids = _matrix(chosen["v"]), chosen["id"].to_numpy()
    points, first = np.unique(points, axis=0, return_index=True)
    point_ids = point_ids[first]
    shape = "id long, v array<double>, cell int, distance double"
    placed = stored(rows.mapInArrow(_cells(points), shape), "cells")
    # of each cell the k + 1 closest ids and k rows of each: without any one id, the k closest rows are still among them
    ids = placed.groupBy("cell", "id").agg(F.min("distance").alias("nearest"))
    ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("nearest", "id"))).filter(F.col("place") <= k + 1)
    near = placed.join(ids.select("cell", "id"), ["cell", "id"]).select("cell", "id", "distance").withColumn(
        "place", F.row_number().over(Window.partitionBy("cell", "id").orderBy("distance"))).filter(F.col("place") <= k)
    # at most k + 1 ids and k rows of each a pivot
    near = near.select("cell", "id", "distance").toArrow()
    at, near_ids, distance = (near[c].to_numpy() for c in ("cell", "id", "distance"))
    asked = queries.mapInArrow(_cells(points), shape).select("id", "v", "cell").mapInArrow(
        _floors(points, point_ids, at, near_ids, distance, k), "id long, v array<double>, cell int, floor double")
    asked = stored(asked.withColumn("row", F.monotonically_increasing_id()), "queries")
    # queries of a cell in blocks of bounded size
    sizes = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = {c: -(-n // QUERIES_PER_BLOCK) for c, n in sizes.items()}
    begin, upto = {}, 0
    for c in sorted(blocks):
        begin[c], upto = upto, upto + blocks[c]
    if not blocks:
        return empty(spark, result)
    first_of, count_of = (F.create_map(*[F.lit(x) for c in blocks for x in (c, d[c])]) for d in (begin, blocks))
    asked = asked.withColumn("group", (first_of[F.col("cell")] + F.pmod(F.xxhash64("row"), count_of[F.col("cell")])).cast("long"))
    reach = asked.select("v", "floor", "group").mapInArrow(_reach(points), "`group` long, reach array<double>").select(
        "group", F.posexplode("reach").alias("cell", "r")).groupBy("group", "cell").agg(F.min("r").alias("r")).groupBy("group").agg(
        F.array_sort(F.collect_list(F.struct("cell", "r"))).alias("c")).select("group", F.col("c.r").alias("reach"))
    pieces = max(1, -(-total // ROWS_PER_PIECE))
    bounds = reach.toArrow().to_pylist()  # pivots numbers for each block of queries
    out = None
    # a bounded number of groups travels at once
    for at in range(0, len(bounds), 4096):
        part = bounds[at:at + 4096]
        copies = placed.mapInArrow(_copies(points, part, pieces), "task long, id long, v array<double>")
        mine = asked.select("id", "row", "v", "group").filter(F.col("group").between(
            min(g["group"] for g in part), max(g["group"] for g in part))) if len(bounds) > 4096 else asked.select("id", "row", "v", "group")
        spread = mine.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).select(
            (F.col("group") * pieces + F.col("piece")).alias("task"), "id", "row", "v")
        found = spread.groupBy("task").cogroup(copies.groupBy("task")).applyInArrow(_solve(k), result)
        out = found if out is None else out.unionByName(found)
    return out


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
          pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` of highest integer product with each query."""
    q, v = quantised(queries, key, vector, scale), stored(quantised(vectors, key, vector, scale), "vectors")
    found = None
    for (d,) in sorted(v.select(F.size("v")).distinct().collect()):
        one = _one_length(q.filter(F.size("v") == d), v.filter(F.size("v") == d), k, pivots)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = empty(vectors.sparkSession, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
