"""Sharding: the plain schedule by one heap, trees of cells, slots, defined cases."""

import heapq
import zlib

import pytest
from pyspark.sql import functions as F

from docskein.llm import sharding
from docskein.llm.ordinals import numbered


def plain(rows, shards):
    """Shard of each text by one walk over all groups."""
    groups = {}
    for doc_id, text in rows:
        t = (text or "").encode()
        g = groups.setdefault(t, [0, None])
        g[0] += len(t) + 1
        g[1] = doc_id if g[1] is None else min(g[1], doc_id)
    heap = [(0, s) for s in range(shards)]
    out = {}
    for t, (load, least) in sorted(groups.items(), key=lambda g: (-g[1][0], zlib.crc32(g[0]), g[1][1])):
        held, s = heap[0]
        out[t] = s
        heapq.heapreplace(heap, (held + load, s))
    return out


ROWS = [(i, "é" * (i * 37 % 101) + str(i % 150)) for i in range(400)] + [(1000 + i, "hot copy " * 9) for i in range(200)]


def test_equal_to_one_heap(docs_of):
    want = plain(ROWS, 16)
    got = sharding.sharded(docs_of(ROWS)).collect()
    texts = dict(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        t = texts[r.doc_id].encode()
        assert (r.shard, r.size, r.text_crc32) == (want[t], len(t) + 1, zlib.crc32(t))
    for s in range(16):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.doc_id)
        assert [r.slot for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize("cell_groups, bundles, fan", [(8, 64, 3), (40, 16, 16), (30, 12, 2)])
def test_trees_keep_groups_and_balance(docs_of, cell_groups, bundles, fan):
    got = sharding.sharded(docs_of(ROWS), 4, cell_groups, bundles, fan).collect()
    texts = dict(ROWS)
    where, load = {}, [0] * 4
    for r in got:
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
    # the hot group outweighs the mean and stands alone; the rest is even
    hot = where["hot copy " * 9]
    assert load[hot] == 200 * 82 and len(got) == len(ROWS)
    rest = [x for s, x in enumerate(load) if s != hot]
    assert max(rest) - min(rest) <= 2 * sum(rest) / bundles


def test_defined_cases(docs_of, spark):
    rows = [(1, None), (1, ""), (2, ""), (None, "a"), (3, "a"), (3, "a"), (4, "k " * 200_000)]
    d = docs_of(rows).withColumns({n: F.lit(n) for n in ("shard", "size", "hash", "load", "cell", "bin", "slot", "__n")})
    got = sharding.sharded(d, 3).collect()
    assert len(got) == 7 and sorted(r.size for r in got) == [1, 1, 1, 2, 2, 2, 400_001]
    assert len({r.shard for r in got if r.size == 1}) == 1 and len({r.shard for r in got if r.size == 2}) == 1
    last = [r for r in got if r.size == 2]
    assert max(last, key=lambda r: r.slot).doc_id is None
    assert sharding.sharded(d.limit(0)).count() == 0


def test_written_shards(docs_of, spark, tmp_path):
    d = docs_of(ROWS).withColumn("size", F.lit("x"))
    sharding.write_shards(d, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("__shard").columns == d.columns and back.count() == len(ROWS)
    assert back.groupBy("text").agg(F.count_distinct("__shard").alias("n")).filter("n > 1").count() == 0
    assert back.select("__shard").distinct().count() == 5


def test_numbers_of_ties_are_gapless(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 2).alias("g"), F.lit(1).alias("x"))
    got = numbered(rows, [F.col("x")], "place", within="g").collect()
    for g in (0, 1):
        assert sorted(r.place for r in got if r.g == g) == list(range(2500))
    assert sorted(r.place for r in numbered(rows, [F.col("x")], "place").collect()) == list(range(5000))
