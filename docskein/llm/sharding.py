"""Shards of near equal size whose groups stay whole, by longest-processing-time scheduling.

A group is all documents of one text. Groups, largest first, go to the shard that holds least so far, which a heap
names; ties go to the smaller shard number. That walk is sequential, so beyond ``CELL_GROUPS`` groups it is done as a
tree: groups are dealt over cells by hash, every cell schedules its own groups into ``BUNDLES`` bundles, bundles of ``FAN``
cells are scheduled into as many again, and the last round schedules into the shards. No heap sees more than
``CELL_GROUPS`` groups (in the mean) or ``FAN × BUNDLES`` bundles, whatever the corpus, and a group that outweighs the
bundles of its cell stays a bundle of its own.

Loads of two shards differ at most by the last thing given to the fuller one, hence by one group up to ``CELL_GROUPS``
groups and by about 1 / (cells × BUNDLES) of the corpus beyond, unless a single group
outweighs the mean: such a group has a shard to itself and the others share the rest evenly, since groups are not cut.

Defined cases: a null text counts as the empty one; a document weighs its UTF-8 bytes plus 1. Rows that repeat (id, text
or both) are rows of their own. Null ids come last among the slots of a shard. An empty table gives an empty result.
Texts are told apart by a 64-bit hash, their CRC-32 and their length.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.ordinals import numbered
from docskein.session import ship, stored

CELL_GROUPS, BUNDLES, FAN = 65_536, 4096, 16
KEY = ["hash", "text_crc32", "size"]


def schedule(loads: np.ndarray, bins: int) -> np.ndarray:
    """Bin of every load, given in descending order: the least-loaded bin takes the next."""
    heap = [(0, b) for b in range(bins)]
    out = np.empty(len(loads), dtype=np.int32)
    for i, load in enumerate(loads.tolist()):
        held, b = heap[0]
        out[i] = b
        heapq.heapreplace(heap, (held + load, b))
    return out


def _scheduler(bins: int, order: list[tuple[str, str]]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("load", "descending"), *order])
        return table.append_column("bin", pa.array(schedule(table.column("load").to_numpy(), bins)))

    return run


def text_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with hash, text_crc32 and size of the text, named after no column of ``docs``."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(*[docs[c] for c in docs.columns], F.struct(
        F.xxhash64(text).alias("hash"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.octet_length(text).cast("long") + 1).alias("size")).alias("__key"))


def group_shards(keyed: DataFrame, shards: int, cell_groups: int = CELL_GROUPS, bundles: int = BUNDLES, fan: int = FAN) -> DataFrame:
    """(hash, text_crc32, size, shard) of every distinct text of ``keyed(hash, text_crc32, size, doc_id)``."""
    ship(keyed.sparkSession)
    # copies are summed before the shuffle; the smallest id breaks ties, so reruns agree
    groups = stored(keyed.groupBy(*KEY).agg(F.sum("size").alias("load"), F.min("doc_id").alias("least")), "groups")
    cells = max(-(-groups.count() // cell_groups), 1)
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("hash", "text_crc32"), F.lit(cells)))
    ties = [("text_crc32", "ascending"), ("least", "ascending"), ("hash", "ascending")]
    placed = stored(dealt.groupBy("cell").applyInArrow(
        _scheduler(bundles if cells > 1 else shards, ties),
        "hash long, text_crc32 long, size long, load long, least long, cell long, bin int"), "groups-in-cells")
    if cells == 1:
        return placed.select(*KEY, F.col("bin").alias("shard"))
    steps, rows = [], placed
    while cells > 1:
        cells = -(-cells // fan)
        up = rows.groupBy("cell", "bin").agg(F.sum("load").alias("load")).select(
            F.col("cell").alias("child"), F.col("bin").alias("part"), "load", F.floor(F.col("cell") / fan).alias("cell"))
        rows = stored(up.groupBy("cell").applyInArrow(
            _scheduler(bundles if cells > 1 else shards, [("child", "ascending"), ("part", "ascending")]),
            "child long, part int, load long, cell long, bin int"), "bundles")
        steps.append(rows)
    # from the top down: where the bundles of each round end
    ends = None
    for step in reversed(steps):
        step = step.select(F.col("child").alias("_child"), F.col("part").alias("_part"), "cell", "bin")
        if ends is None:
            ends = step.withColumn("shard", F.col("bin"))
        else:
            ends = step.join(ends, (F.col("cell") == F.col("up_cell")) & (F.col("bin") == F.col("up_bin")))
        ends = stored(ends.select(F.col("_child").alias("up_cell"), F.col("_part").alias("up_bin"), "shard"), "bundle-shards")
    return placed.join(ends, (F.col("cell") == F.col("up_cell")) & (F.col("bin") == F.col("up_bin"))).select(*KEY, "shard")


def sharded(docs: DataFrame, shards: int = 16, cell_groups: int = CELL_GROUPS, bundles: int = BUNDLES, fan: int = FAN) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document; slots follow the ids, from 0 in each shard."""
    keyed = stored(text_keys(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "__key.*"), "text-keys")
    # copies of one text may be a third of the left side; adaptive execution cuts that partition, as nothing here depends on it
    rows = keyed.join(group_shards(keyed, shards, cell_groups, bundles, fan), KEY).select("doc_id", "size", "text_crc32", "shard")
    return numbered(rows, [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")], "slot", within="shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """``docs`` below ``path``, one folder ``__shard=n`` per shard; a folder may hold several files."""
    keyed = text_keys(docs)
    found = group_shards(stored(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "__key.*"), "text-keys"), shards)
    where = found.select(F.struct(*KEY).alias("__group"), F.col("shard").alias("__shard"))
    keyed.join(where, F.col("__key") == F.col("__group")).drop("__key", "__group").write.partitionBy("__shard").parquet(path)
