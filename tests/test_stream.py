"""Streams over several files equal their batch twins."""

import os

from pyspark.sql import functions as F

from docskein.operators import feedback as fb
from docskein.operators import metrics as m
from docskein.session import scratch_path
from docskein.streaming import streams as st


def feed(spark, df, cuts, order):
    """Write ``df`` as one file per range of ``order``, oldest first."""
    path = scratch_path(spark, "feed")
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(order) > lo)
        if hi is not None:
            part = part.filter(F.col(order) <= hi)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def play(spark, stream, mode, table, handler):
    st.run(stream, scratch_path(spark, "progress"), mode, handler).awaitTermination()
    return table.current()


def test_boosts_over_many_batches(spark, tables):
    log = tables.feedback
    cuts = [r[0] for r in log.selectExpr("explode(percentile(feedback_id, array(0.25, 0.5, 0.75))) c").collect()]
    path = feed(spark, log, cuts, "feedback_id")
    table = st.KeyedTable(spark, scratch_path(spark, "t"), ["chunk_id"])
    got = play(spark, st.read_files(spark, path, log.schema, per_trigger=1), "append", table, st.boost_batches(table))
    assert len(os.listdir(table.path.replace("file:", ""))) >= 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fb.chunk_boosts(log).collect()))


def test_replayed_batch_counts_once(spark, tables):
    table = st.KeyedTable(spark, scratch_path(spark, "t"), ["chunk_id"])
    handle = st.boost_batches(table)
    handle(tables.feedback, 0)
    once = sorted(map(tuple, table.current().collect()))
    handle(tables.feedback, 0)
    assert sorted(map(tuple, table.current().collect())) == once


def test_gap_counts_over_many_batches(spark, tables):
    log = tables.query_log
    path = feed(spark, log, [200, 600], "id")
    table = st.KeyedTable(spark, scratch_path(spark, "t"), ["query_hash"])
    got = play(spark, st.gap_counts(st.read_files(spark, path, log.schema, per_trigger=1)), "update", table, table.write_batch)
    want = {r["query_hash"]: r["frequency"] for r in m.gap_rollup(m.gap_detect(log)).collect()}
    assert {r["query_hash"]: r["frequency"] for r in got.collect()} == want


def test_late_rows_are_left_out_of_closed_days(spark):
    rows = [("2024-01-01 10:00:00", 0.5), ("2024-01-01 11:00:00", 0.7), ("2024-01-03 00:00:00", 0.1), ("2024-01-01 12:00:00", 0.9)]
    df = spark.createDataFrame(rows, "ts string, confidence double").withColumn("ts", F.to_timestamp("ts")).withColumn(
        "n", F.monotonically_increasing_id())
    path = scratch_path(spark, "late")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, confidence double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
        if i == 2:
            table = st.KeyedTable(spark, scratch_path(spark, "t"), ["day"])
            progress = scratch_path(spark, "p")
            src = st.read_files(spark, path, df.drop("n").schema)
            st.run(st.daily_counts(src), progress, "append", table.write_batch).awaitTermination()
    st.run(st.daily_counts(st.read_files(spark, path, df.drop("n").schema)), progress, "append", table.write_batch).awaitTermination()
    assert {r["day"]: r["queries"] for r in table.current().collect()} == {"2024-01-01": 2}
