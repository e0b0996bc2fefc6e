"""Incremental forms of the logs and tables, as Structured Streaming jobs.

Results are kept as batches of changes under ``batch=<id>``: a repeated batch overwrites its own folder, so a job that
loses executors and replays a batch never counts it twice. Readers take the latest row per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from docskein.functions.ranking import latest
from docskein.operators import feedback as fb
from docskein.operators.metrics import gap_detect, gap_key
from docskein.sources.files import tickets_from_rows


class KeyedTable:
    """Rows by key, stored as idempotent batches of changes."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def current(self, schema: StructType | None = None, before: int | None = None) -> DataFrame:
        """Latest row per key, optionally only from batches older than ``before``."""
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException as e:
            # nothing written yet; any other fault must not restart the state
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        return latest(rows, self.key, [F.desc("batch")]).drop("batch")

    def compact(self, path: str) -> None:
        """Write the current rows as the first batch of a new table."""
        self.current().write.mode("overwrite").parquet(f"{path}/batch=0")


def read_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", per_trigger: int = 1000,
               **options: str) -> DataFrame:
    """File stream with an explicit schema and a bounded number of files per batch."""
    return (spark.readStream.schema(schema).options(**options).option("maxFilesPerTrigger", per_trigger)
            .format(fmt).load(path))


def run(df: DataFrame, checkpoint: str, mode: str, each_batch: Callable[[DataFrame, int], None],
        available_now: bool = True) -> StreamingQuery:
    """Start the job; ``available_now`` works off what is there and stops."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def _timed(df: DataFrame, delay: str) -> DataFrame:
    """Event time with a zone, as watermarks need, and the allowed lateness."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def daily_counts(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Queries per day; a day is emitted once the watermark has passed its end."""
    w = _timed(log, delay).groupBy(F.window("ts", "1 day"))
    return w.agg(F.count("*").alias("queries"), F.avg("confidence").alias("avg_confidence")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "queries", "avg_confidence")


def rolling_kpis(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Seven-day key figures, moving by a day."""
    w = _timed(log, delay).groupBy(F.window("ts", "7 days", "1 day"))
    return w.agg(F.count("*").alias("queries"), F.avg("confidence").alias("avg_confidence"),
                 F.count_if(F.col("low_confidence")).alias("low_confidence_count")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("from_day"), "queries", "avg_confidence", "low_confidence_count")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of activity per user, closed after ``gap`` without events."""
    w = _timed(events, delay).groupBy("user_id", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("events")).select(
        "user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("closed"), "events")


def gap_counts(log: DataFrame) -> DataFrame:
    """Running frequency per normalised question, in update mode."""
    return gap_detect(log).groupBy(gap_key(F.col("query_text")).alias("query_hash")).agg(
        F.count("*").alias("frequency"), F.max("ts").alias("last_seen"))


BOOST_SCHEMA = "chunk_id bigint, boost_score double, feedback_count bigint"


def boost_batches(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Batch handler that moves the learned boosts by the feedback of the batch.

    The events of a batch are composed per chunk in parallel; only the composed step meets the stored boost, so a chunk
    cited by most feedback is not a single-task state. Within a batch events apply in time order, late ones on arrival.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        steps = fb.chunk_walks(batch)
        schema = spark.createDataFrame([], BOOST_SCHEMA).schema
        old = table.current(schema, before=batch_id).select(
            "chunk_id", F.col("boost_score").alias("_b"), F.col("feedback_count").alias("_n"))
        moved = steps.join(old, "chunk_id", "left").select(
            "chunk_id", fb.apply_walk(F.coalesce("_b", F.lit(0.0)), F.col("walk")).alias("boost_score"),
            (F.col("feedback_count") + F.coalesce("_n", F.lit(0))).alias("feedback_count"))
        table.write_batch(moved, batch_id)

    return handle


def ticket_batches(table: KeyedTable, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch handler that upserts ticket rows by id; within a batch the highest ``order`` wins."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = tickets_from_rows(batch)
        by = [F.desc(order)] if order else [F.desc(c) for c in rows.columns if c != "ticket_id"]
        table.write_batch(latest(rows, ["ticket_id"], by), batch_id)

    return handle
