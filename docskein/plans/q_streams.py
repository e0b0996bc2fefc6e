"""Registered streaming queries: each runs its stream over the given table to the end and returns the stored result."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.plans.fixtures import view_sql
from docskein.plans.q_metrics import BOOSTS_CTE
from docskein.plans.registry import query, stamp
from docskein.session import scratch_path
from docskein.streaming import streams as st

_TS = "yyyy-MM-dd HH:mm:ss"


def _events(t):
    """The event table as a file stream."""
    return st.read_files(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)


def _as_view(t, name):
    """A fixture view computed on the event stream."""
    body = view_sql(name, "spark").replace("FROM events", "FROM {events}")
    return t.spark.sql(body, events=_events(t))


def _finish(t, df, mode, key, handler=None):
    table = st.KeyedTable(t.spark, scratch_path(t.spark, "stream-table"), key)
    q = st.run(df, scratch_path(t.spark, "stream-progress"), mode, (handler or (lambda tb: tb.write_batch))(table))
    q.awaitTermination()
    return table.current()


@query("stream_daily_queries", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS queries, round(avg(confidence), 6) AS avg_confidence FROM query_log
GROUP BY 1 HAVING max(ts)::DATE + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM query_log)""", "query_log")
def _(t):
    out = _finish(t, st.daily_counts(_as_view(t, "query_log")), "append", ["day"])
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("stream_rolling_kpis", """
WITH s AS (SELECT *, unnest(range(0, 7)) AS back FROM query_log), w AS (SELECT *, ts::DATE - back::INT AS from_day FROM s)
SELECT CAST(from_day AS VARCHAR) AS from_day, count(*) AS queries, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (WHERE low_confidence) AS low_confidence_count
FROM w WHERE from_day + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM query_log) GROUP BY from_day""", "query_log")
def _(t):
    # windows of seven days start on multiples of seven days since the epoch plus the slide, hence on every day
    out = _finish(t, st.rolling_kpis(_as_view(t, "query_log")), "append", ["from_day"])
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("stream_sessions", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
c AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS closed, count(*) AS events FROM s GROUP BY user_id, no)
SELECT user_id, {stamp('started')} AS started, {stamp('closed')} AS closed, events FROM c WHERE closed <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(t):
    out = _finish(t, st.user_sessions(_events(t)), "append", ["user_id", "started"])
    return out.select("user_id", F.date_format("started", _TS).alias("started"), F.date_format("closed", _TS).alias("closed"), "events")


@query("stream_gap_counts", f"""
SELECT md5(lower(trim(query_text))) AS query_hash, count(*) AS frequency, {stamp('max(ts)')} AS last_seen FROM query_log
WHERE intent <> 'SMALLTALK' AND (chunks_retrieved < 3 OR confidence < 0.30) GROUP BY 1""", "query_log")
def _(t):
    out = _finish(t, st.gap_counts(_as_view(t, "query_log")), "update", ["query_hash"])
    return out.withColumn("last_seen", F.date_format("last_seen", _TS))


@query("stream_chunk_boosts", f"WITH {BOOSTS_CTE} SELECT chunk_id, feedback_count, boost_score FROM boosts", "feedback")
def _(t):
    return _finish(t, _as_view(t, "feedback"), "append", ["chunk_id"], st.boost_batches)


@query("stream_ticket_upsert", """
SELECT ticket_id, coalesce(priority, 'Medium') AS priority, category, trim(subject) AS subject FROM tickets WHERE trim(subject) <> ''""", "tickets")
def _(t):
    path = scratch_path(t.spark, "ticket-feed")
    rows = t.tickets.select(F.col("ticket_id").alias("ID"), F.col("subject").alias("Title"), F.col("description").alias("Details"),
                            F.col("priority").alias("Severity"), F.col("category").alias("Type"))
    options = {"header": "true", "quoteAll": "true", "escape": '"'}
    rows.write.options(**options).csv(path)
    feed = st.read_files(t.spark, path, rows.schema, "csv", 2, header="true", multiLine="true", escape='"')
    return _finish(t, feed, "append", ["ticket_id"], st.ticket_batches).select("ticket_id", "priority", "category", "subject")
