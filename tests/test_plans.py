"""Shape of the physical plans."""

from pyspark.sql import functions as F

from docskein.operators import chunking, lexical, metrics, pii
from docskein.plans.q_ingest import documents_with_pages


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_per_document_work_does_not_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (chunking.split_overlap(docs), pii.pseudonymise(docs.select("doc_id", "text"))):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text


def test_router_is_one_narrow_stage(tables):
    text = plan(chunking.chunk_router(documents_with_pages(tables)))
    assert "hashpartitioning" not in text and "Python" not in text


def test_pii_expression_stays_linear(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    red = pii.pseudonymise(docs).filter(F.size("pii_hits") > 0)
    assert len(plan(red)) < 200_000


def test_ranking_prunes_before_the_shuffle(tables):
    assert plan(metrics.recent_queries(tables.query_log)).count("WindowGroupLimit") == 2


def test_lookback_reaches_the_scan(tables):
    text = plan(metrics.lookback(tables.events, "2024-01-31 00:00:00", 7))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in text


def test_bounds_are_met_without_reading_postings(tables):
    index = lexical.index_chunks(tables.stored("chunks"))
    wanted = lexical._asked(index, tables.queries, "text", None)
    text = plan(lexical._visits(index, index.segments[0], wanted, False))
    assert "ids:binary" not in text and "max_tf" in text
