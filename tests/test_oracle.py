"""Registered queries against DuckDB on the smallest scale; `check_oracle.py` runs all of them on a larger one."""

import re

import pytest
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = """dashboard_overall repo_usage eval_precision_recall eval_latency eval_simple gap_rollup chunk_boosts role_union
faq_votes latest_draft repo_documents document_list document_detail repo_stats access_requests audit_page session_list
active_scope rbac_filter scope_filter visible_repos payload_filter ingest_manifest merge_upsert insert_ignore
update_doc_attributes classify_l1 exact_dedup section_path chunk_hierarchy chunk_runbook chunk_router split_overlap
page_number four_views pii_tokenise pii_vault intent_signals route_repositories decompose_query dense_topk dual_pass
rrf_fuse tokenise bm25_search final_score context_pack tier1_guarantee cascade even_sample ticket_status ticket_fts
known_issue ticket_fallback scope_escape low_conf_retry entity_boost embed_once hash_embed known_issue_similar min_score_pass
citations ticket_count stream_gap_counts stream_chunk_boosts""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def registered():
    from __spark_entry__ import oracle_sql, queries

    return queries(), oracle_sql()


@pytest.mark.parametrize("name", QUICK)
def test_equal_to_duckdb(spark, con, registered, name):
    queries, sqls = registered
    assert compare(queries[name](spark, SF), con, sqls[name]) is None


def test_registry_is_complete(registered):
    queries, sqls = registered
    assert set(sqls) <= set(queries)
    own = {n for n in queries if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(sqls) == {"dense_ann"}


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0 and "context_text" in df.columns
