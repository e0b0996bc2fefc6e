"""Inputs on which results were once wrong, and running from another folder."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from docskein.operators import context, dense, lexical, tickets
from docskein.plans import retrieval as rt
from docskein.sources import store
from docskein.streaming.streams import KeyedTable

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_changes_never_multiply_chunks(spark):
    chunks = spark.createDataFrame(
        [(1, 7, "a.pdf", "HR", "HR", "INTERNAL", ["X"]), (2, 8, "b.pdf", "IT", "IT", "INTERNAL", None), (3, 9, "b.pdf", "IT", "IT", "INTERNAL", None)],
        "chunk_id long, doc_id long, source_file string, repository string, department string, doc_origin string, access_roles array<string>")
    changes = spark.createDataFrame(
        [(7, "a.pdf", "Finance", None, None, 1), (7, "a.pdf", "Legal", None, None, 2), (100, "b.pdf", None, "EXTERNAL", None, 1), (101, "b.pdf", None, "PARTNER", None, 2)],
        "doc_id long, source_file string, repository string, doc_origin string, access_roles array<string>, v int")
    out = {r.chunk_id: r for r in store.update_doc_attributes(chunks, changes, ["v"]).collect()}
    assert len(out) == store.update_doc_attributes(chunks, changes).count() == 3
    assert out[1].repository == out[1].department == "Legal" and out[2].doc_origin == out[3].doc_origin == "PARTNER"


def test_terms_decide_on_a_ticket_match(spark):
    t = spark.createDataFrame([("T1", "vpn", "down", "printer", "open", "x", "Low"), ("T2", "mail", "down", "laptop", "open", "x", "Low")],
                              "ticket_id string, subject string, description string, resolution string, status string, category string, priority string")
    q = spark.createDataFrame([(1, "vpn"), (2, "down"), (3, "vpn down"), (4, "vpn mail")], "query_id long, text string")
    got = {}
    for r in tickets.search(t, q).collect():
        got.setdefault(r.query_id, set()).add(r.ticket_id)
    assert got == {1: {"T1"}, 2: {"T1", "T2"}, 3: {"T1"}}


def test_even_sample_of_gapped_positions(spark):
    c = spark.createDataFrame([(1, i, 10 + i) for i in (0, 2, 4)] + [(2, i, 100 + i) for i in range(0, 64, 2)],
                              "doc_id long, chunk_index long, chunk_id long")
    got = {}
    for r in context.even_sample(c, 8).collect():
        got.setdefault(r.doc_id, set()).add(r.chunk_id)
    assert got == {1: {10, 12, 14}, 2: {100 + 8 * i for i in range(8)}}


def test_no_level_shows_what_the_asker_may_not_see(spark):
    text = "reset the gateway password for the warehouse scanner"
    chunks = spark.createDataFrame(
        [(1, 1, 0, text, "IT", "IT", 1, ["ADMIN"]), (2, 1, 1, "gateway password policy overview", "IT", "IT", 1, None)] +
        [(10 + i, 5 + i, 0, f"other topic number{i} words", "HR", "HR", 3, None) for i in range(8)],
        "chunk_id long, doc_id long, chunk_index long, content string, repository string, department string, priority_tier int, access_roles array<string>")
    q = spark.createDataFrame([(1, text, [1], "IT", "IT", ["EMPLOYEE"]), (2, text, [1], "IT", "IT", ["ADMIN"])],
                              "query_id long, text string, scope_doc_ids array<long>, repo_hint string, dept_hint string, user_roles array<string>")
    rows = rt.level_results(rt.index_corpus(chunks), q, chunks).collect()
    assert {r.chunk_id for r in rows if r.query_id == 2} >= {1}
    assert 1 not in {r.chunk_id for r in rows if r.query_id == 1} and any(r.query_id == 1 for r in rows)
    hidden = chunks.filter("chunk_id = 1")
    assert {r.query_id for r in rt.scoped_documents(q, hidden).collect()} == {2}


def test_fallback_rows_of_a_document(spark):
    chunks = spark.createDataFrame([(i, 3, 2 * i, None) for i in range(20)], "chunk_id long, doc_id long, chunk_index long, access_roles array<string>")
    picked = spark.createDataFrame([(1, 0), (2, 4)], "query_id long, level int")
    scoped = spark.createDataFrame([(1, 3, 20), (2, 3, 20)], "query_id long, doc_id long, chunk_count long")
    rows = sorted((-r.final_score, r.chunk_key) for r in rt.document_fallback(picked, scoped, chunks).collect())
    assert rows[0] == (-0.99, "outline-3") and [k for _, k in rows[1:]] == [str(int(i * 2.5)) for i in range(8)]


def test_packing_takes_the_final_list(spark):
    rows = [(1, i, f"d{i}", 10, 2, 0.9 - i / 100) for i in range(8)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, doc_key string, token_count int, priority_tier int, final_score double")
    from docskein.operators import scoring

    low = df.withColumn("final_score", F.col("final_score") - 0.5)
    assert context.gather(scoring.select_final(df)).first()["items"][7]["chunk_id"] == 7
    assert context.gather(scoring.select_final(low)).first()["items"][-1]["final_score"] >= 0.38


def test_only_a_missing_table_is_empty(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v double").schema
    assert KeyedTable(spark, str(tmp_path / "none"), ["k"]).current(schema).count() == 0
    (tmp_path / "odd" / "batch=0").mkdir(parents=True)
    with pytest.raises(Exception):
        KeyedTable(spark, str(tmp_path / "odd"), ["k"]).current(schema)


def test_null_vectors_take_no_part(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.6, 0.8])], "id long, embedding array<float>")
    got = dense.dense_topk(d.withColumnRenamed("id", "query_id"), d.withColumnRenamed("id", "chunk_id"), 5).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(1, 1), (1, 3), (3, 1), (3, 3)}


def test_runs_from_another_folder(tmp_path):
    code = (f"import importlib.util as u; s = u.spec_from_file_location('entry', {REPO + '/__spark_entry__.py'!r}); m = u.module_from_spec(s);"
            "s.loader.exec_module(m); from docskein.session import build_session; b = build_session('x', '2');"
            "print('ROWS', m.queries()['dense_topk'](b, '/root/testdata/sf0.001').count())")
    out = subprocess.run(["timeout", "200", sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "ROWS" in out.stdout, out.stderr[-1500:]


def test_entry_without_optional_packages():
    code = ("import sys, warnings; sys.modules['tiktoken'] = None; sys.modules['public_tokenizers'] = None; warnings.simplefilter('ignore')\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search' in q and not any(n.startswith('op') for n in q)")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_citation_scores_round_half_up(spark):
    got = spark.createDataFrame([(0.69195,), (0.691949,), (0.38,), (1.00005,)], "s double").select(context.four_digits(F.col("s"))).collect()
    assert [r[0] for r in got] == [0.692, 0.6919, 0.38, 1.0001]


def test_similar_tickets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tickets, "CANDIDATES", 20)
    texts = [" ".join(f"word{(i * k) % 9}" for k in range(1, 7)) for i in range(24)] + ["", None, "the"]
    rows = [(f"T{i:03d}" if i != 5 else None, "", x, None) for i, x in enumerate(texts)]
    t = spark.createDataFrame(rows, "ticket_id string, subject string, description string, resolution string")
    sets = [(r[0], frozenset((r[2] or "").split()) - {"the"}) for r in rows]
    got = {r.ticket_id: r.similar_count for r in tickets.similar_counts(t.filter("ticket_id IS NOT NULL")).collect()}
    sets = [x for x in sets if x[0] is not None]
    assert got == {i: sum(1 for j, b in sets if i != j and a and b and 2 * len(a & b) >= len(a | b)) for i, a in sets}


def test_chunk_texts_are_written_in_bounded_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TASK_BYTES", 1 << 14)
    rows = [(i, b, "INTERNAL", "HR", None, 1, None, f"{i}-{b} " + "x" * 200) for i in range(600) for b in (1, 2)]
    rows += [(7, b, "INTERNAL", "HR", None, 1, None, f"7-{b}") for b in range(3, 400)]  # one chunk that changed very often
    chunks = spark.createDataFrame(rows, "chunk_id long, batch int, doc_origin string, repository string, department string, "
                                         "priority_tier int, access_roles array<string>, content string")
    path = str(tmp_path / "chunks")
    store.write_chunks(chunks, path, ["batch"])
    back = spark.read.parquet(path)
    got = {r.chunk_id: (r.batch, r.content.split(" ")[0]) for r in back.collect()}
    assert back.count() == 600 and got == {i: (399, "7-399") if i == 7 else (2, f"{i}-2") for i in range(600)}
    per_file = [r["n"] for r in back.groupBy(F.input_file_name()).agg(F.sum(F.octet_length("content")).alias("n")).collect()]
    assert len(per_file) > 8 and max(per_file) <= 2 << 14


def test_chunk_texts_are_cut_once(spark, tables):
    from docskein.operators import enrich

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(i, f"some words of chunk {i}") for i in range(50)], "chunk_id long, content string")
    out = enrich.hash_embed(rows.withColumn("content", counted.asNondeterministic()("content")))
    assert out.count() == len(out.collect()) == 50 and seen.value == 50
    assert tables.chunks._jdf.queryExecution().executedPlan().toString().count("split(") == 1


def test_pieces_keep_the_order_of_chunks():
    import numpy as np
    import pyarrow as pa

    from docskein.sources import termstore

    terms = pa.array([[("b", 2), ("c", 1)], [("a", 3)], [("a", 1), ("b", 1)]], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))
    rows = pa.table({"piece": pa.array([0] * 3, pa.int64()), "chunk_id": pa.array([9, 4, 7], pa.int64()), "copies": pa.array([1, 5, 2], pa.int64()),
                     "dl": pa.array([3, 30, 20], pa.int32()), "labels": pa.array([["x"], [], ["x"]], pa.list_(pa.string())), "terms": terms})
    got = termstore._piece_blocks((pa.scalar(0, pa.int64()),), rows).to_pylist()
    assert [(r["key"], r["df"], r["max_tf"], r["min_dl"]) for r in got[:-1]] == [
        ("a", 7, 3, 20), ("b", 3, 2, 3), ("c", 1, 1, 3), ("\u0001x", 3, 0, 3)]
    last = {c: np.frombuffer(got[-1][c], dtype=np.int32).tolist() for c in ("offsets", "ids", "tfs", "lengths")}
    assert last == {"offsets": [0, 2, 4, 5, 7], "ids": [0, 1, 1, 2, 2, 1, 2], "tfs": [3, 1, 1, 2, 1, 0, 0], "lengths": [30, 20, 3]}
    assert termstore.unpacked_names(pa.scalar(got[-1]["names"], pa.binary())).to_pylist() == ["4", "7", "9"]
