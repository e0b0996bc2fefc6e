"""Bounded lexical search and the segmented index: equal results, work saved, changes without rebuilding."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docskein.operators import lexical
from docskein.plans import retrieval as rt
from docskein.plans.fixtures import Tables
from docskein.session import stored
from docskein.sources import termstore


@pytest.fixture(scope="module")
def small_pieces():
    patch = pytest.MonkeyPatch()
    patch.setattr(termstore, "PIECE", 150)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def chunks(tables):
    return tables.stored("chunk_meta")


@pytest.fixture(scope="module")
def index(small_pieces, chunks):
    return rt.index_corpus(chunks)


def ranked(df):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score, r.overlap) for r in df.collect())


def brute(index, queries, k, **how):
    from docskein.functions.ranking import top_k

    return ranked(top_k(lexical.bm25_scores(index, queries, **how), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k))


@pytest.mark.parametrize("how", [{}, {"positive": False}, {"positive": False, "all_terms": True}])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_equal_to_scoring_every_pair(index, tables, k, how):
    q = tables.stored("queries")
    short = q.select((F.col("query_id") + 10**9).alias("query_id"), F.array_join(F.slice(F.split("text", " "), -4, 3), " ").alias("text"))
    both = stored(q.select("query_id", "text").unionByName(short), "both")
    got, want = ranked(lexical.search(index, both, k, **how)), brute(index, both, k, **how)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 and a[4] == b[4] for a, b in zip(got, want, strict=True))


def test_few_pairs_are_scored(spark, monkeypatch):
    monkeypatch.setattr(termstore, "PIECE", 4096)
    t = Tables(spark, "/root/testdata/sf0.01")
    work = lexical.search(rt.index_corpus(t.stored("chunk_meta")), t.stored("queries"), 20, trace=True)
    done = work.agg(F.sum("scored").alias("scored"), F.sum("sharing").alias("sharing")).first()
    assert 0 < done.scored < 0.1 * done.sharing


def test_batches_of_questions_equal_one(spark, index, tables, monkeypatch):
    q = tables.stored("queries").select("query_id", "text", F.array(lexical.role_demand(F.col("user_roles"))).alias("must"))
    want = ranked(lexical.search(index, q, 5, must="must"))
    pieces = index.blocks(index.segments[0]).filter("kind = 2").count()
    monkeypatch.setattr(lexical, "VISITS", pieces * q.count() // 3)
    written = []
    monkeypatch.setattr(lexical, "stored", lambda df, name: written.append((name, df.count())) or stored(df, name))
    assert ranked(lexical.search(index, q, 5, must="must")) == want and want
    # no table of questions times pieces is kept, whatever the number of pieces
    assert sum(name == "first-pieces" for name, _ in written) >= 3 and pieces > 3
    assert max(n for _, n in written) <= 5 * q.count()


def test_pieces_grow_before_there_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(termstore, "PIECE", 10)
    cores = spark.sparkContext.defaultParallelism
    c = spark.range(10 * 4 * cores).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word"), F.col("id") % 50).alias("content"))
    assert lexical.index_chunks(c).segments[0].pieces == 2 * cores


def test_a_written_table_leaves_no_shuffle(spark):
    import time

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles())
                        if f.getName().startswith("shuffle_")}
    before = shuffles()
    assert stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted").count() == 7
    made = None
    for _ in range(50):  # files are removed in the background
        made = {f for f in shuffles() - before if f.endswith(".data")}
        if len(made) <= 1:  # the count above may have left one
            break
        time.sleep(0.2)
    assert len(made) <= 1


def test_postings_do_not_move(index, tables):
    held = index.blocks(index.segments[0]).filter("kind = 2").select("piece", "ids")
    asked = tables.stored("queries").select((F.col("query_id") % 3).alias("piece"), "text")
    df = held.groupBy("piece").cogroup(asked.groupBy("piece")).applyInArrow(lambda a, b: a.select(["piece"]), "piece long")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1


def test_changes_equal_a_rebuild(spark, small_pieces, chunks, tables, tmp_path):
    part = chunks.select("chunk_id", "doc_id", "chunk_index", "content", "access_roles", "repository", "department")
    old = part.filter("chunk_id % 5 <> 0")
    replaced = part.filter("chunk_id % 7 = 1 AND chunk_id % 5 <> 0").withColumn("content", F.concat("content", F.lit(" replaced by newer words")))
    new = part.filter("chunk_id % 5 = 0")
    gone = part.filter("chunk_id % 11 = 3")
    labels = rt.chunk_labels()
    first = rt.index_corpus(old, str(tmp_path / "index"))
    second = termstore.change_index(first, replaced.unionByName(new), labels=labels)
    third = termstore.change_index(second, gone=gone.select("chunk_id"))
    live = old.join(replaced.select("chunk_id"), "chunk_id", "left_anti").unionByName(replaced).unionByName(new).join(
        gone.select("chunk_id"), "chunk_id", "left_anti")
    whole = rt.index_corpus(stored(live, "live"))
    index = termstore.read_index(spark, str(tmp_path / "index"))
    assert index.generation == third.generation == 2 and index.n_chunks == whole.n_chunks and index.length == whole.length
    stats = lambda ix: sorted((r.term, r.df, round(r.idf, 9)) for r in ix.terms.collect())
    assert stats(index) == stats(whole)
    q = tables.stored("queries").select("query_id", "text", F.array(lexical.role_demand(F.col("user_roles"))).alias("must"))
    assert ranked(lexical.search(index, q, 10, must="must")) == ranked(lexical.search(whole, q, 10, must="must"))
    # an older generation is still what it was
    assert termstore.read_index(spark, str(tmp_path / "index"), 0).n_chunks == first.n_chunks
    # segments of one size class are merged from their live rows
    ids = sorted(r.chunk_id for r in new.select("chunk_id").collect())
    before = len(index.segments)
    for i in range(4):
        index = termstore.change_index(index, new.filter(F.col("chunk_id").isin(ids[5 * i:5 * i + 5])).withColumn(
            "content", F.concat("content", F.lit(f" again{i}"))), labels=labels)
    assert len(index.segments) <= before + 1
    rows = index.rows.groupBy("chunk_id").count()
    assert rows.filter("count > 1").count() == 0 and rows.count() == index.n_chunks


def test_empty_and_null(spark, small_pieces):
    c = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta"), (4, "alpha " * 5000)], "chunk_id long, content string")
    q = spark.createDataFrame([(1, None), (2, "alpha"), (3, "beta beta unknown")], "query_id long, text string")
    index = lexical.index_chunks(c)
    got = ranked(lexical.search(index, q, 5, positive=False))
    assert got == brute(index, q, 5, positive=False) and {x[0] for x in got} == {2, 3}
    assert lexical.search(lexical.index_chunks(c.limit(0)), q).count() == 0
    nobody = q.unionByName(spark.createDataFrame([(None, "alpha beta")], q.schema))
    assert all(ranked(lexical.search(index, nobody, 5, **how)) == ranked(lexical.search(index, q, 5, **how)) for how in (
        {}, {"positive": False, "all_terms": True}))
    gone = termstore.change_index(index, gone=c.select("chunk_id"))
    assert gone.n_chunks == 0 and gone.segments == [] and gone.rows.count() == 0


def test_names_of_a_piece_are_no_list_column(index):
    """A list column that all rows but one leave null took most of the time of loading a piece."""
    blocks = index.blocks(index.segments[0])
    assert dict(blocks.dtypes)["names"] == "binary"
    held = [n for r in blocks.filter(F.col("kind") == termstore.NAMES).select("names").collect()
            for n in termstore.unpacked_names(pa.scalar(bytes(r["names"]), pa.binary())).to_pylist()]
    assert sorted(held) == sorted(str(r["chunk_id"]) for r in index.rows.select("chunk_id").collect())


def test_all_terms_of_many_questions_at_once(spark, monkeypatch):
    """Stretches of a few candidates, dead chunks, labels and unknown terms: equal to one question after the other."""
    monkeypatch.setattr(lexical, "CANDIDATES", 3)
    texts = ["alpha beta gamma", "alpha beta", "beta gamma delta", "alpha gamma beta beta", "delta", "alpha delta beta"] * 4
    rows = spark.createDataFrame([(i, t, ["x", "y", None][i % 3]) for i, t in enumerate(texts)], "chunk_id long, content string, kind string")
    index = lexical.index_chunks(rows, labels=lexical.value_labels(kind=F.col("kind")))
    index = termstore.change_index(index, gone=spark.createDataFrame([(0,), (5,)], "chunk_id long"))
    asked = spark.createDataFrame([(1, "alpha beta", "x"), (2, "beta gamma", None), (3, "delta", "y"), (4, "alpha nowhere", None), (5, "delta gamma beta", "x"),
                                   (6, "alpha gamma", "z")], "query_id long, text string, kind string")
    due = asked.withColumn("must", F.transform(lexical.value_labels(kind=F.col("kind")), lambda x: F.array(x)))
    got = ranked(lexical.search(index, due, 4, must="must", positive=False, all_terms=True))
    monkeypatch.setattr(lexical, "_all_terms_searcher", lambda k, mean, positive: lexical._searcher(k, mean, positive, True, False))
    assert got == ranked(lexical.search(index, due, 4, must="must", positive=False, all_terms=True))
    assert {x[0] for x in got} == {1, 2, 3} and not {0, 5} & {x[2] for x in got}
    assert {x[2] for x in got if x[0] == 3} == {4, 10, 16, 22}


@pytest.mark.parametrize("n", [40, 3000])
def test_sums_bound_scores_and_equal_them_after(n):
    """Whole-number sums are never below a score and less than one a term above it; long, repeated and scoped questions as well."""
    import numpy as np

    from docskein.operators import impacts

    rng = np.random.default_rng(7)
    words = [np.append(rng.choice(60, rng.integers(1, 30), p=np.arange(60, 0, -1) / 1830), [] if i else np.arange(60)).astype(int) for i in range(n)]
    held = [sorted(set(w)) for w in words]
    ids = np.array([i for t in range(60) for i, h in enumerate(held) if t in h], dtype=np.int32)
    offsets = np.append(0, np.cumsum([sum(t in h for h in held) for t in range(60)])).astype(np.int32)
    tfs = np.array([int((words[i] == t).sum()) for t in range(60) for i in ids[offsets[t]:offsets[t + 1]]], dtype=np.int32)
    row = {"offsets": offsets, "ids": ids, "tfs": tfs, "lengths": np.array([len(w) for w in words], dtype=np.int32)}
    row = {c: pa.scalar(v.tobytes(), pa.binary()) for c, v in row.items()}
    row["names"] = pa.scalar(termstore._stream(pa.table({"name": [str(i) for i in range(n)]})), pa.binary())
    piece = impacts.Piece(row, ["3"], 15.0)
    idf = np.linspace(0.2, 9, 60)
    piece.weigh(np.arange(60), idf)
    for nos, times in (([5, 50, 9], [1, 1, 1]), ([0, 1, 59], [3, 1, 2]), (list(range(60)), [90] * 60)):
        nos, times = np.array(nos), np.array(times)
        by = np.argsort(~piece.often[nos], kind="stable")
        nos, times = nos[by], times[by]
        want = piece.add(np.zeros(n), nos, idf[nos] * times)
        cut, room = int(piece.often[nos].sum()), int((piece.peak[nos] * times).sum()) <= impacts.MOST
        sums = piece.sums(nos[:cut].tolist(), nos[cut:].tolist(), times.tolist(), room)
        over = sums - want * impacts.SCALE
        assert (over > -1e-6).all() and (over < times.sum()).all() and room == (times.sum() < 100)
        places = piece.reaching(sums, int(times.sum()), piece.alive, 0.0, 5)
        _, score, _ = piece.exact([places], [nos], [idf[nos] * times])
        assert 3 not in places and np.allclose(score, want[places], atol=1e-6)
        assert sorted(score)[-5:] == pytest.approx(sorted(want[piece.alive])[-5:], abs=1e-6)


def test_frequent_terms_and_pieces_beyond_the_first(spark, monkeypatch):
    """Terms of most chunks as rows, terms of negative weight, questions of one id, and several pieces to visit second."""
    from docskein.operators import impacts

    monkeypatch.setattr(termstore, "PIECE", 20)
    monkeypatch.setattr(impacts, "FEW", 1)
    c = spark.range(400).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.lit("every"), F.concat(F.lit("half"), F.col("id") % 2), F.concat(
        F.lit("some"), F.col("id") % 7), F.repeat(F.lit("more "), (F.col("id") % 5).cast("int")), F.concat(F.lit("rare"), F.floor(F.col("id") / 4))).alias("content"))
    index = lexical.index_chunks(c)
    q = spark.createDataFrame([(1, "every half1 some3"), (2, "half0 more more rare7"), (3, "some1 rare3 rare9"), (3, "some1 rare3 rare9"), (4, "rare3 rare3 some2")],
                              "query_id long, text string")
    for how in ({}, {"positive": False}):
        assert ranked(lexical.search(index, q.dropDuplicates(), 9, **how)) == brute(index, q.dropDuplicates(), 9, **how)
        got = ranked(lexical.search(index, q, 9, **how))  # an id that comes twice counts its terms twice
        assert [x[2] for x in got if x[0] == 3] == [x[2] for x in ranked(lexical.search(index, q.dropDuplicates(), 9, **how)) if x[0] == 3]


def test_a_segment_gives_back_its_chunks(spark, small_pieces):
    """Rows and postings come from the blocks: no list of terms is written."""
    c = spark.createDataFrame([(1, "beta alpha beta", ["x", "y"], 2), (2, None, None, 1), (3, "gamma", ["y"], 3)],
                              "chunk_id long, content string, kinds array<string>, copies int")
    index = lexical.index_chunks(c, copies="copies", labels=F.col("kinds"))
    rows = {r.chunk_id: (r.copies, r.dl, sorted(r.labels), [tuple(t) for t in r.terms], r.cluster) for r in index.rows.collect()}
    assert rows == {1: (2, 3, ["x", "y"], [("alpha", 1), ("beta", 2)], "1"), 2: (1, 0, [], [], "2"), 3: (3, 1, ["y"], [("gamma", 1)], "3")}
    assert sorted(map(tuple, index.postings.collect())) == [(1, "alpha", 1, 3), (1, "beta", 2, 3), (3, "gamma", 1, 1)]
    assert (index.n_chunks, index.length) == (6, 9)


def test_copies_that_differ_in_filters_are_one_entry(spark):
    """Filters hold for one ticket at a time, ties go to the smallest ticket that fits, and a text is indexed once."""
    from docskein.operators import tickets as tk

    said = ["printer jam", "jam printer", "printer fire"]
    kinds = [("open", "High", "HR"), ("done", "Low", "HR"), ("open", "Low", None), (None, "High", "IT")]
    rows = [(f"T{n:03d}", said[n % 3], None, None, *kinds[(n * 7 // 3) % 4]) for n in range(60)]
    t = spark.createDataFrame(rows, "ticket_id string, subject string, description string, resolution string, status string, priority string, category string")
    asked = [(1, "printer", "open", "High", None), (2, "jam", "open", None, None), (3, "printer jam", "done", "High", None), (4, "printer", None, None, None),
             (5, "fire", "open", "Low", "HR"), (6, "printer", None, "High", "IT"), (7, "jam", "nowhere", None, None)]
    q = spark.createDataFrame(asked, "query_id long, text string, status string, priority string, category string")
    want = {}
    for i, text, *due in asked:
        fits = [(r[0], r[1]) for r in rows if set(text.split()) <= set(r[1].split()) and all(d is None or d == x for d, x in zip(due, r[4:], strict=True))]
        want[i] = sorted(x for x, _ in fits)[:4]
    got = {}
    for r in sorted(tk.search(t, q, 4, True, tk.FILTERS).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.ticket_id)
    assert got == {i: x for i, x in want.items() if x} and set(got) == {1, 2, 4, 6}
    held = tk.index_tickets(t, q, tk.FILTERS)
    assert held.index.rows.count() == 3 and held.index.n_chunks == 60


def test_tickets_of_one_id_and_several_texts(spark):
    """The id of a ticket is no name of its text: only texts that hold the terms are found, and each is indexed once."""
    from docskein.operators import tickets as tk

    rows = [(f"T{n % 5}", f"word{n} common", None, None) for n in range(40)]
    t = spark.createDataFrame(rows, "ticket_id string, subject string, description string, resolution string")
    q = spark.createDataFrame([(n, f"common word{n}") for n in range(40)], "query_id long, text string")
    found = tk.search(t, q, 3)
    assert sorted((r.query_id, r.ticket_id) for r in found.collect()) == [(n, f"T{n % 5}") for n in range(40)]
    assert tk.index_tickets(t, q).index.n_chunks == 40


def test_similar_tickets_of_one_id_and_several_texts(spark):
    from docskein.operators import tickets as tk

    said = ["alpha beta gamma", "alpha beta gamma", "alpha beta delta", "alpha beta", "epsilon zeta", "zeta epsilon eta"]
    t = spark.createDataFrame([("T1", x, None, None) for x in said], "ticket_id string, subject string, description string, resolution string")
    assert sorted(r.similar_count for r in tk.similar_counts(t).collect()) == [1, 1, 3, 3, 3, 3]
