"""Hand-worked cases and brute-force twins."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.text import tokens
from docskein.operators import chunking, classify, context, dense, feedback, lexical, pii, scoring, tickets, understand
from docskein.sources import files, store


def one(df):
    return df.collect()[0]


# ---------------------------------------------------------------- pseudonymisation
def test_pii_types_the_corpus_lacks(spark):
    text = "id EMP12345 pan ABCDE1234F ssn 123-45-6789 aadhaar 1234 5678 9012 mail A.b@X.com ip 10.2.3.4 card 4111 1111 1111 1111"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = one(pii.pseudonymise(df))
    assert [h["pii_type"] for h in row["pii_hits"]] == [
        "email", "employee_id", "pan_india", "ssn", "credit_card", "aadhaar", "ip_address"]
    for secret in ("EMP12345", "ABCDE1234F", "123-45-6789", "1234 5678 9012", "A.b@X.com", "10.2.3.4", "4111"):
        assert secret not in row["text"]


def test_pii_same_value_same_token_and_idempotent(spark):
    df = spark.createDataFrame([(1, "a@b.org and A@B.ORG wrote"), (2, "none"), (3, ""), (4, None)], "doc_id long, text string")
    once = pii.pseudonymise(df)
    rows = {r["doc_id"]: r for r in once.collect()}
    assert len({h["token"] for h in rows[1]["pii_hits"]}) == 1
    assert rows[2]["text"] == "none" and rows[3]["text"] == ""
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymise(once.drop("pii_hits")).collect()}
    assert again[1] == rows[1]["text"]


def test_technical_rows_keep_addresses(spark):
    df = spark.createDataFrame([(1, "host 10.0.0.1 mail a@b.org", True), (2, "host 10.0.0.1", False)], "doc_id long, text string, tech boolean")
    rows = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, skip=F.col("tech")).collect()}
    assert "10.0.0.1" in rows[1] and "a@b.org" not in rows[1] and "10.0.0.1" not in rows[2]


def test_model_spans(spark):
    df = spark.createDataFrame([(1, "Ada met Bob", [(1, 3, "person"), (9, 3, "person")])],
                               "doc_id long, text string, spans array<struct<start:int,length:int,type:string>>")
    row = one(pii.pseudonymise(df, spans="spans"))
    assert re.fullmatch(r"PERSON_HASH_\w{6} met PERSON_HASH_\w{6}", row["text"])
    assert [h["value"] for h in row["pii_hits"]] == ["Ada", "Bob"]


# ---------------------------------------------------------------- chunking
def greedy(ws, weights, limit, overlap):
    out, cur, used = [], [], 0
    for w, n in zip(ws, weights):
        if used + n > limit and cur:
            out.append(cur)
            tail, k = [], 0
            for v in reversed(cur):
                if k + v[1] > overlap:
                    break
                tail.insert(0, v)
                k += v[1]
            cur, used = tail, k
        cur = cur + [(w, n)]
        used += n
    return [" ".join(w for w, _ in c) for c in out + ([cur] if cur else [])]


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 37, 38, 39, 200])
def test_windows_equal_greedy(spark, n):
    ws = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(1, " ".join(ws))], "doc_id long, text string")
    got = [r["content"] for r in chunking.split_overlap(df, 20, 0.15).orderBy("chunk_index").collect()]
    assert got == greedy(ws, [1] * n, 20, 3)


def test_weighted_windows_equal_greedy(spark):
    rng = random.Random(3)
    for _ in range(5):
        n = rng.randint(1, 60)
        ws, ns = [f"w{i}" for i in range(n)], [rng.randint(1, 4) for _ in range(n)]
        df = spark.createDataFrame([(ws, ns)], "w array<string>, n array<int>")
        got = one(df.select(chunking.weighted_windows(F.col("w"), F.col("n"), 12, 3).alias("c")))["c"]
        assert got == greedy(ws, ns, 12, 3)


def test_section_path_example(spark):
    text = "intro\n1. Access\nbody a\n1.3 VPN\nbody b\n1.3.2 Reset\nbody c\n# Other\nbody d"
    df = spark.createDataFrame([(1, "VPN Runbook", text)], "doc_id long, title string, text string")
    got = [r["section_hierarchy"] for r in chunking.section_path(df).orderBy("section_no").collect()]
    assert got == [["VPN Runbook"], ["VPN Runbook", "1. Access"], ["VPN Runbook", "1. Access", "1.3 VPN"],
                   ["VPN Runbook", "1. Access", "1.3 VPN", "1.3.2 Reset"], ["VPN Runbook", "# Other"]]


def test_runbook_keeps_code_fences_whole(spark):
    text = "before\nStep 1 go\ntext\n```\nStep 2 inside code\n```\nStep 3 end\nlast"
    df = files.with_pages(spark.createDataFrame([(1, "T", text)], "doc_id long, title string, text string"))
    got = [r["content"] for r in chunking.chunk_runbook(df).orderBy("chunk_index").collect()]
    assert got == ["before", "Step 1 go\ntext\n```\nStep 2 inside code\n```", "Step 3 end\nlast"]


def test_find_page(spark):
    df = files.with_pages(spark.createDataFrame([(1, "first page here\nsecond page text\n\nshort")], "doc_id long, text string"))
    row = one(df.select(chunking.find_page(F.col("pages"), F.lit("x\nsecond page text")).alias("a"),
                        chunking.find_page(F.col("pages"), F.lit("nowhere to be found")).alias("b")))
    assert (row["a"], row["b"]) == (2, 0)


def test_classify_first_rule_wins(spark):
    df = spark.createDataFrame([("leave_policy.pdf",), ("xyz.pdf",)], "source_file string")
    rows = {r["source_file"]: r for r in classify.classify_l1(df).collect()}
    assert (rows["leave_policy.pdf"]["l1_department"], rows["leave_policy.pdf"]["l1_doc_type"]) == ("HR", "Policy")
    assert (rows["xyz.pdf"]["l1_department"], rows["xyz.pdf"]["l1_confidence"]) == ("Unknown", 0.70)


# ---------------------------------------------------------------- questions
def questions(spark, *texts):
    return understand.understand(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))


def test_intents(spark):
    cases = {"how many open tickets": "TICKET_ANALYTICS", "please open a ticket": "TICKET_LOOKUP",
             "escalate an issue please": "ESCALATE", "what about my open tickets": "TICKET_LOOKUP",
             "what about high priority and closed tickets": "TICKET_ANALYTICS", "hello there": "SMALLTALK",
             "summarise the plan": "SUMMARIZE", "zzz": "SEARCH"}
    rows = questions(spark, *cases).collect()
    assert {r["text"]: r["intent"] for r in rows} == cases


def test_decompose_and_expand(spark):
    rows = {r["text"]: r for r in questions(
        spark, "docker images versus kubernetes pods", "vpn access", "café menu").collect()}
    assert rows["docker images versus kubernetes pods"]["sub_queries"] == ["docker images", "kubernetes pods"]
    assert rows["vpn access"]["expanded"] == ["vpn access", "remote access", "virtual private network"]
    assert rows["café menu"]["cleaned"] == "café menu"


# ---------------------------------------------------------------- search
def brute_bm25(docs, query):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + .5) - math.log(c + .5) for w, c in df.items()}
    floor = .25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (.25 + .75 * len(d) / avg)) for w in query) for d in docs]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    # skewed vocabulary, and a third of the rows are one copied text
    rows = [" ".join(f"t{int(rng.paretovariate(.7))}" for _ in range(rng.randint(1, 30))) for _ in range(200)]
    rows += ["t1 t2 common words here t9"] * 100
    qs = ["t1 t2 t2", "t3 t40 t9", "common t7", "absent", "t5 t1 t11 t2"]
    return rows, qs, spark.createDataFrame(list(enumerate(rows)), "chunk_id long, content string").repartition(4), \
        spark.createDataFrame(list(enumerate(qs)), "query_id long, text string")


@pytest.mark.parametrize("k", [1, 3, 20])
def test_bm25_equals_formula(corpus, k):
    rows, qs, chunks, queries = corpus
    docs = [r.split() for r in rows]
    got = {}
    for r in lexical.search(lexical.index_chunks(chunks), queries, k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
    for i, q in enumerate(qs):
        scores = [math.floor(s * 1e6 + .5) / 1e6 for s in brute_bm25(docs, q.split())]
        want = sorted(((s, c) for c, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        assert [c for _, c, _ in sorted(got.get(i, []))] == [c for _, c in want]


def test_copies_score_as_if_listed(spark, corpus):
    rows, qs, chunks, queries = corpus
    full = {(r["query_id"], rows[r["chunk_id"]]): r["score"] for r in lexical.bm25_scores(lexical.index_chunks(chunks), queries).collect()}
    once = chunks.groupBy("content").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("copies"))
    got = {(r["query_id"], rows[r["chunk_id"]]): r["score"]
           for r in lexical.bm25_scores(lexical.index_chunks(once, copies="copies"), queries).collect()}
    assert got.keys() == full.keys() and all(abs(got[k] - full[k]) < 2e-6 for k in got)


def test_token_class_is_unicode(spark):
    df = spark.createDataFrame([("Naïve Café v1.2-b the x",)], "t string")
    assert one(df.select(tokens(F.col("t")).alias("w")))["w"] == ["naïve", "café", "v1.2-b"]


def test_dense_topk_equals_numpy_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    m[200:] = m[0]  # a third are copies
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "chunk_id long, embedding array<double>").repartition(5)
    q = df.filter("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(dense, "BLOCK_BYTES", 40 * 8 * 8 // 3)
    got = {}
    for r in dense.dense_topk(q, df, 7, exclude_self=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    s = np.round(m @ m.T, 6)
    for i in range(40):
        order = [j for j in np.lexsort((np.arange(300), -s[i])) if j != i][:7]
        assert [c for _, c in sorted(got[i])] == order


def test_rrf_boosts_tier_and_source(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    tiers = spark.createDataFrame([(10, 4), (11, 1)], "chunk_id long, priority_tier int")
    rows = {r["chunk_id"]: r for r in scoring.rrf_fuse([("dense", ranked), ("bm25", ranked)], tiers).collect()}
    assert rows[11]["rrf_score"] == pytest.approx(1.3 * 2.15 / 62, abs=1e-9) and rows[11]["sources"] == "dense+bm25"
    assert rows[10]["rrf_score"] == pytest.approx(.85 * 2.15 / 61, abs=1e-9)


# ---------------------------------------------------------------- context
def loop_pack(items, budget, slots, per_doc):
    used, out, docs = 0, [], {}
    for it in items:
        if len(out) >= slots:
            break
        if docs.get(it["doc_key"], 0) >= per_doc or used + it["token_count"] > budget:
            continue
        out.append(it)
        docs[it["doc_key"]] = docs.get(it["doc_key"], 0) + 1
        used += it["token_count"]
    return used, [x["chunk_id"] for x in out]


def test_pack_equals_loop_and_respects_budget(spark):
    rng = random.Random(5)
    rows = [(q, c, f"d{rng.randint(0, 4)}", rng.randint(10, 900), rng.randint(1, 4), round(rng.random(), 6))
            for q in range(20) for c in range(40)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, doc_key string, token_count int, priority_tier int, final_score double")
    got = {r["query_id"]: r for r in context.pack(context.gather(df), guarantee=False).collect()}
    for q in range(20):
        items = sorted((dict(zip(df.columns, r)) for r in rows if r[0] == q), key=lambda x: (-x["final_score"], x["chunk_id"]))
        used, ids = loop_pack(items, 4096, 8, 3)
        assert (got[q]["used_tokens"], [p["chunk_id"] for p in got[q]["picked"]]) == (used, ids) and used <= 4096


def test_tier1_swap(spark):
    rows = [(1, i, f"d{i}", 100, 2, 1 - i / 100) for i in range(8)] + [(1, 99, "d99", 100, 1, 0.4)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, doc_key string, token_count int, priority_tier int, final_score double")
    ids = [p["chunk_id"] for p in one(context.pack(context.gather(df)))["picked"]]
    assert ids == [0, 1, 2, 3, 4, 5, 6, 99]


# ---------------------------------------------------------------- feedback, tickets, stores
def test_boost_walk_equals_loop(spark):
    rng = random.Random(2)
    rows = [(i, f"2024-01-{1 + i // 60:02d} {i % 24:02d}:00:{rng.randint(0, 59):02d}", rng.choice([1, 1, -1, 0]), [i % 3, 7]) for i in range(600)]
    df = spark.createDataFrame(rows, "feedback_id long, created_at string, rating int, cited_chunk_ids array<long>").withColumn(
        "created_at", F.to_timestamp("created_at"))
    want = {}
    for i, ts, rating, ids in sorted(rows, key=lambda r: (r[1], r[0])):
        for c in ids if rating else []:
            b, n = want.get(c, (0.0, 0))
            want[c] = (max(-.05, min(.10, b + (.02 if rating > 0 else -.01))), n + 1)
    for r in feedback.chunk_boosts(df).collect():
        assert (r["boost_score"], r["feedback_count"]) == (pytest.approx(want[r["chunk_id"]][0], abs=1e-6), want[r["chunk_id"]][1])


def test_ticket_headers_and_defaults(spark):
    raw = spark.createDataFrame([(" 1 ", "s", None, "Done"), ("2", None, "d", ""), ("", "x", "y", "")], "`Ticket ID` string, Title string, Details string, State string")
    rows = files.tickets_from_rows(raw).collect()
    assert [(r["ticket_id"], r["priority"], r["category"], r["description"]) for r in rows] == [("1", "Medium", "General", "")]


def test_symptoms(spark):
    df = spark.createDataFrame([("Please help: VPN client crashes éab at login", )], "t string")
    assert one(df.select(tickets.symptoms(F.col("t")).alias("s")))["s"] == ["vpn", "client", "crashes", "login"]


def test_merge_and_ignore(spark):
    cur = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, n int")
    assert sorted((r["k"], r["v"]) for r in store.merge_upsert(cur, new, ["k"], ["n"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r["k"], r["v"]) for r in store.insert_ignore(cur, new, ["k"], ["n"]).collect()) == [(1, "a"), (2, "b"), (3, "e")]


def test_fixed_lists_have_no_repeats():
    assert len(set(fixed.STOP_WORDS)) == len(fixed.STOP_WORDS)


def test_value_at_fraction_is_exact(spark):
    import random

    from docskein.functions.ranking import value_at_fraction

    rng = random.Random(5)
    fractions = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99, "e": 1.0}
    for values in ([rng.gauss(0, 1) for _ in range(30_000)], [float(rng.randrange(3)) for _ in range(999)], [2.5], [1.0, 2.0]):
        df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
        got = one(value_at_fraction(df, "x", fractions)).asDict()
        assert got == {k: sorted(values)[min(int(len(values) * p), len(values) - 1)] for k, p in fractions.items()}
    none = one(value_at_fraction(spark.createDataFrame([], "x double"), "x", fractions))
    assert set(none.asDict().values()) == {None}
