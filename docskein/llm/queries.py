"""Queries over the whole given tables, one per operator, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from docskein.llm import (bpe, chunks, divergence, mixer, mixing, packing, quality, resample, setjoin, sharding, simhash, sites,
                          voronoi)
from docskein.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(Inputs(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_simhash(t: Inputs) -> DataFrame:
    """Fingerprint and component of every document; no SQL twin, for DuckDB has no XXH64."""
    return simhash.near_duplicates(t.documents).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op6_token_counts(t: Inputs) -> DataFrame:
    """Tokens of every document under the word-end vocabulary."""
    found = bpe.token_counts(t.documents, public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [3, 1, 2], 1.5, 2.0


@query
def op5_mix_sources(t: Inputs) -> DataFrame:
    """Words taken of every document when sources weigh 3, 1, 2, … and share 150 % of all words."""
    return mixing.mixed(t.documents, MIX_WEIGHTS, MIX_SHARE, MIX_MOST).select(
        "doc_id", "size", "source_size", "target", "taken")


ORACLES["op5_mix_sources"] = r"""
WITH m AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>!]', '', 'g'))::BIGINT AS symbols FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][(place % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS room FROM p),
f AS (SELECT *, coalesce(sum(room) OVER before, 0) AS full_before, coalesce(sum(weight) OVER before, 0) AS weight_before,
  sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS weight_all FROM w
  WINDOW before AS (ORDER BY room / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - full_before) / (weight_all - weight_before) AS level FROM f),
z AS (SELECT arg_min(level, row(room / weight, place)) AS settled FROM l WHERE level * weight <= room),
g AS (SELECT source, source_size, coalesce(least(room, settled * weight), room) AS target FROM l, z),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
r AS (SELECT *, round(target - epochs * source_size)::BIGINT AS rest FROM e),
k AS (SELECT m.doc_id, m.size, r.source, r.source_size, r.target, r.epochs, r.rest,
  -ln((('0x' || substr(md5(coalesce(m.doc_id::VARCHAR, '') || '/mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
  / (1.0::DOUBLE / (1.0::DOUBLE + 4.0::DOUBLE * m.symbols / greatest(m.size, 1))) AS key
  FROM m JOIN r ON m.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM k)
SELECT doc_id, size, source_size, target,
 (epochs * size + CASE WHEN before < rest THEN least(size, rest - before) ELSE 0 END)::BIGINT AS taken FROM c"""


@query
def op9_quality_rules(t: Inputs) -> DataFrame:
    """Base measures and verdict of every document; the model learns from ``labels``."""
    return quality.assess(t.documents, quality.fit(t.documents, t.labels))


@query
def op3_pack_sequences(t: Inputs) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.packed_documents(t.documents, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_context_mixing(t: Inputs) -> DataFrame:
    """Unigram base score and context-mixing score of every document."""
    return mixer.score(t.documents, mixer.fit(t.documents))


@query
def op8_substring_dedup(t: Inputs) -> DataFrame:
    """Later occurrences of repeated passages, one row each, with the document that has them first."""
    return chunks.repeated_runs(t.documents)


@query
def op7_line_dedup(t: Inputs) -> DataFrame:
    """Lines of every document that match an earlier line, and the documents of those."""
    return setjoin.line_report(t.documents)


@query
def op4_site_quality(t: Inputs) -> DataFrame:
    """Probability of good quality of every document; its source is the host and its language the path below it."""
    return sites.posteriors(t.documents, t.labels, F.col("source"), F.col("lang"))


@query
def op2_voronoi_topk(t: Inputs) -> DataFrame:
    """Ten highest integer products of every hundredth vector with all others."""
    return voronoi.top_k(t.embeddings.filter(F.col("vec_id") % 100 == 0), t.embeddings)


ORACLES["op2_voronoi_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op11_shards(t: Inputs) -> DataFrame:
    """Shard and slot of every document; shards are near equal in bytes and equal texts stay together."""
    return sharding.sharded(t.documents, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_importance_resampling(t: Inputs) -> DataFrame:
    """A quarter of the documents, drawn towards the word pairs of ``benchmark``."""
    return resample.resampled(t.documents, t.benchmark).select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_source_divergence(t: Inputs) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that mark it."""
    return divergence.audit(t.documents)


# CRC-32 in SQL: the table of 256 by rule, then one step per byte
CRC_TABLE = """tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT) AS c FROM range(256) r(i)))"""


def duck_crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of an expression, with ``tab`` in scope."""
    digits = "'0123456789ABCDEF'"
    b = f"16 * (strpos({digits}, h[2 * k + 1]) - 1) + strpos({digits}, h[2 * k + 2]) - 1"
    return f"""(SELECT xor(list_reduce(list_transform(range(0, length(h) // 2), lambda k: ({b})::BIGINT),
  lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) FROM tab, (SELECT hex(encode({text})) AS h))"""


ORACLES["op11_shards"] = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
e AS (SELECT text, sum(size)::BIGINT AS load, min(doc_id) AS least FROM d GROUP BY text),
f AS (SELECT e.*, {duck_crc32("e.text")} AS text_crc32 FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY load DESC, text_crc32, least) AS i FROM f),
walk AS (SELECT 0::BIGINT AS i, list_transform(range(16), lambda x: 0::BIGINT) AS held, 0 AS shard
 UNION ALL SELECT g.i, list_transform(w.held, lambda x, j: CASE WHEN j = list_position(w.held, list_min(w.held)) THEN x + g.load ELSE x END),
  (list_position(w.held, list_min(w.held)) - 1)::INT FROM walk w JOIN g ON g.i = w.i + 1)
SELECT d.doc_id, d.size::BIGINT AS size, g.text_crc32, 'bytes' AS law, w.shard,
 row_number() OVER (PARTITION BY w.shard ORDER BY d.doc_id NULLS LAST, d.size, g.text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN g ON d.text = g.text JOIN walk w ON w.i = g.i"""

ORACLES["op12_importance_resampling"] = rf"""
WITH {CRC_TABLE},
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM bw),
u AS (SELECT f FROM f UNION SELECT f FROM bf),
c AS (SELECT u.f, {duck_crc32("u.f")} % 10000 AS bucket FROM u),
s AS (SELECT bucket, count(*) AS s FROM f JOIN c ON f.f = c.f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN c ON bf.f = c.f GROUP BY bucket),
g AS (SELECT b AS bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE)
 / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE)))::BIGINT AS gain
 FROM range(10000) x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN c ON f.f = c.f JOIN g ON g.bucket = c.bucket GROUP BY r),
p AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(m.n, 0)::BIGINT AS n_features,
 CASE WHEN m.n > 0 THEN (total - ((total % m.n) + m.n) % m.n) // m.n ELSE 0 END::BIGINT AS weight,
 ('0x' || substr(sha256('7:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m ON m.r = w.r),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM p),
k AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM q)
SELECT doc_id, n_features, weight, score,
 CASE WHEN place <= (SELECT count(*) FROM q WHERE n_words >= 20) * 25 // 100 THEN place END::BIGINT AS rank FROM k"""

ORACLES["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM k GROUP BY lang),
g AS (SELECT x.lang, source, x.term, count(*) AS c FROM x JOIN k ON x.lang = k.lang AND x.term = k.term GROUP BY ALL),
n AS (SELECT s.lang, s.source, coalesce(sum(c), 0)::BIGINT AS n FROM s LEFT JOIN g ON s.lang = g.lang AND s.source = g.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(g.c, 0) AS c,
 (1 + 1000000000::HUGEINT * (coalesce(g.c, 0) + 1) // (n.n + v.v))::BIGINT AS p,
 (1 + 1000000000::HUGEINT * (k.c + 1) // (v.n + v.v))::BIGINT AS q
 FROM n JOIN k ON n.lang = k.lang JOIN v ON v.lang = n.lang LEFT JOIN g ON g.lang = n.lang AND g.source = n.source AND g.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C")::INT AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
