"""Site quality: held-out accuracy, shrinkage by hand, defined cases."""

import pytest
from pyspark.sql import functions as F

from docskein.llm import sites


def test_labels_it_has_not_seen(spark):
    from docskein.llm.queries import Inputs

    t = Inputs(spark, "/root/testdata/sf0.01")
    half = t.labels.filter("doc_id % 2 = 0")
    out = {r.doc_id: r for r in sites.posteriors(t.documents, half, F.col("source"), F.col("lang")).collect()}
    assert len(out) == t.documents.count()
    rest = [(r.doc_id, r.quality) for r in t.labels.filter("doc_id % 2 = 1").collect()]
    right = sum(out[i].kept == bool(q) for i, q in rest) / len(rest)
    clean = [out[i].kept for i, q in rest if q == 1]
    assert right >= 0.95 and sum(clean) / len(clean) >= 0.97


def test_sparse_sites_shrink(docs_of, spark):
    """Without evidence the probability is the site's, and a site of one document stands near the whole."""
    rows = [(i, None, "good") for i in range(60)] + [(100 + i, None, "bad") for i in range(60)] + [(300, None, "one")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    d = docs_of(rows)
    out = {r.host: r for r in sites.posteriors(d, labels, F.col("source"), F.col("lang")).collect()}
    assert out["good"].path_quality > 0.9 and out["bad"].path_quality < 0.1
    assert abs(out["one"].host_quality - 0.5) < 0.05
    assert out["good"].kept and not out["bad"].kept


def test_defined_cases(docs_of, inputs):
    d = docs_of([(1, None, None), (2, "", "a"), (2, "abc", "a"), (None, "x y " * 30_000, "b"), (3, "plain words here", None)])
    out = sites.posteriors(d, inputs.labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(out) == 5 and all(r.kept and r.probability == pytest.approx(0.5, abs=0.01) for r in out)
    out = sites.posteriors(d, inputs.labels, F.col("source"), F.col("lang")).collect()
    assert len(out) == 5
    assert sites.posteriors(d.limit(0), inputs.labels, F.col("source"), F.col("lang")).count() == 0
