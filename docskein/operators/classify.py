"""Rule classification and small attribute mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.session import stored
from docskein.functions.ranking import latest


def _first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> tuple[Column, Column]:
    """(value of the first matching rule, whether one matched)."""
    value = None
    for pattern, name in rules:
        value = F.when(text.rlike(pattern), name) if value is None else value.when(text.rlike(pattern), name)
    return F.coalesce(value, F.lit(default)), value.isNotNull()


def classify_l1(docs: DataFrame, file_name: str = "source_file", folder: Column | None = None,
                department_rules=None, doc_type_rules=None) -> DataFrame:
    """Add department, doc_type and confidence from ordered patterns over file and folder name."""
    text = F.lower(F.concat_ws(" ", F.col(file_name), F.lit("") if folder is None else folder))
    dept, dept_hit = _first_rule(text, department_rules or fixed.DEPARTMENT_RULES, "Unknown")
    kind, kind_hit = _first_rule(text, doc_type_rules or fixed.DOC_TYPE_RULES, "Guide")
    conf = F.when(dept_hit & kind_hit, 0.95).when(dept_hit, 0.80).otherwise(0.70)
    return docs.select("*", dept.alias("l1_department"), kind.alias("l1_doc_type"), conf.alias("l1_confidence"))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def department_repository(department: Column, default: str = "External") -> Column:
    return _lookup(department, fixed.DEPARTMENT_REPOSITORY, default)


def category_department(category: Column) -> Column:
    return _lookup(category, fixed.CATEGORY_DEPARTMENT, "IT")


def priority_tier(origin: Column) -> Column:
    return F.when(origin == "INTERNAL", 1).otherwise(3)


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surviving document per checksum, report of copies with their survivor).

    Texts are read and hashed once, into a stored (doc_id, checksum) table. Only that is shuffled, pre-aggregated per
    task. Survivors are the corpus without the reported copies, so when the report is small it is broadcast and no text
    moves.
    """
    sums = stored(docs.select("doc_id", checksum(F.col("text")).alias("checksum")), "checksums")
    keep = sums.groupBy("checksum").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies"))
    report = sums.join(keep.filter("copies > 1"), "checksum").filter(F.col("doc_id") != F.col("keeper")).select(
        "doc_id", "keeper", "checksum")
    survivors = docs.join(report.select("doc_id"), "doc_id", "left_anti")
    return survivors, report


def nearest_centroid(vectors: DataFrame, labelled: DataFrame) -> DataFrame:
    """Label of the closest class centroid by cosine.

    Centroids are element-wise means; there is one small row per class, so they travel as one array column.
    """
    means = (labelled.select("label", F.posexplode("embedding").alias("i", "x"))
             .groupBy("label", "i").agg(F.avg("x").alias("m")))
    centroid = (means.groupBy("label")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")))
    table = centroid.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("_centroids"))

    def cosine(a: Column, b: Column) -> Column:
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, z: s + z))
        return dot / (norm(a) * norm(b))

    vec = F.col("embedding").cast("array<double>")
    # a scalar subquery: one small vector per class
    scored = vectors.withColumn("_centroids", table.scalar()).withColumn("_scores", F.transform("_centroids", lambda t: F.struct(
        F.round(cosine(vec, t["c"]), 6).alias("cosine"), (-t["label"]).alias("neg"))))
    best = F.array_max("_scores")
    return scored.withColumn("predicted", -best["neg"]).withColumn("cosine", best["cosine"]).drop(
        "_scores", "_centroids")


def stage_progress(log: DataFrame) -> DataFrame:
    """Latest stage of every job with its progress percentage, from a table of (job_id, batch_id, stage, ts, seq)."""
    pct = F.create_map(*[F.lit(x) for kv in fixed.STAGE_PROGRESS for x in kv])
    last = latest(log, ["job_id"], [F.desc("ts"), F.desc("seq")])
    return last.withColumn("progress", F.coalesce(F.try_element_at(pct, F.col("stage")), F.lit(0)))
