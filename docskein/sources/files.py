"""File manifests, page tables and ticket CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.text import basename


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths, sizes and times below ``folder``; file contents are never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
            .select("path", "length", "modificationTime"))


def ingest_manifest(files: DataFrame, batch_id: str) -> DataFrame:
    """Accepted and rejected files of a batch; hidden files and archive metadata are left out."""
    name = basename(F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    ok = ext.isin(*fixed.SUPPORTED_EXTENSIONS)
    return files.filter((name != "") & ~name.startswith(".") & ~F.contains(F.col("path"), F.lit("__MACOSX"))).select(
        F.lit(batch_id).alias("batch_id"), name.alias("filename"), ext.alias("extension"),
        F.when(ok, "queued").otherwise("rejected").alias("status"),
        F.when(~ok, F.concat(F.lit("Unsupported file type: "), F.when(ext == "", "(none)").otherwise(ext))).alias("error"),
    )


def with_pages(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """Add ``pages``: the text split at ``separator``, numbered from 1."""
    return docs.withColumn("pages", F.transform(F.split("text", separator), lambda p, i: F.struct(
        (i + 1).alias("page_number"), p.alias("text"))))


def read_pages(docs: DataFrame) -> DataFrame:
    """One row per page of documents with a ``pages`` column."""
    return docs.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")


def _field(columns: list[str], field: str, default: str | None) -> Column:
    """Column of the first header alias present, trimmed; empty becomes ``default``."""
    by_name = {c.strip().lower(): c for c in columns}
    for alias in fixed.TICKET_HEADERS[field]:
        if alias in by_name:
            return F.coalesce(F.nullif(F.trim(F.col(f"`{by_name[alias]}`")), F.lit("")), F.lit(default))
    return F.lit(default).cast("string")


def tickets_from_rows(raw: DataFrame) -> DataFrame:
    """Map a header row of any known spelling to the ticket columns; rows without id or subject are dropped."""
    cols = {f: _field(raw.columns, f, {"priority": "Medium", "category": "General", "description": ""}.get(f))
            for f in fixed.TICKET_HEADERS}
    cols["ticket_id"] = cols.pop("id")
    out = raw.select(*[c.alias(n) for n, c in cols.items()])
    return out.filter(F.col("ticket_id").isNotNull() & F.col("subject").isNotNull())


def read_tickets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tickets from CSV files with quoted multi-line fields."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
           .csv(path))
    return tickets_from_rows(raw)
