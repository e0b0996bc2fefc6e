"""Session settings, the archive for workers, and lineage cutting."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docskein", cpus: str | int = "*") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the submitted session instead."""
    shared = os.environ.get("DOCSKEIN_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="docskein-shared-")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so that it need not be installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_docskein_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    # Spark's own file server hands it out, so a folder of the driver is enough
    path = os.path.join(tempfile.mkdtemp(prefix="docskein-archive-"), "docskein.zip")
    with open(path, "wb") as f:
        f.write(content.getvalue())
    sc.addPyFile(path)
    sc._docskein_shipped = True


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names in ``spark.checkpoint.dir``.

    A local master that names none shares the driver's disk anyway and gets a folder there; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        named = tempfile.mkdtemp(prefix="docskein-shared-")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(named)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder, for tables that one job writes and another reads."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the statements run inside go when a statement ends, not when the driver next collects garbage.

    For tables that are written: what made them is not read again, and a plan of many of them would keep every shuffle.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    For tables read several times by column, and for small ones whose size should steer join planning. Texts that are kept
    for a whole query take about half the disk as ``zstd``.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage, for results that several later steps read."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
