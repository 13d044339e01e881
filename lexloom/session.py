"""Session defaults and the scratch location shared by jobs that need one."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "lexloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with UTC time and adaptive execution; sizing is left to the cluster."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return ship_package(b.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that their workers import it."""
    sc = spark.sparkContext
    if getattr(sc, "_lexloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "lexloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"lexloom/{f.relative_to(root)}")
    sc.addPyFile(archive)
    sc._lexloom_shipped = True
    return spark


def scratch_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is unset, a session on one machine (master ``local[...]``)
    gets a folder below its warehouse; on a cluster that is an error, since
    executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared scratch location."""
    return f"{scratch_base(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df):
    """Give every task slot a share of a small table.

    A scan with fewer splits than slots is bounded by slots × split size, so the
    exchange is cheap; larger scans are left as they are.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def materialise(df, label: str):
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage at a place that survives the loss of executors, and lets
    several consumers share one evaluation.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
