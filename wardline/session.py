"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "wardline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package relies on (UTC days, adaptive plans).

    Shuffle partitions are left to the cluster's own setting; adaptive execution merges
    small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one that ``spark.checkpoint.dir`` names.

    On a cluster that folder must be shared by all executors, so an unset one is an error
    there; a local session gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wardline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/wardline/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a plain columnar table: later scans prune columns, a lost executor
    costs nothing, and values that depend on the task layout are fixed once and for all.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly, for work that is heavy per row and would else follow the files.

    A file with one row group is one task with all its rows, whatever the scan's task count says. Adaptive
    execution picks the number of parts by their size.
    """
    return df.hint("rebalance")
