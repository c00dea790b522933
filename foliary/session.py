"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "foliary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs in this package are written for.

    Sizes (shuffle partitions, memory) belong to the cluster and are not set here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliary-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name in the shared folder (not created yet)."""
    return f"{shared_folder(spark)}/foliary/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` once into the shared folder, in a folder per value of ``by``, and return the written table.

    Cuts the lineage so that a lost executor costs one re-read, and pins values
    that must not change between two uses (slice numbers, provider answers).
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label, *by))


def written(df: DataFrame, label: str, *by: str) -> str:
    """The folder that ``staged`` writes, for tables written piece by piece and read as one."""
    path = new_folder(df.sparkSession, label)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return path
