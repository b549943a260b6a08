"""Session settings and the shared scratch area."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that the driver and all executors see."""


def build_session(app: str = "keepwell", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """All day boundaries and zone-less timestamps are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local master, whose driver and tasks are one process, uses a folder of its own;
    a cluster is an error, as its executors don't see each other's disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.local.dir', '/tmp').rstrip('/')}/keepwell-{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written yet."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage in a way that survives lost executors, makes ids generated in
    the plan final, and gives the optimizer true sizes, so that it broadcasts
    the result only where it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
