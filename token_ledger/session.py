"""Session settings that the operators count on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Tasks that list the paths of a batch; the default of 10,000 makes one for each few of many small files.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "96",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pins the zone to UTC and turns on runtime re-planning and partition-wise overwrites."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def can_stage(spark: SparkSession) -> bool:
    """Whether there is a place for shared folders."""
    return bool(spark.conf.get("spark.checkpoint.dir", None)) or spark.sparkContext.master.startswith("local[")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, under ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not can_stage(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="ledger-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back, for what several branches read."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
