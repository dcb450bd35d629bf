"""Where operators of this subpackage put intermediate tables.

Lineage is cut by writing Parquet to the shared folder in ``spark.checkpoint.dir``, so a
lost executor costs one task, not the table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the setting is unset and all runs in one process (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stage_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table written once in the shared folder."""
    spark = df.sparkSession
    path = stage_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of rows that Spark hands to a Python task at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that Python tasks get at once by bytes, so that very long texts do not add up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    scale = {"b": 0, "k": 10, "m": 20, "g": 30}
    size = int(now) if now.lstrip("-").isdigit() else int(now[:-1]) << scale[now[-1].lower()]
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
