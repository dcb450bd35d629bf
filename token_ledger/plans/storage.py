"""Small files that the driver reads and writes beside the tables: pointers and marks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no folder."""
    fs, place = _place(spark, folder)
    if not fs.exists(place):
        return []
    return sorted(x.getPath().getName() for x in fs.listStatus(place))


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with its text visible at once, unless it is there already; whether it was made.

    Of several writers of one path exactly one makes it, if the file system's rename does not
    overwrite and is atomic (HDFS and its kind) or hard links are (local disks). Object stores
    without either need a lock of their own around commits.
    """
    fs, place = _place(spark, path)
    hidden = f".{uuid.uuid4().hex}"
    if fs.getUri().getScheme() == "file":
        target = fs.makeQualified(place).toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        source = os.path.join(os.path.dirname(target), hidden)
        with open(source, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(source, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
        return True
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(place.getParent(), hidden)
    stream = fs.create(source, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, place, how)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(source, False)
        return False
    return True
