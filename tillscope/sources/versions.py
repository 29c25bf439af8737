"""Folders whose contents change as a whole: versions behind a list of them."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "versions"


def new_version(path: str) -> tuple[str, str]:
    """A name that sorts after those given earlier, and the folder for its files."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    return name, f"{path}/{name}"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[str]:
    """The versions of a folder, oldest first; none if it is an ordinary one or absent."""
    system, at = _files(spark, f"{path}/{_LIST}")
    if not system.exists(at):
        return []
    return [r["value"] for r in spark.read.text(f"{path}/{_LIST}").distinct().orderBy("value").collect()]


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _files(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a folder with all in it; False if there was none."""
    system, at = _files(spark, path)
    return system.delete(at, True)


def publish(spark: SparkSession, path: str, name: str) -> None:
    """From here on ``name`` is the version that is read. One line is added, so it happens or it does not."""
    spark.range(1).select(F.lit(name).alias("value")).coalesce(1).write.mode("append").text(f"{path}/{_LIST}")


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version published last; the folder itself if it has no versions."""
    listed = versions(spark, path)
    return f"{path}/{listed[-1]}" if listed else path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table as it is now. A reader keeps the version it began with."""
    return spark.read.parquet(current(spark, path))


def reload_table(df: DataFrame, path: str, partition_by: list[str] = (), keep: int = 2) -> None:
    """Replace the table at ``path``; ``df`` may have been read from it.

    The rows are written to a folder of their own, which is then published, so at every moment,
    and after a failure at any step, a reader finds the whole old table or the whole new one.
    The last ``keep`` versions stay, for readers that still are at an older one. A table
    written as an ordinary folder gets its first version beside its files, which then stay unread.
    """
    spark = df.sparkSession
    name, folder = new_version(path)
    df.write.partitionBy(*partition_by).parquet(folder)
    publish(spark, path, name)
    for old in versions(spark, path)[: -max(1, keep)]:
        delete(spark, f"{path}/{old}")
