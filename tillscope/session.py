"""Session settings the package relies on, and the shared folder for staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings that change results or protect against skew; other sizes than below stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: The most that a task reads of files or of a shuffle, for its hash maps and sorts hold about ten times as much; less stays.
TASK_SIZES = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}

_local_dirs: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, most in TASK_SIZES.items():
        if _bytes(spark.conf.get(key)) > _bytes(most):
            spark.conf.set(key, most)
    return spark


def _bytes(size: str) -> int:
    """A size as Spark writes it: digits, or digits and a unit."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", "local")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only on a local master.

    On a cluster a ``file:`` folder is refused, for each machine has its own; a mount that all
    share is allowed by ``spark.tillscope.sharedMount=true``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.conf.get("spark.master", "local").startswith("local")
    if named:
        if not local and named.startswith("file:") and spark.conf.get("spark.tillscope.sharedMount", "false") != "true":
            raise RuntimeError(f"{named} is a folder of one machine; name one every executor can reach")
        return named.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = app_id(spark)
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tillscope-")
    return _local_dirs[app]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{_run_dir(spark)}/{uuid.uuid4().hex}/{name}"


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tillscope/{app_id(spark)}"


def release(spark: SparkSession) -> None:
    """Remove what this application has staged; frames that read it are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and gives later joins the
    real file size, so Catalyst broadcasts a side only when it is under the threshold.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
