"""Call logs, keyed narrative files, result files and the result cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.schemas import ANOMALIES, CALL_LOG, NARRATIVE_ENTRY, ROOT_CAUSES_FLAT
from tillscope.sources.splitting import json_entries
from tillscope.sources.versions import current, new_version, publish


def read_call_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines. Blank lines are skipped; malformed ones are dropped, or fail if strict."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(CALL_LOG).option("mode", mode).json(path)


def append_call_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_keyed_json(spark: SparkSession, path: str, entry: T.StructType = NARRATIVE_ENTRY) -> DataFrame:
    """Files holding one object of entries, or a list of entries, to one row per entry.

    Files are cut at their entries, so one of any size is read in several tasks and no task
    holds more than some entries. Entries that are not objects or do not parse are skipped. The
    key is null for lists.
    """
    cut = json_entries(spark, path)
    # of what is cut off together, only the last entry is an object, so the others are passed over as text
    pair = F.try_element_at(F.map_entries(F.from_json(F.when(~F.col("listed"), F.col("value")), "map<string,string>")), F.lit(-1))
    lone = F.try_element_at(F.from_json(F.when(F.col("listed"), F.col("value")), "array<string>"), F.lit(-1))
    rows = cut.select(pair["key"].alias("key"), F.from_json(F.coalesce(pair["value"], lone), entry).alias("entry"))
    return rows.where(F.col("entry").isNotNull()).select("key", "entry.*")


def write_keyed_json(rows: DataFrame, path: str) -> None:
    """Narratives as JSON lines that carry their key, written in parallel."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_keyed_rows(spark: SparkSession, path: str, entry: T.StructType = NARRATIVE_ENTRY) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.StringType()), *entry.fields])
    return spark.read.schema(schema).json(path)


def write_anomalies(df: DataFrame, path: str) -> None:
    df.select(*ANOMALIES.names).write.mode("overwrite").csv(path, header=True, escape='"')


def read_anomalies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANOMALIES).csv(path, header=True, escape='"')


def write_root_causes(flat: DataFrame, path: str) -> None:
    flat.select(*ROOT_CAUSES_FLAT.names).write.mode("overwrite").csv(path, header=True, escape='"')


def read_root_causes(spark: SparkSession, path: str) -> DataFrame:
    """Segments are read as strings, so a stock code keeps its digits."""
    return spark.read.schema(ROOT_CAUSES_FLAT).csv(path, header=True, escape='"')


CACHE_TABLES = ("kpi_timeseries", "kpi_latest", "anomalies", "root_causes")


def write_cache(path: str, **tables: DataFrame) -> None:
    """The four result tables behind the dashboards, and further ones if given, replaced as a set.

    Each call writes a folder of its own and then adds one line to the list of versions, so a
    reader sees the old four or the new four, and a failed job leaves the old ones in place.
    """
    if missing := set(CACHE_TABLES) - set(tables):
        raise ValueError(f"a cache needs {sorted(missing)} too")
    version, folder = new_version(path)
    for name in tables:
        tables[name].write.parquet(f"{folder}/{name}")
    publish(tables[CACHE_TABLES[0]].sparkSession, path, version)


def read_cache(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version written last."""
    df = spark.read.parquet(f"{current(spark, path)}/{name}")
    return df.withColumn("date", F.to_date("date")) if "date" in df.columns else df
