"""Table maintenance: dedupe, insert, upsert, reload, and the stored-table loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.functions import text
from tillscope.operators.attribution import explode_drivers
from tillscope.sources.transactions import raw_table
from tillscope.session import stage
from tillscope.sources.versions import current


# ------------------------------------------------------------------------ shape


def resolve_column(df: DataFrame, candidates: list[str], name: str) -> DataFrame:
    """Rename the first candidate that is present to ``name``."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {candidates} among {df.columns}")
    return df if found == name else df.withColumnRenamed(found, name)


def default_missing(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add absent columns; ``defaults`` maps a name to (type, value)."""
    absent = {n: F.lit(v).cast(t) for n, (t, v) in defaults.items() if n not in df.columns}
    return df.withColumns(absent) if absent else df


def methods_array(df: DataFrame) -> Column:
    """``method`` as a one-element array, else a comma list split, else an empty array."""
    empty = F.array().cast("array<string>")
    if "method" in df.columns:
        return F.when(F.col("method").isNotNull(), F.array("method")).otherwise(empty)
    if "detection_methods" in df.columns:
        return F.coalesce(F.split("detection_methods", ","), empty)
    return empty


# ----------------------------------------------------------------------- dedupe


def _any_null(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, first in ``order``. The rank filter limits each task to one row per key."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(ranked)).where(F.col("_row") == 1).drop("_row")


def keep_best(df: DataFrame, keys: list[str], score: str = "confidence", ties: list = ()) -> DataFrame:
    return keep_first(df, keys, F.desc(score), *ties)


def keep_last(df: DataFrame, keys: list[str], sequence: str, ties: list = ()) -> DataFrame:
    """One row per key, last by an explicit sequence or time column."""
    return keep_first(df, keys, F.desc(sequence), *ties)


# ----------------------------------------------------------------------- writes


def insert_do_nothing(target: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows of ``batch`` an insert would add: first per key in ``order``, keys already stored skipped.

    As in SQL a null key never conflicts, so such rows all go in and never share a group.
    """
    loose = batch.where(_any_null(keys))
    keyed = batch.where(~_any_null(keys))
    return keep_first(keyed, keys, *order).join(target.select(*keys), keys, "left_anti").unionByName(loose)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """The table after an upsert: listed columns take the batch's value, the rest stay.

    One full outer join on the key, which reads each side once; the batch must hold a key at
    most once. A null key never conflicts: it meets nothing in the join, and a hash of its row
    as a further key keeps such rows from piling up in a task.
    """
    t, b, hit = F.col("_t"), F.col("_b"), F.col("_t").isNotNull() & F.col("_b").isNotNull()
    apart = F.when(_any_null(keys), F.xxhash64("*")).otherwise(0).alias("_apart")
    packed_target = target.select(*keys, apart, F.struct(*target.columns).alias("_t"))
    packed_batch = batch.select(*keys, apart, F.struct(*batch.columns).alias("_b"))
    columns = []
    for c in target.columns:
        empty = F.lit(None).cast(target.schema[c].dataType)
        new = b[c] if c in batch.columns else empty
        if c in update:
            value = F.when(b.isNotNull(), new).otherwise(t[c])
        else:
            value = F.when(hit | b.isNull(), t[c]).otherwise(new)
        columns.append(value.alias(c))
    return packed_target.join(packed_batch, [*keys, "_apart"], "full_outer").select(*columns)


def merge_touched(path: str, batch: DataFrame, keys: list[str], update: list[str], partitions: list[str]) -> None:
    """Upsert ``batch`` into the table at ``path``, which is partitioned by ``partitions``, a part of ``keys``.

    Only the folders that hold a key of the batch are read and written again; the others keep
    their files. Which they are is found from the batch, one value for each folder. The merged
    rows are first written to the shared folder, and then put in place of the touched
    folders together, when all are written. Rows with a null key are added, as in ``upsert``.
    """
    if not partitions or not set(partitions) <= set(keys):
        raise ValueError("a key must tell its partition")
    spark = batch.sparkSession
    stored = spark.read.parquet(path)
    touched = batch.select(*partitions).distinct().collect()
    if not touched:
        return
    wanted = F.lit(False)
    for values in touched:
        one = F.lit(True)
        for name, value in zip(partitions, values):
            one = one & (F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
        wanted = wanted | one
    merged = stage(upsert(stored.where(wanted), batch, keys, update), "merged")
    merged.hint("rebalance", *[F.col(c) for c in partitions]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to the table at ``path``, to its current version if it has versions."""
    df.write.mode("append").parquet(current(df.sparkSession, path))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def query(spark: SparkSession, sql: str, params: dict | None = None, **views: DataFrame) -> DataFrame:
    """A parameterised SELECT; frames given by name are visible as ``{name}``."""
    return spark.sql(sql, args=params, **views)


# ------------------------------------------------------------ the six stored tables


def load_raw_transactions(tx: DataFrame) -> DataFrame:
    return raw_table(tx)


# Date columns in their order of preference.
DATE_CANDIDATES = ["timestamp", "calculation_date", "date", "week_date", "period", "week"]


def load_kpi_results(wide: DataFrame, sequence: str) -> DataFrame:
    """Wide KPI rows to the long table, per (KPI, date) the row that is last by ``sequence``.

    A table has no order of its own, so the column that says which row is later is required;
    of rows equal in it the greater value stays.
    """
    dated = resolve_column(wide, DATE_CANDIDATES, "week_date")
    names = [c for c in dated.columns if c not in (*DATE_CANDIDATES, "week_date", sequence)]
    long = dated.unpivot(["week_date", sequence], names, "kpi_name", "value").where(F.col("value").isNotNull())
    long = keep_last(long, ["kpi_name", "week_date"], sequence, [F.desc("value")])
    return long.select(
        "kpi_name",
        F.to_date("week_date").alias("week_date"),
        "value",
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("cadence"),
        F.current_timestamp().alias("computed_at"),
    )


def with_serial(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """A stable whole-number id in key order.

    Only for result tables of anomaly size: numbering in order runs in one task.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)))


def load_anomalies(anomalies: DataFrame) -> DataFrame:
    # Date columns in their order of preference.
    df = resolve_column(anomalies, ["anomaly_date", "date", "week_date", "detection_date"], "anomaly_date")
    methods = methods_array(df)
    df = default_missing(
        df, {"deviation_pct": ("double", None), "actual_value": ("double", None), "expected_value": ("double", None)}
    )
    ties = [c for c in ("method",) if c in df.columns]
    df = df.withColumn("detection_methods", methods)
    if "direction" not in df.columns:
        df = df.withColumn("direction", text.direction(F.col("deviation_pct")))
    unique = keep_best(df, ["kpi_name", "anomaly_date"], "confidence", ties)
    return with_serial(unique, ["kpi_name", "anomaly_date"]).select(
        "id", "kpi_name", "anomaly_date", "severity", "confidence", "actual_value", "expected_value",
        "deviation_pct", "direction", "detection_methods", F.current_timestamp().alias("detected_at"),
    )


def with_anomaly_id(rows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The stored id of each (KPI, date); null when the anomaly is not stored."""
    ids = anomalies.select("kpi_name", "anomaly_date", F.col("id").alias("anomaly_id"))
    return rows.join(ids, ["kpi_name", "anomaly_date"], "left")


def load_root_causes(flat: DataFrame, anomalies: DataFrame) -> DataFrame:
    rows = with_anomaly_id(explode_drivers(flat), anomalies)
    unique = insert_do_nothing(
        rows.where(F.lit(False)), rows, ["anomaly_id", "segment_rank"], ["kpi_name", "anomaly_date"]
    )
    return unique.select(
        "anomaly_id", "kpi_name", "anomaly_date", "status", "dimension", "segment_value",
        "contribution_pct", "segment_rank", F.current_timestamp().alias("analysed_at"),
    )


NARRATIVE_KEYS = ["kpi_name", "anomaly_date", "narrative_type"]
NARRATIVE_UPDATES = ["narrative_text", "prompt_version", "generated_at"]


def upsert_narratives(table: DataFrame, parsed: DataFrame, sequence: str = "generated_at") -> DataFrame:
    """Last entry per key, upserted; the stored retrieval context is left as it was."""
    batch = keep_last(parsed, NARRATIVE_KEYS, sequence, ["narrative_text"])
    return upsert(table, batch, NARRATIVE_KEYS, NARRATIVE_UPDATES)


