"""The data behind the report pages: overview, series statistics, markers, drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope import catalogue as cat
from tillscope.functions import text
from tillscope.operators.detection import point_anomalies
from tillscope.operators.kpis import unpivot_kpis
from tillscope.operators.retrieval import narrative_lookup


def all_time_long(latest: DataFrame) -> DataFrame:
    """The one-row KPI frame as ``(kpi_name, value)``."""
    return unpivot_kpis(latest.withColumn("date", F.lit(None).cast("date"))).drop("date")


def owner_report(latest: DataFrame) -> DataFrame:
    """KPI values by owner with their printed form."""
    owners = cat.kpi_catalogue(latest.sparkSession).select("kpi_name", "owner")
    return (
        all_time_long(latest)
        .join(owners, "kpi_name", "left")
        .select(
            F.coalesce("owner", F.lit("Unknown")).alias("owner"),
            "kpi_name",
            "value",
            text.report_kpi_value(F.col("kpi_name"), F.col("value")).alias("formatted_value"),
        )
        .orderBy("owner", "kpi_name")
    )


def series_position(series: DataFrame) -> DataFrame:
    """0..n-1 in date order, whatever calendar gaps there are."""
    return series.withColumn("position", F.row_number().over(Window.partitionBy("kpi_name").orderBy("date")) - 1)


def normalise_to_mean(series: DataFrame) -> DataFrame:
    mean = F.avg("value").over(Window.partitionBy("kpi_name"))
    return series.withColumn("pct_of_mean", F.try_divide(F.col("value"), mean) * 100)


def trend_arrows(series: DataFrame) -> DataFrame:
    """Last four points against the four before (or the first four of a short series).

    The arrow is blank under four points or when the earlier mean is zero.
    """
    by_kpi = Window.partitionBy("kpi_name")
    placed = series.where(F.col("value").isNotNull()).select(
        "kpi_name",
        "value",
        F.row_number().over(by_kpi.orderBy(F.desc("date"))).alias("back"),
        F.row_number().over(by_kpi.orderBy("date")).alias("front"),
        F.count(F.lit(1)).over(by_kpi).alias("n"),
    )
    before = F.when(F.col("n") >= 8, F.col("back").between(5, 8)).otherwise(F.col("front") <= 4)
    stats = placed.groupBy("kpi_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("back") <= 4, F.col("value"))).alias("recent"),
        F.avg(F.when(before, F.col("value"))).alias("earlier"),
    )
    change = F.try_divide(F.col("recent") - F.col("earlier"), F.abs("earlier"))
    arrow = (
        F.when((F.col("n") < 4) | (F.col("earlier") == 0), "")
        .when(change > 0.05, "↑")
        .when(change < -0.05, "↓")
        .otherwise("→")
    )
    return stats.select("kpi_name", arrow.alias("trend"))


def flagged_kpis(kpis: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The KPIs with at least one anomaly."""
    return kpis.join(anomalies, "kpi_name", "left_semi")


def kpi_overview(latest: DataFrame, series: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Category, label, all-time value, its printed form, trend arrow and anomaly flag."""
    cards = cat.kpi_catalogue(latest.sparkSession).where(F.col("category").isNotNull())
    flagged = anomalies.select("kpi_name").distinct().withColumn("flag", F.lit(True))
    return (
        cards.select("category", "kpi_name", "label")
        .join(all_time_long(latest), "kpi_name")
        .join(trend_arrows(series), "kpi_name", "left")
        .join(flagged, "kpi_name", "left")
        .select(
            "category",
            "kpi_name",
            "label",
            "value",
            text.format_kpi_value(F.col("kpi_name"), F.col("value")).alias("formatted_value"),
            F.coalesce("trend", F.lit("")).alias("trend"),
            F.coalesce("flag", F.lit(False)).alias("has_anomaly"),
        )
    )


def series_stats(series: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Mean, minimum, maximum and point-anomaly count per KPI."""
    counts = point_anomalies(anomalies).groupBy("kpi_name").agg(F.count(F.lit(1)).alias("n"))
    return (
        series.groupBy("kpi_name")
        .agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
        .join(counts, "kpi_name", "left")
        .select("kpi_name", "mean", "min", "max", F.coalesce("n", F.lit(0)).alias("anomalies"))
    )


def anomaly_markers(anomalies: DataFrame, series: DataFrame) -> DataFrame:
    """Point anomalies whose date is a point of their KPI's series."""
    points = series.where(F.col("value").isNotNull())
    return point_anomalies(anomalies).join(points, ["kpi_name", "date"], "left_semi")


def anomaly_drilldown(anomalies: DataFrame, flat: DataFrame, narratives: DataFrame) -> DataFrame:
    """Each anomaly's driver rows with the stored narrative and summary."""
    causes = flat.select("kpi_name", "date", "status", "summary", *[c for c in flat.columns if c.startswith("driver_")])
    drivers = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"driver_{i}_dimension").isNotNull() & F.col(f"driver_{i}_contribution_pct").isNotNull(),
                    F.struct(
                        F.lit(i).alias("rank"),
                        F.concat_ws("=", f"driver_{i}_dimension", f"driver_{i}_segment").alias("driver"),
                        F.col(f"driver_{i}_contribution_pct").alias("contribution_pct"),
                    ),
                )
                for i in (1, 2, 3)
            ]
        )
    )
    joined = anomalies.select("kpi_name", "date", "severity", "method").join(causes, ["kpi_name", "date"])
    return narrative_lookup(joined.withColumn("drivers", drivers), narratives).select(
        "kpi_name", "date", "severity", "method", "status", "summary", "narrative", F.inline_outer("drivers")
    )
