"""Staging, weekly marts and the SQL views over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import dates
from tillscope.functions.severity import severity_rank


def stg_transactions(raw: DataFrame) -> DataFrame:
    """Sales lines only (returns and free lines left out), with value and Monday."""
    return raw.where((F.col("quantity") > 0) & (F.col("unit_price") > 0)).withColumns(
        {
            "line_total": F.col("quantity") * F.col("unit_price"),
            "week_start": dates.week_start(F.col("invoice_date")),
        }
    )


def _per(value: str, count: str):
    return F.try_divide(F.col(value), F.nullif(F.col(count), F.lit(0)))


def int_weekly_transactions(stg: DataFrame) -> DataFrame:
    """Per week, country and product. The guarded ratios are null, not zero."""
    return (
        stg.groupBy("week_start", "country", "stock_code")
        .agg(
            F.count_distinct("invoice_no").alias("order_count"),
            F.count_distinct("customer_id").alias("unique_customers"),
            F.sum("quantity").alias("units_sold"),
            F.sum("line_total").cast("double").alias("revenue"),
        )
        .withColumns(
            {"revenue_per_order": _per("revenue", "order_count"), "revenue_per_customer": _per("revenue", "unique_customers")}
        )
    )


def mart_weekly_kpis(stg: DataFrame, exact: bool = False) -> DataFrame:
    """Week totals. By default order and customer counts add up per country and product,
    so each counts once per product it bought; ``exact`` recounts them per week."""
    if exact:
        weekly = stg.groupBy("week_start").agg(
            F.sum("line_total").cast("double").alias("total_revenue"),
            F.count_distinct("invoice_no").alias("order_count"),
            F.sum("quantity").alias("units_sold"),
            F.count_distinct("customer_id").alias("active_customers"),
        )
    else:
        grain = stg.groupBy("week_start", "country", "stock_code").agg(
            F.count_distinct("invoice_no").alias("order_count"),
            F.count_distinct("customer_id").alias("active_customers"),
            F.sum("quantity").alias("units_sold"),
            F.sum("line_total").alias("revenue"),
        )
        weekly = grain.groupBy("week_start").agg(
            F.sum("revenue").cast("double").alias("total_revenue"),
            F.sum("order_count").alias("order_count"),
            F.sum("units_sold").alias("units_sold"),
            F.sum("active_customers").alias("active_customers"),
        )
    return weekly.withColumns(
        {
            "revenue_per_order": _per("total_revenue", "order_count"),
            "revenue_per_customer": _per("total_revenue", "active_customers"),
        }
    ).orderBy("week_start")


def kpi_with_anomaly_flag(kpi_results: DataFrame, anomalies: DataFrame) -> DataFrame:
    found = anomalies.select(
        "kpi_name", F.col("anomaly_date").alias("week_date"), "id", "severity", "confidence", "deviation_pct", "direction"
    )
    return kpi_results.join(found, ["kpi_name", "week_date"], "left").select(
        "kpi_name", "week_date", "value", "category", F.col("id").isNotNull().alias("is_anomaly"),
        "severity", "confidence", "deviation_pct", "direction",
    )


def anomaly_clusters(anomalies: DataFrame, ordinal: bool = False) -> DataFrame:
    """Dates on which several KPIs are anomalous.

    The greatest severity is the alphabetical one unless ``ordinal`` asks for the true one.
    At most one row per KPI and date exists, so the KPI list is bounded by the catalogue.
    """
    worst = F.max_by("severity", severity_rank(F.col("severity"))) if ordinal else F.max("severity")
    return (
        anomalies.groupBy("anomaly_date")
        .agg(
            F.count(F.lit(1)).alias("kpi_count"),
            F.array_sort(F.collect_list("kpi_name")).alias("kpis_affected"),
            worst.alias("max_severity"),
            F.round(F.avg(F.col("confidence").cast("decimal(5,4)")), 4).cast("double").alias("avg_confidence"),
        )
        .where(F.col("kpi_count") > 1)
        .orderBy("anomaly_date")
    )


def anomaly_summary(anomalies: DataFrame, root_causes: DataFrame) -> DataFrame:
    top = root_causes.where(F.col("segment_rank") == 1).select(
        F.col("anomaly_id").alias("id"),
        "status",
        F.col("dimension").alias("top_dimension"),
        F.col("segment_value").alias("top_segment"),
        F.col("contribution_pct").alias("top_contribution_pct"),
    )
    return anomalies.join(top, "id", "left").select(
        "id", "kpi_name", "anomaly_date", "severity", "confidence", "actual_value", "expected_value",
        "deviation_pct", "detection_methods", "status", "top_dimension", "top_segment", "top_contribution_pct",
    )


def driver_share_by_kpi(summary: DataFrame) -> DataFrame:
    return (
        summary.where(F.col("top_contribution_pct").isNotNull())
        .groupBy("kpi_name")
        .agg(F.avg("top_contribution_pct").alias("avg_top_contribution"), F.count(F.lit(1)).alias("n"))
    )


def daily_kpi_table(daily_long: DataFrame, tx: DataFrame) -> DataFrame:
    """The contract's long daily table with the share of non-null input cells per day."""
    cells = [F.col(c).isNotNull().cast("int") for c in tx.columns]
    filled = sum(cells[1:], cells[0])
    per_day = tx.groupBy(dates.day(F.col("InvoiceDate")).alias("date")).agg(
        (F.sum(filled).cast("double") / (F.count(F.lit(1)) * len(cells))).alias("data_completeness")
    )
    return daily_long.withColumnRenamed("value", "kpi_value").join(per_day, "date").select(
        "date", "kpi_name", "kpi_value", F.lit(None).cast("double").alias("confidence_score"),
        F.current_timestamp().alias("calculation_timestamp"), "data_completeness",
    )


def insights_table(anomalies: DataFrame, root_causes: DataFrame, narratives: DataFrame) -> DataFrame:
    """One insight per detection with its root cause as JSON and its narrative, if any."""
    trend = F.col("method").contains("mann_kendall")
    causes = root_causes.select(
        "kpi_name", "date", F.to_json(F.struct("status", "dimensions_analysed", "drivers")).alias("root_cause")
    )
    texts = narratives.select("kpi_name", "date", "narrative")
    identity = F.concat_ws("|", "kpi_name", F.col("date").cast("string"), F.when(trend, "trend_break").otherwise("anomaly"))
    return (
        anomalies.join(causes, ["kpi_name", "date"], "left")
        .join(texts, ["kpi_name", "date"], "left")
        .select(
            F.sha2(identity, 256).alias("insight_id"),
            F.col("date").alias("detection_date"),
            "kpi_name",
            F.when(trend, "trend_break").otherwise("anomaly").alias("insight_type"),
            "severity",
            F.col("confidence").alias("confidence_score"),
            F.col("description").alias("explanation"),
            F.when(~trend, F.col("root_cause")).alias("root_cause"),
            F.when(~trend, F.col("narrative")).alias("narrative"),
            F.lit("pending").alias("status"),
            F.lit(None).cast("string").alias("approved_by"),
            F.lit(None).cast("timestamp").alias("approval_timestamp"),
        )
    )
