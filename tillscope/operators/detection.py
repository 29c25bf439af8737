"""Anomaly detection over long KPI series ``(kpi_name, date, value)``, all KPIs in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope import catalogue as cat
from tillscope.functions import text
from tillscope.functions.numbers import fixed, half_even
from tillscope.functions.severity import severity_iqr, severity_trend, severity_zscore
from tillscope.operators.trend import trend_statistics
from tillscope.schemas import ANOMALIES
from tillscope.session import stage

Baseline = tuple[str, str] | None


def in_baseline(date: Column, baseline: Baseline) -> Column:
    if baseline is None:
        return F.lit(True)
    start, end = (F.lit(b).cast("date") for b in baseline)
    return date.between(start, end)


def baseline_statistics(series: DataFrame, baseline: Baseline = None) -> DataFrame:
    """Per KPI: points, and mean, deviation and quartiles of the baseline window.

    A window with fewer than five points falls back to the whole series. Both variants
    come out of the same aggregate, so no second pass is needed to decide.
    """
    inside = F.when(in_baseline(F.col("date"), baseline), F.col("value"))
    quartiles = [0.25, 0.5, 0.75]
    enough = F.col("n_baseline") >= cat.MIN_BASELINE_POINTS
    stats = series.where(F.col("value").isNotNull()).groupBy("kpi_name").agg(
        F.count("value").alias("n_points"),
        F.count(inside).alias("n_baseline"),
        F.avg("value").alias("all_mean"),
        F.stddev_samp("value").alias("all_std"),
        F.percentile("value", quartiles).alias("all_q"),
        F.avg(inside).alias("base_mean"),
        F.stddev_samp(inside).alias("base_std"),
        F.percentile(inside, quartiles).alias("base_q"),
    )
    q = F.when(enough, F.col("base_q")).otherwise(F.col("all_q"))
    return stats.select(
        "kpi_name",
        "n_points",
        "n_baseline",
        F.when(enough, F.col("base_mean")).otherwise(F.col("all_mean")).alias("mean"),
        F.when(enough, F.col("base_std")).otherwise(F.col("all_std")).alias("std"),
        q[0].alias("q1"),
        q[1].alias("median"),
        q[2].alias("q3"),
    )


def _with_statistics(series: DataFrame, baseline: Baseline) -> DataFrame:
    points = series.where(F.col("value").isNotNull()).select("kpi_name", "date", "value")
    return points.join(baseline_statistics(series, baseline), "kpi_name").where(
        F.col("n_points") >= cat.MIN_POINTS
    )


def _anomaly_rows(df: DataFrame, expected: str, method: str, severity: Column, confidence: Column, stat: Column) -> DataFrame:
    deviation = F.col("value") - F.col(expected)
    pct = F.when(F.col(expected) != 0, F.try_divide(deviation, F.col(expected)) * 100).otherwise(F.lit(0.0))
    rows = df.select(
        "kpi_name",
        "date",
        F.col("value").alias("actual_value"),
        F.col(expected).alias("expected_value"),
        deviation.alias("deviation"),
        pct.alias("deviation_pct"),
        F.lit(method).alias("method"),
        severity.alias("severity"),
        half_even(F.least(F.lit(0.99), confidence), 3).alias("confidence"),
        half_even(stat, 4).alias("stat_value"),
    )
    sentence = text.anomaly_sentence(
        *[F.col(c) for c in ("kpi_name", "date", "deviation_pct", "deviation", "actual_value", "expected_value", "method", "confidence")]
    )
    return rows.withColumn("description", sentence)


def detect_zscore(series: DataFrame, threshold: float = cat.ZSCORE_THRESHOLD, baseline: Baseline = None) -> DataFrame:
    """Points at least ``threshold`` baseline deviations from the baseline mean."""
    return _by_zscore(_with_statistics(series, baseline), threshold)


def _by_zscore(points: DataFrame, threshold: float) -> DataFrame:
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    scored = points.where(F.col("std") != 0).withColumn("z", z)
    size = F.abs("z")
    return _anomaly_rows(
        scored.where(size >= threshold), "mean", "zscore",
        severity_zscore(F.col("z")), 0.5 + (size - threshold) * 0.15, F.col("z"),
    )


def detect_iqr(series: DataFrame, multiplier: float = cat.IQR_MULTIPLIER, baseline: Baseline = None) -> DataFrame:
    """Points strictly outside the quartile fences of the baseline."""
    return _by_iqr(_with_statistics(series, baseline), multiplier)


def _by_iqr(points: DataFrame, multiplier: float) -> DataFrame:
    value, iqr = F.col("value"), F.col("iqr")
    fenced = (
        points.withColumn("iqr", F.col("q3") - F.col("q1"))
        .where(iqr != 0)
        .withColumns({"lower": F.col("q1") - multiplier * iqr, "upper": F.col("q3") + multiplier * iqr})
        .where((value < F.col("lower")) | (value > F.col("upper")))
        .withColumn(
            "distance",
            F.when(value > F.col("upper"), (value - F.col("upper")) / iqr).otherwise((F.col("lower") - value) / iqr),
        )
    )
    reach = multiplier + F.col("distance")
    return _anomaly_rows(fenced, "median", "iqr", severity_iqr(reach), 0.5 + F.col("distance") * 0.2, reach)


def detect_trend(series: DataFrame, significance: float = cat.TREND_SIGNIFICANCE) -> DataFrame:
    """At most one row per KPI, dated at the last point, when the series drifts significantly."""
    found = trend_statistics(series).where(
        (F.col("n") >= cat.MIN_TREND_POINTS) & (F.col("var_s") > 0) & (F.col("s") != 0) & (F.col("p_value") <= significance)
    )
    deviation = F.col("last_value") - F.col("mean")
    pct = F.when(F.col("mean") != 0, F.try_divide(deviation, F.col("mean")) * 100).otherwise(F.lit(0.0))
    return found.select(
        "kpi_name",
        F.col("last_date").alias("date"),
        F.col("last_value").alias("actual_value"),
        F.col("mean").alias("expected_value"),
        deviation.alias("deviation"),
        pct.alias("deviation_pct"),
        F.lit("mann_kendall").alias("method"),
        severity_trend(F.col("p_value"), F.col("slope")).alias("severity"),
        half_even(F.least(F.lit(0.99), 1 - F.col("p_value")), 3).alias("confidence"),
        half_even(F.col("z"), 4).alias("stat_value"),
        text.trend_sentence(
            *[F.col(c) for c in ("kpi_name", "s", "p_value", "slope", "last_value", "mean")]
        ).alias("description"),
    )


def is_trend(method: Column) -> Column:
    return method.contains("mann_kendall")


def point_anomalies(anomalies: DataFrame) -> DataFrame:
    return anomalies.where(~is_trend(F.col("method")))


def union_detections(*detections: DataFrame) -> DataFrame:
    out = detections[0]
    for more in detections[1:]:
        out = out.unionByName(more)
    return out


def merge_detections(detections: DataFrame) -> DataFrame:
    """One row per KPI and day when methods agree; trends stay rows of their own.

    The most confident detection is kept (z-score on a tie), its confidence raised by 0.1
    per further method and its method and description extended.
    """
    fields = [n for n in ANOMALIES.names if n not in ("kpi_name", "date")]
    order = F.when(F.col("method") == "zscore", 0).when(F.col("method") == "iqr", 1).otherwise(2)
    groups = (
        point_anomalies(detections)
        .withColumn("order", order)
        .groupBy("kpi_name", "date")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by(F.struct(*fields), F.struct(F.col("confidence"), -F.col("order"))).alias("best"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("order", "method"))), lambda m: m["method"]
            ).alias("methods"),
        )
    )
    several = F.col("n") > 1
    confidence = half_even(F.least(F.lit(0.99), F.col("best.confidence") + 0.1 * (F.col("n") - 1)), 3)
    suffix = text.confirmed_suffix(F.col("n"), F.array_join("methods", ", "))
    merged = {
        "method": F.array_join("methods", "_and_"),
        "confidence": F.when(several, confidence).otherwise(F.col("best.confidence")),
        "description": F.when(several, F.concat("best.description", suffix)).otherwise(F.col("best.description")),
    }
    points = groups.select(
        "kpi_name", "date", *[merged.get(f, F.col(f"best.{f}")).alias(f) for f in fields]
    )
    return points.unionByName(detections.where(is_trend(F.col("method"))))


def detect_all(
    series: DataFrame,
    baseline: Baseline = None,
    zscore_threshold: float = cat.ZSCORE_THRESHOLD,
    iqr_multiplier: float = cat.IQR_MULTIPLIER,
    trend_significance: float = cat.TREND_SIGNIFICANCE,
) -> DataFrame:
    """All three methods over every KPI series that detection does not skip, merged.

    The points with their baseline statistics are computed once and staged, since both point
    tests and the trend test read them.
    """
    watched = series.where(~F.col("kpi_name").isin(*cat.SKIPPED_IN_DETECTION) & F.col("value").isNotNull())
    watched = watched.select("kpi_name", "date", "value")
    points = stage(watched.join(baseline_statistics(watched, baseline), "kpi_name"), "series_points")
    enough = points.where(F.col("n_points") >= cat.MIN_POINTS)
    return merge_detections(
        union_detections(
            _by_zscore(enough, zscore_threshold), _by_iqr(enough, iqr_multiplier), detect_trend(points, trend_significance)
        )
    )


# ------------------------------------------------------------------- reports


def order_anomalies(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy("date", "kpi_name", "method")


def top_confidence(rows: DataFrame, column: str = "confidence", n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(column), "kpi_name", "date").limit(n)


def filter_anomalies(anomalies: DataFrame, severities: list[str], kpis: list[str]) -> DataFrame:
    return anomalies.where(F.col("severity").isin(*severities) & F.col("kpi_name").isin(*kpis))


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    """Counts by severity and by KPI, the total, and how many KPIs are affected."""
    parts = [
        anomalies.groupBy(F.col("severity").alias("name")).count().withColumn("breakdown", F.lit("severity")),
        anomalies.groupBy(F.col("kpi_name").alias("name")).count().withColumn("breakdown", F.lit("kpi")),
        anomalies.agg(F.count(F.lit(1)).alias("count")).select(F.lit("all").alias("name"), "count", F.lit("total").alias("breakdown")),
        anomalies.agg(F.count_distinct("kpi_name").alias("count")).select(
            F.lit("all").alias("name"), "count", F.lit("kpis_affected").alias("breakdown")
        ),
    ]
    return union_detections(*parts).select("breakdown", "name", F.col("count").alias("n"))


def anomaly_display(anomalies: DataFrame) -> DataFrame:
    """The explorer table: formatted date, confidence and deviation, upper-case severity."""
    return anomalies.select(
        text.iso(F.col("date")).alias("Date"),
        F.col("kpi_name").alias("KPI"),
        F.upper("severity").alias("Severity"),
        text.whole_percent(F.col("confidence")).alias("Confidence"),
        F.concat(fixed(F.col("deviation_pct"), 1), F.lit("%")).alias("Deviation"),
        F.col("method").alias("Method"),
    )
