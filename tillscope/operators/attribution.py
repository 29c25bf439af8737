"""Root causes: how far each segment explains an anomaly's deviation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope import catalogue as cat
from tillscope.functions import dates, text
from tillscope.functions.numbers import half_even
from tillscope.operators.detection import point_anomalies
from tillscope.operators.kpis import entity_rollup
from tillscope.session import stage

# Fixed order: it decides ties between dimensions.
DIMENSIONS = ("Country", "StockCode", "HourOfDay")

# KPI to the metric measured per segment; every other KPI is measured by revenue.
SEGMENT_METRIC = {
    "order_count": "orders",
    "units_sold": "units",
    "active_customers": "customers",
    "items_per_order": "items_per_order",
}
METRICS = ("revenue", "orders", "units", "customers", "items_per_order")

DRIVERS = (
    "array<struct<rank:int,dimension:string,segment:string,actual:double,expected:double,"
    "deviation:double,contribution_pct:double>>"
)


def metric_of(kpi: Column) -> Column:
    out = F.lit("revenue")
    for name, metric in SEGMENT_METRIC.items():
        out = F.when(kpi == name, metric).otherwise(out)
    return out


def in_baseline_period(ts: Column, baseline) -> Column:
    """Inclusive, and ending at midnight of the last day, whose daytime rows are left out."""
    start, end = (F.lit(b).cast("timestamp_ntz") for b in baseline)
    return ts.between(start, end)


def baseline_rows(tx: DataFrame, baseline) -> DataFrame:
    """Rows of the baseline; on a table stored by week its other folders are not read."""
    if baseline is None:
        return tx
    rows = tx.where(in_baseline_period(F.col("InvoiceDate"), baseline))
    if "week_end" in tx.columns:
        rows = rows.where(F.col("week_end").between(*_baseline_weeks(baseline)))
    return rows


def _baseline_weeks(baseline) -> list[Column]:
    return [dates.week_end(F.lit(b).cast("timestamp_ntz")) for b in baseline]


def with_week_end(tx: DataFrame) -> DataFrame:
    """``tx`` with its stored ``week_end``, or one computed where it has none."""
    return tx if "week_end" in tx.columns else tx.withColumn("week_end", dates.week_end(F.col("InvoiceDate")))


def calendar_weeks(anomalies: DataFrame) -> list:
    """The distinct dates of ``anomalies``: as many as the calendar has weeks, so they may be literals."""
    return sorted(r["date"] for r in anomalies.where("date is not null").select("date").distinct().collect())


def in_anomaly_week(ts: Column, date: Column, window: str = "W", full_week: bool = False) -> Column:
    """Residual test for a row already in the bucket dated ``date``.

    Parity ends the period at 00:00 of its last day; ``full_week`` keeps that day whole.
    """
    if full_week:
        return F.lit(True)
    if window == "W":
        return ts <= dates.midnight(date)
    return ts == dates.midnight(date)


class BaselineProfile:
    """What attribution needs to know of the baseline before it slices: its rows, length and top products.

    Built from one grouped pass and staged, since it is read several times and is tiny:
    one row per top product plus one summary row.
    """

    def __init__(self, tx: DataFrame, baseline, top_n: int = cat.TOP_SEGMENT_PRODUCTS):
        self.baseline = baseline
        self.profile = self._build(tx, top_n)
        summary = self._summary()
        if baseline is not None and summary["n_rows"] == 0:
            self.baseline = None
            self.profile = self._build(tx, top_n)
            summary = self._summary()
        first, last = summary["first_ts"], summary["last_ts"]
        self.days = (last - first).days + 1 if first is not None else 0
        self.scale = 7.0 / self.days if self.days > 0 else 1.0

    def rows(self, tx: DataFrame) -> DataFrame:
        return baseline_rows(tx, self.baseline)

    def _build(self, tx: DataFrame, top_n: int) -> DataFrame:
        by_product = F.grouping("StockCode") == 0
        ranked = Window.partitionBy("is_product").orderBy(F.desc("revenue"), F.asc("StockCode"))
        profile = (
            self.rows(tx)
            .groupingSets([["StockCode"], []], "StockCode")
            .agg(
                by_product.alias("is_product"),
                F.sum(F.col("Quantity") * F.col("UnitPrice")).alias("revenue"),
                F.min("InvoiceDate").alias("first_ts"),
                F.max("InvoiceDate").alias("last_ts"),
                F.count("InvoiceDate").alias("n_rows"),
            )
            .withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= top_n)
        )
        return stage(profile, "baseline_profile")

    def _summary(self):
        row = self.profile.where(~F.col("is_product")).first()
        return row.asDict() if row else {"n_rows": 0, "first_ts": None, "last_ts": None}

    def top_products(self) -> DataFrame:
        """At most ``top_n`` rows."""
        return self.profile.where("is_product").select("StockCode", F.col("rank").alias("product_rank"), "revenue")


def top_products(tx: DataFrame, baseline=None, n: int = cat.TOP_SEGMENT_PRODUCTS) -> DataFrame:
    """The products with the most baseline revenue; ties go to the smaller stock code."""
    return (
        baseline_rows(tx, baseline)
        .groupBy("StockCode")
        .agg(F.sum(F.col("Quantity") * F.col("UnitPrice")).alias("revenue"))
        .orderBy(F.desc("revenue"), "StockCode")
        .limit(n)
    )


def _segment_array(product: Column) -> Column:
    """The segments of a row; a dimension is its place in ``DIMENSIONS``, so that rows by invoice stay narrow."""

    def segment(dimension, value, order):
        place = F.lit(DIMENSIONS.index(dimension)).cast("tinyint")
        return F.struct(place.alias("dimension"), value.alias("segment"), order.alias("segment_order"))

    return F.array_compact(
        F.array(
            segment("Country", F.col("Country"), F.lit(0)),
            F.when(product.isNotNull(), segment("StockCode", F.col("StockCode"), product)),
            segment("HourOfDay", F.hour("InvoiceDate").cast("string"), F.hour("InvoiceDate")),
        )
    )


def _named_dimension(segments: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(d) for d in DIMENSIONS])
    return segments.withColumn("dimension", names[F.col("dimension").cast("int")])


def segment_metrics(rows: DataFrame, keys: list[str], products: DataFrame | None = None) -> DataFrame:
    """All metrics per (keys, dimension, segment) in one grouped pass.

    ``products`` limits the product dimension to a ranked list, which the planner broadcasts
    if its size allows; without it every product is a segment.
    """
    if products is None:
        rows = rows.withColumn("product_rank", F.lit(0))
    else:
        rows = rows.join(products.select("StockCode", "product_rank"), "StockCode", "left")
    exploded = rows.select(
        *keys,
        F.inline(_segment_array(F.col("product_rank"))),
        "InvoiceNo",
        "CustomerID",
        (F.col("Quantity") * F.col("UnitPrice")).alias("revenue"),
        F.col("Quantity").cast("bigint").alias("units"),
    )
    group = [*keys, "dimension", "segment", "segment_order"]
    entities = entity_rollup(exploded, group, ["revenue", "units"])
    invoice, known = F.col("by_invoice"), F.col("entity_known")
    metrics = (
        entities.groupBy(*group)
        .agg(
            F.coalesce(F.sum(F.when(invoice, F.col("revenue"))).cast("double"), F.lit(0.0)).alias("revenue"),
            F.count_if(invoice & known).cast("double").alias("orders"),
            F.coalesce(F.sum(F.when(invoice, F.col("units"))).cast("double"), F.lit(0.0)).alias("units"),
            F.count_if(~invoice & known).cast("double").alias("customers"),
        )
        .withColumn(
            "items_per_order",
            F.when(F.col("orders") > 0, F.try_divide("units", "orders")).otherwise(F.lit(0.0)),
        )
    )
    return _named_dimension(metrics)


def _long_metrics(metrics: DataFrame, keys: list[str], value: str) -> DataFrame:
    return metrics.unpivot([*keys, "dimension", "segment", "segment_order"], list(METRICS), "metric", value)


def period_and_baseline(tx: DataFrame, anomaly_dates: DataFrame, profile: BaselineProfile, full_week: bool = False) -> DataFrame:
    """Segment metrics of every anomalous week and of the baseline, from one scan.

    ``period`` is the week's Sunday, or null for the baseline. A row belongs to at most
    one week and to the baseline; rows of neither are dropped before anything is shuffled,
    and on a table stored by week their folders are not read.
    """
    ts, week = F.col("InvoiceDate"), F.col("week_end")
    anomalous = week.isin(calendar_weeks(anomaly_dates))
    tagged = with_week_end(tx)
    if profile.baseline is None:
        base = F.lit(True)
    else:
        base = in_baseline_period(ts, profile.baseline)
        tagged = tagged.where(anomalous | week.between(*_baseline_weeks(profile.baseline)))
    in_week = anomalous & in_anomaly_week(ts, week, "W", full_week)
    periods = F.array_compact(
        F.array(
            F.when(in_week, F.struct(F.lit(False).alias("is_baseline"), week.alias("period"))),
            F.when(base, F.struct(F.lit(True).alias("is_baseline"), F.lit(None).cast("date").alias("period"))),
        )
    )
    rows = tagged.select(
        F.inline(periods), "StockCode", "Country", "InvoiceDate", "InvoiceNo", "CustomerID", "Quantity", "UnitPrice"
    )
    return segment_metrics(rows, ["is_baseline", "period"], profile.top_products())


def contributions(anomalies: DataFrame, metrics: DataFrame, scale: float, minimum_pct: float = cat.MIN_CONTRIBUTION_PCT) -> DataFrame:
    """One row per anomaly and segment that explains at least ``minimum_pct`` of its deviation.

    Segments are those of the baseline: a segment new in the week does not appear. The
    cut is made on the unrounded share.
    """
    base = _long_metrics(metrics.where("is_baseline"), [], "baseline_value")
    actual = (
        _long_metrics(metrics.where("not is_baseline"), ["period"], "actual_value")
        .withColumnRenamed("period", "date")
        .drop("segment_order")
    )
    wanted = anomalies.select(
        "kpi_name", "date", F.col("deviation").alias("total_deviation"), metric_of(F.col("kpi_name")).alias("metric")
    )
    expected = F.col("baseline_value") * scale
    value = F.coalesce(F.col("actual_value"), F.lit(0.0))
    share = F.try_divide(value - expected, F.col("total_deviation")) * 100
    return (
        wanted.join(base, "metric")
        .join(actual, ["date", "dimension", "segment", "metric"], "left")
        .withColumn("share", share)
        .where(F.abs("share") >= minimum_pct)
        .select(
            "kpi_name",
            "date",
            "dimension",
            "segment",
            "segment_order",
            half_even(value, 2).alias("actual"),
            half_even(expected, 2).alias("expected"),
            half_even(value - expected, 2).alias("deviation"),
            half_even(F.col("share"), 1).alias("contribution_pct"),
        )
    )


def _dimension_order() -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension"))


def rank_drivers(
    shares: DataFrame, per_dimension: int = cat.DRIVERS_PER_DIMENSION, overall: int = cat.DRIVERS_OVERALL
) -> DataFrame:
    """The best few segments of each dimension, then the best of those overall.

    Ranked on the rounded share; ties keep the dimension order and, within one, products
    by revenue, hours by hour, countries by name.
    """
    anomaly = ["kpi_name", "date"]
    size = F.abs("contribution_pct").desc()
    ties = ["segment_order", "segment"]
    within = Window.partitionBy(*anomaly, "dimension").orderBy(size, *ties)
    across = Window.partitionBy(*anomaly).orderBy(size, _dimension_order(), *ties)
    return (
        shares.withColumn("dimension_rank", F.row_number().over(within))
        .where(F.col("dimension_rank") <= per_dimension)
        .withColumn("rank", F.row_number().over(across))
        .where(F.col("rank") <= overall)
    )


def root_cause_all(
    tx: DataFrame,
    anomalies: DataFrame,
    baseline=None,
    full_week: bool = False,
    profile: BaselineProfile | None = None,
) -> DataFrame:
    """Root causes of every point anomaly at once.

    Statuses: ratio KPIs need manual review, an anomaly whose week has no rows has
    insufficient data, everything else is analysed. Two passes over the rows: the baseline
    profile, then all segment metrics. The anomalies are staged first, so that the planner
    knows how small they are when it joins them to the rows.
    """
    points = stage(point_anomalies(anomalies), "point_anomalies")
    is_ratio = F.col("kpi_name").isin(*cat.RATIO_KPIS)
    profile = profile or BaselineProfile(tx, baseline)
    sliceable = points.where(~is_ratio)
    metrics = stage(period_and_baseline(tx, sliceable, profile, full_week), "segment_metrics")

    drivers = (
        rank_drivers(contributions(sliceable, metrics, profile.scale))
        .groupBy("kpi_name", "date")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rank", "dimension", "segment", "actual", "expected", "deviation", "contribution_pct")
                )
            ).alias("drivers"),
            F.array_sort(F.collect_set(F.struct(_dimension_order().alias("o"), "dimension"))).alias("dims"),
        )
    )
    weeks_with_rows = metrics.where("not is_baseline").select(F.col("period").alias("date")).distinct().withColumn(
        "has_rows", F.lit(True)
    )
    status = (
        F.when(is_ratio, "manual_review_required")
        .when(F.col("has_rows").isNull(), "insufficient_data")
        .otherwise("analysed")
    )
    return (
        points.join(weeks_with_rows, "date", "left")
        .join(drivers, ["kpi_name", "date"], "left")
        .select(
            "kpi_name",
            "date",
            F.col("severity").alias("anomaly_severity"),
            F.col("confidence").alias("anomaly_confidence"),
            F.col("deviation").alias("total_deviation"),
            F.col("deviation_pct").alias("total_deviation_pct"),
            status.alias("status"),
            F.coalesce("drivers", F.array().cast(DRIVERS)).alias("drivers"),
            F.coalesce(F.transform("dims", lambda d: d["dimension"]), F.array().cast("array<string>")).alias(
                "dimensions_analysed"
            ),
        )
        .withColumn("summary", _summary())
    )


def _summary() -> Column:
    top = F.try_element_at("drivers", F.lit(1))
    return text.root_cause_sentence(
        F.col("kpi_name"), F.col("date"), F.col("total_deviation_pct"), F.col("total_deviation"), F.col("status"),
        top["dimension"], top["segment"], top["contribution_pct"],
    )


def flatten_drivers(root_causes: DataFrame) -> DataFrame:
    """The flat form: dimension list as text and the first three drivers as columns."""
    columns = {}
    for i in (1, 2, 3):
        driver = F.try_element_at("drivers", F.lit(i))
        for field in ("dimension", "segment", "contribution_pct", "deviation"):
            columns[f"driver_{i}_{field}"] = driver[field]
    return root_causes.select(
        "kpi_name",
        "date",
        "anomaly_severity",
        "anomaly_confidence",
        "total_deviation",
        "total_deviation_pct",
        "status",
        "summary",
        F.array_join("dimensions_analysed", ", ").alias("dimensions_analysed"),
        *[c.alias(n) for n, c in columns.items()],
    )


# Fixed value: the widest contribution the stored column can hold.
_WIDEST = 999999.9999


def explode_drivers(flat: DataFrame) -> DataFrame:
    """Flat rows to one row per driver; a cause without drivers becomes one rank-0 row."""
    def driver(i):
        dimension, segment = F.col(f"driver_{i}_dimension"), F.col(f"driver_{i}_segment")
        clamped = F.greatest(F.lit(-_WIDEST), F.least(F.lit(_WIDEST), F.col(f"driver_{i}_contribution_pct")))
        return F.when(
            dimension.isNotNull() & segment.isNotNull(),
            F.struct(
                dimension.alias("dimension"),
                segment.alias("segment_value"),
                F.when(F.col(f"driver_{i}_contribution_pct").isNotNull(), F.round(clamped, 4)).alias("contribution_pct"),
                F.lit(i).alias("segment_rank"),
            ),
        )

    none = F.struct(
        F.lit(None).cast("string").alias("dimension"),
        F.lit(None).cast("string").alias("segment_value"),
        F.lit(None).cast("double").alias("contribution_pct"),
        F.lit(0).alias("segment_rank"),
    )
    found = F.array_compact(F.array(*[driver(i) for i in (1, 2, 3)]))
    rows = F.when(F.size(found) > 0, found).otherwise(F.array(none))
    return flat.select("kpi_name", F.col("date").alias("anomaly_date"), "status", F.inline(rows))


def status_counts(root_causes: DataFrame) -> DataFrame:
    return root_causes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def explained(root_causes: DataFrame) -> DataFrame:
    return root_causes.where(F.col("status") == "analysed")


def top_segments_preview(root_causes: DataFrame, n: int = 3) -> DataFrame:
    return root_causes.withColumn("drivers", F.slice("drivers", 1, n))


def top_findings(root_causes: DataFrame, n: int = 10) -> DataFrame:
    """The most confident explained causes with their first three drivers."""
    best = explained(root_causes).orderBy(F.desc("anomaly_confidence"), "kpi_name", "date").limit(n)
    return top_segments_preview(best)


def anomaly_transactions(tx: DataFrame, anomalies: DataFrame, full_week: bool = False) -> DataFrame:
    """Every anomaly with the transactions of its week: an equi-join on the week plus a residual."""
    wanted = anomalies.select("kpi_name", "date")
    rows = anomalous_rows(tx, anomalies, full_week)
    return rows.join(wanted, F.col("week_end") == F.col("date")).drop("week_end")


def anomalous_rows(tx: DataFrame, anomalies: DataFrame, full_week: bool = False) -> DataFrame:
    """The transactions of anomalous weeks, once each, with ``week_end``; other stored weeks are not read."""
    week = F.col("week_end")
    rows = with_week_end(tx).where(week.isin(calendar_weeks(anomalies)))
    return rows.where(in_anomaly_week(F.col("InvoiceDate"), week, "W", full_week))


def anomaly_week_totals(tx: DataFrame, anomalies: DataFrame, full_week: bool = False) -> DataFrame:
    """Rows and revenue of every anomaly's week: summed by week first, so no row is multiplied."""
    totals = anomalous_rows(tx, anomalies, full_week).groupBy("week_end").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("Quantity") * F.col("UnitPrice")).cast("double").alias("revenue")
    )
    wanted = anomalies.select("kpi_name", "date")
    return wanted.join(totals, F.col("date") == F.col("week_end")).drop("week_end")


def segment_candidates(rows: DataFrame, products: DataFrame) -> DataFrame:
    """The segments of ``rows``: countries, the listed products and the hours, each once."""
    placed = rows.join(products.select("StockCode", "product_rank"), "StockCode", "left")
    return _named_dimension(placed.select(F.inline(_segment_array(F.col("product_rank")))).select("dimension", "segment").distinct())
