"""The declared KPI catalogue, all-time or per window, in three narrow passes over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope import catalogue as cat
from tillscope.functions import dates
from tillscope.functions.metrics import KpiRef, Ratio, guarded_ratio

# Which measure of ``kpi_measures`` stands behind each non-ratio KPI or ratio numerator.
_KPI_MEASURE = {
    "total_revenue": "revenue",
    "order_count": "orders",
    "units_sold": "units",
    "active_customers": "customers",
    "items_per_order": "units",
    "repeat_customer_rate": "repeat_customers",
    "new_customers": "new_customers",
    "product_revenue_concentration": "top_product_revenue",
    "product_return_rate": "return_orders",
    "revenue_by_country": "revenue",
    "international_revenue_share": "international_revenue",
    "weekend_revenue_share": "weekend_revenue",
    "peak_hour_concentration": "top_hour_revenue",
}


def entity_rollup(rows: DataFrame, keys: list[str], sums: list[str], flags: list[str] = ()) -> DataFrame:
    """Sums, flags and exact distinct invoice/customer counts per key.

    Rows are first reduced to one per (key, invoice, customer), which is where the data
    shrinks; the two distinct counts then come from grouping sets over that small frame.
    Every exchange is on invoice or customer, so a hot key or a hot null customer never
    lands in one task before it has been reduced. Output: one row per (key, facet, entity).
    """
    pairs = rows.groupBy(*keys, "InvoiceNo", "CustomerID").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.bool_or(c).alias(c) for c in flags],
    )
    sets = [[*keys, "InvoiceNo"], [*keys, "CustomerID"]]
    by_invoice = F.grouping("CustomerID") == 1
    return (
        pairs.groupingSets(sets, *keys, "InvoiceNo", "CustomerID")
        .agg(
            by_invoice.alias("by_invoice"),
            *[F.sum(c).alias(c) for c in sums],
            *[F.bool_or(c).alias(c) for c in flags],
            F.count("InvoiceNo").alias("n_invoices"),
        )
        .withColumn(
            "entity_known",
            F.when(F.col("by_invoice"), F.col("InvoiceNo").isNotNull()).otherwise(F.col("CustomerID").isNotNull()),
        )
        .drop("InvoiceNo", "CustomerID")
    )


_SUMS = ["revenue", "units", "international_revenue", "weekend_revenue"]
_FLAGS = ["is_return", "dated"]


def _products(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Revenue by product."""
    return rows.where(F.col("product").isNotNull()).groupBy(*keys, "product").agg(F.sum("revenue").alias("revenue"))


def _hours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The sums by hour, at most 25 rows a key (undated rows have no hour): the totals are made of them, without invoices."""
    return rows.groupBy(*keys, "hour").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _largest_products(products: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = [F.desc("revenue"), F.asc("product")]
    if not keys:
        largest = products.orderBy(*order).limit(n)
    else:
        ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        largest = products.withColumn("rank", ranked).where(F.col("rank") <= n)
    return largest.select(*keys, F.col("revenue").alias("top_product_revenue"))


def _measures(
    rows: DataFrame, products: DataFrame, hours: DataFrame, keys: list[str], top_products: int, top_hours: int, repeat_over: int
) -> DataFrame:
    entities = entity_rollup(rows, keys, [], _FLAGS)
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("hour").isNull(), F.desc("revenue"), "hour"))
    top_hour = F.col("hour").isNotNull() & (ranked <= top_hours)
    totals = hours.withColumn("top_hour_revenue", F.when(top_hour, F.col("revenue"))).drop("hour")

    invoice = F.col("by_invoice")
    customer = ~F.col("by_invoice") & F.col("entity_known")

    def total(column):
        return F.coalesce(F.sum(column).cast("double"), F.lit(0.0)).alias(column)

    def count(condition, name):
        return F.count_if(condition).cast("double").alias(name)

    return (
        entities.unionByName(_largest_products(products, keys, top_products), allowMissingColumns=True)
        .unionByName(totals, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(
            *[total(c) for c in _SUMS],
            count(invoice & F.col("entity_known"), "orders"),
            count(invoice & F.col("entity_known") & F.col("is_return"), "return_orders"),
            count(customer, "customers"),
            count(customer & F.col("dated"), "new_customers"),
            count(customer & (F.col("n_invoices") > repeat_over), "repeat_customers"),
            total("top_product_revenue"),
            total("top_hour_revenue"),
        )
    )


def kpi_measures(
    tx: DataFrame,
    window: str | None = None,
    home_country: str = cat.HOME_COUNTRY,
    date_column: str = "InvoiceDate",
    top_products: int = cat.TOP_PRODUCTS,
    top_hours: int = cat.TOP_HOURS,
    repeat_over: int = cat.REPEAT_ORDERS,
) -> DataFrame:
    """The additive, distinct and top-n measures the KPIs are made of.

    Three passes over the rows: one for the sums and hours, one for the distinct counts, one, two
    columns wide, for the products.
    """
    keys = ["date"] if window else []
    rows = _kpi_rows(tx, window, home_country, date_column)
    if window:
        rows = rows.where(F.col("date").isNotNull())
    return _measures(rows, _products(rows, keys), _hours(rows, keys), keys, top_products, top_hours, repeat_over)


def _kpi_rows(tx: DataFrame, window: str | None, home_country: str, date_column: str) -> DataFrame:
    ts = F.col(date_column)
    value = F.col("Quantity") * F.col("UnitPrice")
    abroad = ~F.col("Country").eqNullSafe(F.lit(home_country))
    weekend = F.dayofweek(ts).isin(1, 7)
    return tx.select(
        *([dates.bucket(ts, window).alias("date")] if window else []),
        "InvoiceNo",
        "CustomerID",
        F.col("StockCode").alias("product"),
        F.hour(ts).alias("hour"),
        value.alias("revenue"),
        F.col("Quantity").cast("bigint").alias("units"),
        F.when(abroad, value).alias("international_revenue"),
        F.when(weekend, value).alias("weekend_revenue"),
        (F.col("Quantity") < 0).alias("is_return"),
        ts.isNotNull().alias("dated"),
    )


def kpi_facts(tx: DataFrame, window: str = "W", home_country: str = cat.HOME_COUNTRY, date_column: str = "InvoiceDate") -> DataFrame:
    """What KPIs per window and over all time have in common, from one pass over the rows.

    Sums per (window, invoice, customer), per (window, product) and per (window, hour); ``kind``
    tells which. Undated rows have a null window, which only the all-time values count.
    """
    rows = _kpi_rows(tx, window, home_country, date_column)
    kind = F.when(F.grouping("product") == 0, "product").when(F.grouping("hour") == 0, "hour").otherwise("entity")
    return rows.groupingSets(
        [["date", "InvoiceNo", "CustomerID"], ["date", "product"], ["date", "hour"]], "date", "InvoiceNo", "CustomerID", "product", "hour"
    ).agg(kind.alias("kind"), *[F.sum(c).alias(c) for c in _SUMS], *[F.bool_or(c).alias(c) for c in _FLAGS])


def kpis_of_facts(
    facts: DataFrame,
    windowed: bool,
    home_country: str = cat.HOME_COUNTRY,
    top_products: int = cat.TOP_PRODUCTS,
    top_hours: int = cat.TOP_HOURS,
    repeat_over: int = cat.REPEAT_ORDERS,
) -> DataFrame:
    """The KPIs of ``kpi_facts``, per window or over all time; the same values as from the rows."""
    keys = ["date"] if windowed else []
    if windowed:
        facts = facts.where(F.col("date").isNotNull())
    parts = {kind: facts.where(F.col("kind") == kind) for kind in ("entity", "product", "hour")}
    products, hours = _products(parts["product"], keys), _hours(parts["hour"], keys)
    measures = _measures(parts["entity"], products, hours, keys, top_products, top_hours, repeat_over)
    return measures.select(*keys, *_kpi_columns(home_country))


def _kpi_columns(home_country: str) -> list:
    """The catalogue's KPIs as projections over ``kpi_measures``."""
    specs = cat.metric_specs(home_country)
    columns: dict[str, object] = {}

    def value(name):
        if name not in columns:
            spec = specs[name]
            if isinstance(spec, Ratio):
                num, den = (
                    value(p.name) if isinstance(p, KpiRef) else F.col(_KPI_MEASURE[name]) for p in spec.parts()
                )
                columns[name] = guarded_ratio(num, den)
            else:
                columns[name] = F.col(_KPI_MEASURE[name])
        return columns[name]

    return [value(name).alias(name) for name in specs]


def kpi_all(tx: DataFrame, cadence: str | None = None, home_country: str = cat.HOME_COUNTRY, **options) -> DataFrame:
    """All KPIs over the whole table, one row.

    ``cadence`` keeps only the KPIs of that cadence. Their dependencies are still
    computed, so a weekly ratio over daily KPIs keeps its value.
    """
    names = [k.name for k in cat.KPIS if cadence in (None, k.cadence)]
    out = kpi_measures(tx, None, home_country, **options).select(*_kpi_columns(home_country))
    return out.select(*names)


def kpi_windowed(tx: DataFrame, window: str = "W", home_country: str = cat.HOME_COUNTRY, **options) -> DataFrame:
    """One row per non-empty week (dated by its Sunday) or day, one column per KPI."""
    measures = kpi_measures(tx, window, home_country, **options)
    return measures.select("date", *_kpi_columns(home_country))


def revenue_by_country(tx: DataFrame, window: str = "W") -> DataFrame:
    """The per-country breakdown that the scalar KPI of that name stands for."""
    return (
        tx.groupBy(dates.bucket(F.col("InvoiceDate"), window).alias("date"), F.col("Country").alias("country"))
        .agg(F.sum(F.col("Quantity") * F.col("UnitPrice")).cast("double").alias("revenue"))
    )


def first_seen_customers(tx: DataFrame, window: str = "W") -> DataFrame:
    """New customers per window judged against the whole history, not the window itself."""
    return (
        tx.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(F.min("InvoiceDate").alias("first_order"))
        .groupBy(dates.bucket(F.col("first_order"), window).alias("date"))
        .agg(F.count(F.lit(1)).cast("double").alias("new_customers"))
    )


def unpivot_kpis(wide: DataFrame, date_column: str = "date", date_as: str = "date") -> DataFrame:
    """Wide KPI rows to ``(kpi_name, date, value)``; null values are dropped."""
    names = [c for c in wide.columns if c != date_column]
    return (
        wide.unpivot([date_column], names, "kpi_name", "value")
        .select("kpi_name", F.col(date_column).alias(date_as), "value")
        .where(F.col("value").isNotNull())
    )


def append_history(history: DataFrame, results: DataFrame, stamp=None) -> DataFrame:
    """Stamped KPI rows added to the history; a column missing on one side is null there."""
    stamp = F.current_timestamp() if stamp is None else stamp
    stamped = results.withColumns({"timestamp": stamp, "calculation_date": F.to_date(stamp)})
    return history.unionByName(stamped, allowMissingColumns=True)
