"""Declared KPIs, labels, thresholds and contract limits."""

from __future__ import annotations

from dataclasses import dataclass

from tillscope.functions.literals import literal_frame
from tillscope.functions.metrics import (
    CountDistinct,
    EntitiesOver,
    FirstSeen,
    KpiRef,
    Ratio,
    Sum,
    TopNSum,
    compare,
    is_in,
    not_equal,
)

# The home market, the weekend, and the sizes of the two top-n metrics.
HOME_COUNTRY = "United Kingdom"
WEEKEND = ("Saturday", "Sunday")
TOP_PRODUCTS = 20
TOP_HOURS = 3
REPEAT_ORDERS = 1


def metric_specs(home_country: str = HOME_COUNTRY) -> dict[str, object]:
    """The 16 declared KPIs as typed metric specs, in declaration order."""
    revenue = ("Quantity", "UnitPrice")
    total = KpiRef("total_revenue")
    orders = KpiRef("order_count")
    active = KpiRef("active_customers")
    return {
        "total_revenue": Sum(*revenue),
        "order_count": CountDistinct("InvoiceNo"),
        "units_sold": Sum("Quantity"),
        "active_customers": CountDistinct("CustomerID"),
        "revenue_per_order": Ratio(total, orders),
        "revenue_per_customer": Ratio(total, active),
        "items_per_order": Ratio(Sum("Quantity"), orders),
        "avg_unit_price": Ratio(total, KpiRef("units_sold")),
        "repeat_customer_rate": Ratio(
            EntitiesOver("CustomerID", "InvoiceNo", REPEAT_ORDERS), active
        ),
        "new_customers": FirstSeen("CustomerID", "InvoiceDate"),
        "product_revenue_concentration": Ratio(TopNSum("StockCode", TOP_PRODUCTS), total),
        "product_return_rate": Ratio(
            CountDistinct("InvoiceNo", where=compare("Quantity", "<", 0)), orders
        ),
        "revenue_by_country": Sum(*revenue),
        "international_revenue_share": Ratio(
            Sum(*revenue, where=not_equal("Country", home_country)), total
        ),
        "weekend_revenue_share": Ratio(Sum(*revenue, where=is_in("DayOfWeek", *WEEKEND)), total),
        "peak_hour_concentration": Ratio(TopNSum("HourOfDay", TOP_HOURS), total),
    }


@dataclass(frozen=True)
class Kpi:
    name: str
    label: str
    owner: str
    cadence: str
    level: str
    category: str | None


@dataclass(frozen=True)
class Watch:
    """How far a KPI may move before it is worth a look, and the columns it is broken down by."""

    sensitivity: float
    dimensions: tuple[str, ...] = ()
    critical_drop: float | None = None
    critical_spike: float | None = None


# Sensitivity, breakdowns and critical moves per KPI.
WATCHES = {
    "total_revenue": Watch(0.05, ("Country", "ProductCategory", "CustomerSegment"), critical_drop=0.15),
    "order_count": Watch(0.07, ("Country", "DayOfWeek", "HourOfDay"), critical_drop=0.20),
    "units_sold": Watch(0.08, ("StockCode", "ProductCategory")),
    "active_customers": Watch(0.06, ("Country", "CustomerType"), critical_drop=0.15),
    "revenue_per_order": Watch(0.08, ("Country", "DayOfWeek"), critical_drop=0.20),
    "revenue_per_customer": Watch(0.10, ("CustomerTier", "AcquisitionChannel")),
    "items_per_order": Watch(0.10, ("Country", "CustomerSegment")),
    "avg_unit_price": Watch(0.08, ("ProductCategory", "Country")),
    "repeat_customer_rate": Watch(0.10, ("Country", "AcquisitionCohort")),
    "new_customers": Watch(0.15, ("Country", "AcquisitionChannel")),
    "product_revenue_concentration": Watch(0.05, ("ProductCategory",)),
    "product_return_rate": Watch(0.10, ("StockCode", "Country"), critical_spike=0.15),
    "revenue_by_country": Watch(0.12, ("Country",)),
    "international_revenue_share": Watch(0.08, ("Region",)),
    "weekend_revenue_share": Watch(0.10),
    "peak_hour_concentration": Watch(0.08),
}


# Name, dashboard label, owner, cadence, aggregation level, overview category.
KPIS = [
    Kpi("total_revenue", "Total Revenue", "Finance", "daily", "transaction", "Finance"),
    Kpi("order_count", "Order Count", "Operations", "daily", "transaction", "Operations"),
    Kpi("units_sold", "Units Sold", "Operations", "daily", "product", "Operations"),
    Kpi("active_customers", "Active Customers", "Growth", "daily", "customer", "Growth"),
    Kpi("revenue_per_order", "Revenue per Order", "Product", "daily", "transaction", "Finance"),
    Kpi("revenue_per_customer", "Revenue per Customer", "Product", "weekly", "customer", "Finance"),
    Kpi("items_per_order", "Items per Order", "Product", "daily", "transaction", "Operations"),
    Kpi("avg_unit_price", "Avg Unit Price", "Pricing", "weekly", "product", "Product"),
    Kpi("repeat_customer_rate", "Repeat Customer Rate", "Retention", "weekly", "customer", "Growth"),
    Kpi("new_customers", "New Customers", "Growth", "weekly", "customer", "Growth"),
    Kpi("product_revenue_concentration", "Product Revenue Concentration", "Product", "weekly", "product", "Product"),
    Kpi("product_return_rate", "Product Return Rate", "Operations", "weekly", "transaction", "Operations"),
    Kpi("revenue_by_country", "Revenue by Country", "International", "weekly", "geography", None),
    Kpi("international_revenue_share", "International Revenue Share", "International", "weekly", "geography", "International"),
    Kpi("weekend_revenue_share", "Weekend Revenue Share", "Operations", "weekly", "temporal", "Operations"),
    Kpi("peak_hour_concentration", "Peak Hour Concentration", "Operations", "daily", "temporal", "Operations"),
]
KPI_NAMES = [k.name for k in KPIS]

# Documents and prompts spell one label out and leave two KPIs unlabelled.
DOCUMENT_LABELS = {
    **{k.name: k.label for k in KPIS if k.name not in ("new_customers", "revenue_by_country")},
    "avg_unit_price": "Average Unit Price",
}

# How a KPI is displayed.
CURRENCY_KPIS = ("total_revenue", "revenue_per_order", "revenue_per_customer", "avg_unit_price")
PERCENT_KPIS = (
    "repeat_customer_rate",
    "product_revenue_concentration",
    "product_return_rate",
    "international_revenue_share",
    "weekend_revenue_share",
    "peak_hour_concentration",
)

# Series that detection skips, and KPIs attribution cannot slice by segment.
SKIPPED_IN_DETECTION = ("new_customers", "revenue_by_country")
RATIO_KPIS = PERCENT_KPIS + (
    "avg_unit_price",
    "revenue_per_order",
    "revenue_per_customer",
    "items_per_order",
)

# Detection defaults.
ZSCORE_THRESHOLD = 2.5
IQR_MULTIPLIER = 1.5
TREND_SIGNIFICANCE = 0.05
MIN_POINTS = 7
MIN_TREND_POINTS = 10
MIN_BASELINE_POINTS = 5

# Attribution limits.
TOP_SEGMENT_PRODUCTS = 20
MIN_CONTRIBUTION_PCT = 2.0
DRIVERS_PER_DIMENSION = 5
DRIVERS_OVERALL = 10

# Call cost in USD per million tokens and limits on generated text.
COST_PER_M_INPUT = 0.05
COST_PER_M_OUTPUT = 0.08
MIN_TEXT_CHARS = 50
MAX_TEXT_CHARS = 600
MAX_TEXT_SENTENCES = 6

# The data contract.
COMPLETENESS_LIMITS = {
    "InvoiceNo": 0.0,
    "InvoiceDate": 0.0,
    "StockCode": 0.0,
    "Description": 0.05,
    "Quantity": 0.0,
    "UnitPrice": 0.0,
    "CustomerID": 0.25,
    "Country": 0.0,
}
VALUE_RANGES = {"Quantity": (-10000, 10000), "UnitPrice": (0.0, 10000.0)}
MAX_TRANSACTION_VALUE = 100000
PATTERNS = {"InvoiceNo": "^[C]?[0-9]{6}$", "CustomerID": "^[0-9]{5}$"}
MAX_LENGTHS = {"StockCode": 20, "Description": 500}
DATE_BOUNDS = ("2010-01-01", "2026-12-31")
MAX_ZERO_PRICE_SHARE = 0.02
MAX_DUPLICATE_RATE = 0.01
MAX_GAP_DAYS = 7
MIN_DAILY_ROWS, WARN_DAILY_ROWS = 100, 500
MIN_QUALITY_SCORE, WARN_QUALITY_SCORE = 0.95, 0.98
MAX_DELAY_HOURS = 24
SEVERITIES = ("low", "medium", "high", "critical")


def kpi_catalogue(spark):
    """The catalogue as a 16-row frame."""
    return literal_frame(
        spark,
        [(k.name, k.label, k.owner, k.cadence, k.level, k.category) for k in KPIS],
        ["kpi_name", "label", "owner", "cadence", "level", "category"],
    )


def kpi_watches(spark):
    """Sensitivity, critical moves and breakdowns per KPI."""
    return literal_frame(
        spark,
        [(n, w.sensitivity, w.critical_drop, w.critical_spike, ",".join(w.dimensions)) for n, w in WATCHES.items()],
        ["kpi_name", "sensitivity", "critical_drop", "critical_spike", "dimensions"],
    )
