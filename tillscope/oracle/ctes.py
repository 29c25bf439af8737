"""Named DuckDB building blocks for the oracle queries, in dependency order."""

from __future__ import annotations

import re

HOME = "NATION_2"
BASE_START, BASE_END = "1996-01-01", "1998-12-31"

# name -> body; only the ones a query needs (directly or through others) are emitted.
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def build(select: str) -> str:
    """``WITH`` the needed blocks, in order, then ``select``."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(select)
    parts = [f"{n} AS MATERIALIZED (\n{b}\n)" for n, b in CTES.items() if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select.strip()


def rounding(columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


# --------------------------------------------------------------------- transactions

cte(
    "tx",
    """
SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS InvoiceNo,
       o_orderdate + to_hours(CAST((o_orderkey * 7) % 24 AS INT)) AS InvoiceDate,
       lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS StockCode,
       p_name AS Description,
       CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS INT) AS Quantity,
       CAST(p_retailprice AS DECIMAL(10,4)) AS UnitPrice,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE lpad(CAST(o_custkey AS VARCHAR), 5, '0') END AS CustomerID,
       n_name AS Country
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN part ON l_partkey = p_partkey
""",
)
cte(
    "txd",
    """
SELECT *, Quantity * UnitPrice AS v, dayname(InvoiceDate) AS DayOfWeek, CAST(hour(InvoiceDate) AS INTEGER) AS HourOfDay,
       CAST(date_trunc('week', InvoiceDate) AS DATE) + 6 AS week_end, CAST(InvoiceDate AS DATE) AS day
FROM tx
""",
)

# Fixed values.
KPI_NAMES = [
    "total_revenue", "order_count", "units_sold", "active_customers", "revenue_per_order", "revenue_per_customer",
    "items_per_order", "avg_unit_price", "repeat_customer_rate", "new_customers", "product_revenue_concentration",
    "product_return_rate", "revenue_by_country", "international_revenue_share", "weekend_revenue_share",
    "peak_hour_concentration",
]


def _kpi_blocks(name: str, key: str) -> None:
    cte(
        f"{name}_main",
        f"""
SELECT {key} AS date, CAST(sum(v) AS DOUBLE) AS rev, CAST(count(DISTINCT InvoiceNo) AS DOUBLE) AS orders,
       CAST(sum(Quantity) AS DOUBLE) AS units, CAST(count(DISTINCT CustomerID) AS DOUBLE) AS customers,
       CAST(coalesce(sum(v) FILTER (Country IS DISTINCT FROM '{HOME}'), 0) AS DOUBLE) AS intl,
       CAST(coalesce(sum(v) FILTER (DayOfWeek IN ('Saturday', 'Sunday')), 0) AS DOUBLE) AS weekend,
       CAST(count(DISTINCT CASE WHEN Quantity < 0 THEN InvoiceNo END) AS DOUBLE) AS returned
FROM txd GROUP BY 1
""",
    )
    cte(
        f"{name}_repeat",
        f"""
SELECT date, CAST(count(*) FILTER (n > 1) AS DOUBLE) AS repeaters, CAST(count(*) AS DOUBLE) AS first_seen
FROM (SELECT {key} AS date, CustomerID, count(DISTINCT InvoiceNo) AS n FROM txd WHERE CustomerID IS NOT NULL GROUP BY 1, 2)
GROUP BY 1
""",
    )
    for block, column, n in (("products", "StockCode", 20), ("hours", "HourOfDay", 3)):
        cte(
            f"{name}_{block}",
            f"""
SELECT date, CAST(sum(r) AS DOUBLE) AS top FROM (
  SELECT date, r, row_number() OVER (PARTITION BY date ORDER BY r DESC, k) AS rn
  FROM (SELECT {key} AS date, {column} AS k, sum(v) AS r FROM txd GROUP BY 1, 2))
WHERE rn <= {n} GROUP BY 1
""",
        )

    def ratio(num, den):
        return f"CASE WHEN {den} = 0 THEN 0.0 ELSE {num} / {den} END"

    cte(
        name,
        f"""
SELECT m.date, rev AS total_revenue, orders AS order_count, units AS units_sold, customers AS active_customers,
       {ratio('rev', 'orders')} AS revenue_per_order, {ratio('rev', 'customers')} AS revenue_per_customer,
       {ratio('units', 'orders')} AS items_per_order, {ratio('rev', 'units')} AS avg_unit_price,
       {ratio('coalesce(repeaters, 0.0)', 'customers')} AS repeat_customer_rate,
       coalesce(first_seen, 0.0) AS new_customers,
       {ratio('p.top', 'rev')} AS product_revenue_concentration, {ratio('returned', 'orders')} AS product_return_rate,
       rev AS revenue_by_country, {ratio('intl', 'rev')} AS international_revenue_share,
       {ratio('weekend', 'rev')} AS weekend_revenue_share, {ratio('h.top', 'rev')} AS peak_hour_concentration
FROM {name}_main m LEFT JOIN {name}_repeat USING (date) LEFT JOIN {name}_products p USING (date)
     LEFT JOIN {name}_hours h USING (date)
""",
    )


_kpi_blocks("weekly", "week_end")
_kpi_blocks("daily", "day")
_kpi_blocks("alltime", "DATE '2000-01-01'")

cte("series", "SELECT kpi_name, date, value FROM (UNPIVOT weekly ON COLUMNS(* EXCLUDE (date)) INTO NAME kpi_name VALUE value)")
cte("latest", "SELECT kpi_name, value FROM (UNPIVOT alltime ON COLUMNS(* EXCLUDE (date)) INTO NAME kpi_name VALUE value)")
cte("positioned", "SELECT *, CAST(row_number() OVER (PARTITION BY kpi_name ORDER BY date) - 1 AS INTEGER) AS position FROM series")
cte("drifted", "SELECT kpi_name, date, value * (1 + position / 500.0) AS value FROM positioned")

# ------------------------------------------------------------------------ detection


def _statistics(name: str, source: str, start: str, end: str) -> None:
    inside = f"FILTER (date BETWEEN DATE '{start}' AND DATE '{end}')"
    q = "quantile_cont(value, [0.25, 0.5, 0.75])"
    cte(
        name,
        f"""
SELECT kpi_name, n_points, n_baseline,
       CASE WHEN n_baseline >= 5 THEN bm ELSE am END AS mean, CASE WHEN n_baseline >= 5 THEN bs ELSE as_ END AS std,
       CASE WHEN n_baseline >= 5 THEN bq[1] ELSE aq[1] END AS q1, CASE WHEN n_baseline >= 5 THEN bq[2] ELSE aq[2] END AS median,
       CASE WHEN n_baseline >= 5 THEN bq[3] ELSE aq[3] END AS q3
FROM (SELECT kpi_name, count(*) AS n_points, count(*) {inside} AS n_baseline, avg(value) AS am, stddev_samp(value) AS as_, {q} AS aq,
             avg(value) {inside} AS bm, stddev_samp(value) {inside} AS bs, {q} {inside} AS bq
      FROM {source} GROUP BY 1)
""",
    )


# Severity steps.
SEVERITY_Z = "CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3 THEN 'high' WHEN abs(z) >= 2.5 THEN 'medium' ELSE 'low' END"
SEVERITY_IQR = "CASE WHEN reach >= 3 THEN 'critical' WHEN reach >= 2.5 THEN 'high' WHEN reach >= 2 THEN 'medium' ELSE 'low' END"
SEVERITY_TREND = (
    "CASE WHEN abs(z) >= 2.5758293035489004 THEN CASE WHEN abs(slope) > 0.05 THEN 'high' ELSE 'medium' END "
    "WHEN abs(z) >= 1.959963984540054 THEN CASE WHEN abs(slope) > 0.02 THEN 'medium' ELSE 'low' END ELSE 'low' END"
)
SIDE = "CASE WHEN {0} > 0 THEN 'above' ELSE 'below' END"


def anomaly_text(method: str) -> str:
    return (
        "kpi_name || ' was ' || format('{:.1f}', abs(deviation_pct)) || '% ' || " + SIDE.format("deviation")
        + " || ' expected on ' || strftime(date, '%Y-%m-%d') || ' (actual: ' || format('{:,.2f}', actual_value) || ', expected: ' || "
        + f"format('{{:,.2f}}', expected_value) || ') — detected by {method} with ' || "
        + "CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '% confidence'"
    )


def zscore_sql(source: str, stats: str, threshold: float) -> str:
    return f"""
SELECT *, {anomaly_text('zscore')} AS description FROM (
  SELECT kpi_name, date, value AS actual_value, mean AS expected_value, value - mean AS deviation,
         CASE WHEN mean <> 0 THEN (value - mean) / mean * 100 ELSE 0 END AS deviation_pct, 'zscore' AS method,
         {SEVERITY_Z} AS severity, round(least(0.99, 0.5 + (abs(z) - {threshold}) * 0.15), 3) AS confidence, round(z, 4) AS stat_value
  FROM (SELECT *, (value - mean) / std AS z FROM {source} JOIN {stats} USING (kpi_name) WHERE n_points >= 7 AND std <> 0)
  WHERE abs(z) >= {threshold})"""


def iqr_sql(source: str, stats: str, multiplier: float) -> str:
    return f"""
SELECT *, {anomaly_text('iqr')} AS description FROM (
  SELECT kpi_name, date, value AS actual_value, median AS expected_value, value - median AS deviation,
         CASE WHEN median <> 0 THEN (value - median) / median * 100 ELSE 0 END AS deviation_pct, 'iqr' AS method,
         {SEVERITY_IQR} AS severity, round(least(0.99, 0.5 + distance * 0.2), 3) AS confidence, round(reach, 4) AS stat_value
  FROM (SELECT *, {multiplier} + distance AS reach FROM (
    SELECT *, CASE WHEN value > hi THEN (value - hi) / iqr ELSE (lo - value) / iqr END AS distance FROM (
      SELECT *, q3 - q1 AS iqr, q1 - {multiplier} * (q3 - q1) AS lo, q3 + {multiplier} * (q3 - q1) AS hi
      FROM {source} JOIN {stats} USING (kpi_name) WHERE n_points >= 7 AND q3 <> q1)
    WHERE value < lo OR value > hi)))"""


def _trend_statistics(name: str, source: str) -> None:
    cte(
        f"{name}_ordered",
        f"SELECT kpi_name, date, value, row_number() OVER (PARTITION BY kpi_name ORDER BY date) - 1 AS i FROM {source}",
    )
    cte(
        f"{name}_pairs",
        f"""
SELECT a.kpi_name, sum(sign(b.value - a.value)) AS s, count(*) FILTER (b.value > a.value) AS concordant,
       count(*) FILTER (b.value < a.value) AS discordant, count(*) FILTER (b.value = a.value) AS tied, count(*) AS pairs,
       median((b.value - a.value) / (b.i - a.i)) AS slope
FROM {name}_ordered a JOIN {name}_ordered b ON a.kpi_name = b.kpi_name AND a.i < b.i GROUP BY 1
""",
    )
    cte(
        name,
        f"""
SELECT *, CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0.0 END AS z FROM (
  SELECT p.*, b.n, b.mean, b.last_date, b.last_value, (b.n * (b.n - 1) * (2 * b.n + 5) - t.ties) / 18.0 AS var_s
  FROM {name}_pairs p
  JOIN (SELECT kpi_name, count(*) AS n, avg(value) AS mean, max(date) AS last_date, arg_max(value, date) AS last_value
        FROM {source} GROUP BY 1) b USING (kpi_name)
  JOIN (SELECT kpi_name, sum(c * (c - 1) * (2 * c + 5)) AS ties
        FROM (SELECT kpi_name, value, count(*) AS c FROM {source} GROUP BY 1, 2) GROUP BY 1) t USING (kpi_name))
""",
    )


# Two-tailed normal tail by the Abramowitz-Stegun rational form (error below 2e-7).
_T = "(1 / (1 + 0.3275911 * (abs(z) / sqrt(2))))"
P_VALUE = (
    f"({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))))"
    " * exp(-(z * z) / 2)"
)


def trend_sql(stats: str, critical_z: float = 1.959963984540054) -> str:
    return f"""
SELECT kpi_name, date, actual_value, expected_value, deviation, deviation_pct, 'mann_kendall' AS method, severity, confidence, stat_value,
       kpi_name || ' shows a statistically significant ' || CASE WHEN s > 0 THEN 'upward' ELSE 'downward' END
       || ' trend (p=' || format('{{:.3f}}', p) || ', slope=' || format('{{:.4f}}', slope) || ' per period). Current value '
       || format('{{:,.2f}}', actual_value) || ' vs series mean ' || format('{{:,.2f}}', expected_value) || '.' AS description
FROM (SELECT kpi_name, last_date AS date, last_value AS actual_value, mean AS expected_value, last_value - mean AS deviation,
             CASE WHEN mean <> 0 THEN (last_value - mean) / mean * 100 ELSE 0 END AS deviation_pct, {SEVERITY_TREND} AS severity,
             round(least(0.99, 1 - p), 3) AS confidence, round(z, 4) AS stat_value, s, p, slope
      FROM (SELECT *, {P_VALUE} AS p FROM {stats}) WHERE n >= 10 AND var_s > 0 AND s <> 0 AND abs(z) >= {critical_z})"""


def merge_sql(source: str) -> str:
    return f"""
SELECT kpi_name, date, actual_value, expected_value, deviation, deviation_pct,
       CASE WHEN n > 1 THEN 'zscore_and_iqr' ELSE method END AS method, severity,
       CASE WHEN n > 1 THEN round(least(0.99, confidence + 0.1), 3) ELSE confidence END AS confidence, stat_value,
       CASE WHEN n > 1 THEN description || ' [Confirmed by 2 methods: zscore, iqr]' ELSE description END AS description
FROM (SELECT *, count(*) OVER (PARTITION BY kpi_name, date) AS n,
             row_number() OVER (PARTITION BY kpi_name, date ORDER BY confidence DESC, method DESC) AS rn
      FROM {source} WHERE method <> 'mann_kendall')
WHERE rn = 1
UNION ALL BY NAME SELECT * FROM {source} WHERE method = 'mann_kendall'"""


WATCHED = "(SELECT * FROM {0} WHERE kpi_name NOT IN ('new_customers', 'revenue_by_country'))"
cte("watched", "SELECT * FROM series WHERE kpi_name NOT IN ('new_customers', 'revenue_by_country')")
cte("watched_drift", "SELECT * FROM drifted WHERE kpi_name NOT IN ('new_customers', 'revenue_by_country')")
_statistics("stats", "series", BASE_START, BASE_END)
_statistics("drift_stats", "drifted", BASE_START, BASE_END)
_statistics("short_stats", "series", "1996-01-01", "1996-01-14")
_trend_statistics("trends", "series")
_trend_statistics("drift_trends", "drifted")
_trend_statistics("watched_trends", "watched")
_trend_statistics("watched_drift_trends", "watched_drift")
cte("both_points", zscore_sql("watched", "stats", 2.5) + "\nUNION ALL" + iqr_sql("watched", "stats", 1.5))
cte("detections", "SELECT * FROM both_points UNION ALL BY NAME" + trend_sql("watched_trends"))
cte("anomalies", merge_sql("detections"))
cte(
    "drift_detections",
    zscore_sql("watched_drift", "drift_stats", 2.5) + "\nUNION ALL" + iqr_sql("watched_drift", "drift_stats", 1.5)
    + "\nUNION ALL BY NAME" + trend_sql("watched_drift_trends"),
)
cte("with_trends", merge_sql("drift_detections"))
cte("mixed_detections", "SELECT * FROM both_points UNION ALL BY NAME" + trend_sql("drift_trends"))

# ---------------------------------------------------------------------- attribution

RATIO_KPIS = (
    "('repeat_customer_rate', 'product_revenue_concentration', 'product_return_rate', 'international_revenue_share', "
    "'weekend_revenue_share', 'peak_hour_concentration', 'avg_unit_price', 'revenue_per_order', 'revenue_per_customer', 'items_per_order')"
)
cte("base_rows", f"SELECT * FROM txd WHERE InvoiceDate BETWEEN TIMESTAMP '{BASE_START}' AND TIMESTAMP '{BASE_END}'")
cte("base_scale", "SELECT 7.0::DOUBLE / (date_diff('second', min(InvoiceDate), max(InvoiceDate)) // 86400 + 1) AS scale FROM base_rows")
cte(
    "top20",
    "SELECT StockCode, row_number() OVER (ORDER BY sum(v) DESC, StockCode) AS pos, sum(v) AS revenue FROM base_rows "
    "GROUP BY 1 QUALIFY pos <= 20",
)
_METRICS = """CAST(sum(v) AS DOUBLE) AS revenue, CAST(count(DISTINCT InvoiceNo) AS DOUBLE) AS orders, CAST(sum(Quantity) AS DOUBLE) AS units,
       CAST(count(DISTINCT CustomerID) AS DOUBLE) AS customers"""


def segments_sql(rows: str, keys: str = "", products: bool = True) -> str:
    stock = "JOIN top20 USING (StockCode)" if products else ""
    pos = "min(pos)" if products else "0"
    group = "ALL"
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}'Country' AS dimension, Country AS segment, 0 AS so, {_METRICS} FROM {rows} GROUP BY {lead}Country
UNION ALL SELECT {lead}'StockCode', StockCode, {pos}, {_METRICS} FROM {rows} {stock} GROUP BY {lead}StockCode
UNION ALL SELECT {lead}'HourOfDay', CAST(HourOfDay AS VARCHAR), HourOfDay, {_METRICS} FROM {rows} GROUP BY {lead}HourOfDay"""


cte("base_segments", segments_sql("base_rows"))
cte("week_rows", "SELECT * FROM txd WHERE InvoiceDate <= CAST(week_end AS TIMESTAMP)")
cte("week_segments", segments_sql("week_rows", "week_end"))
cte("whole_week_segments", segments_sql("txd", "week_end"))

PICK = "CASE kpi_name WHEN 'order_count' THEN {0}.orders WHEN 'units_sold' THEN {0}.units WHEN 'active_customers' THEN {0}.customers ELSE {0}.revenue END"


def _causes(suffix: str, segments: str, rows: str) -> None:
    cte(
        f"shares{suffix}",
        f"""
SELECT kpi_name, date, dimension, segment, so, round(actual, 2) AS actual, round(expected, 2) AS expected,
       round(actual - expected, 2) AS deviation, round(share, 1) AS contribution_pct
FROM (SELECT *, CASE WHEN total = 0 THEN NULL ELSE (actual - expected) / total * 100 END AS share FROM (
  SELECT a.kpi_name, a.date, a.deviation AS total, b.dimension, b.segment, b.so, coalesce({PICK.format('w')}, 0.0) AS actual,
         {PICK.format('b')} * scale AS expected
  FROM anomalies a CROSS JOIN base_segments b CROSS JOIN base_scale
  LEFT JOIN {segments} w ON w.week_end = a.date AND w.dimension = b.dimension AND w.segment = b.segment
  WHERE a.method NOT LIKE '%mann_kendall%' AND a.kpi_name NOT IN {RATIO_KPIS}))
WHERE abs(share) >= 2.0
""",
    )
    cte(
        f"ranked{suffix}",
        f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY kpi_name, date ORDER BY abs(contribution_pct) DESC, dim, so, segment) AS rank FROM (
    SELECT *, CASE dimension WHEN 'Country' THEN 1 WHEN 'StockCode' THEN 2 ELSE 3 END AS dim,
           row_number() OVER (PARTITION BY kpi_name, date, dimension ORDER BY abs(contribution_pct) DESC, so, segment) AS dr
    FROM shares{suffix}) WHERE dr <= 5)
WHERE rank <= 10
""",
    )
    cte(
        f"drivers{suffix}",
        f"""
SELECT kpi_name, date, string_agg(dimension || '=' || segment || ':' || format('{{:.1f}}', contribution_pct), '; ' ORDER BY rank) AS drivers,
       string_agg(dimension || '=' || segment || ':' || format('{{:.1f}}', contribution_pct), '; ' ORDER BY rank) FILTER (rank <= 3) AS first_three,
       list(struct_pack(d := dimension, s := segment, p := contribution_pct, v := deviation) ORDER BY rank) AS parts
FROM ranked{suffix} GROUP BY 1, 2
""",
    )
    cte(
        f"dims{suffix}",
        f"SELECT kpi_name, date, string_agg(dimension, ', ' ORDER BY dim) AS dims FROM (SELECT DISTINCT kpi_name, date, dimension, dim FROM ranked{suffix}) GROUP BY 1, 2",
    )
    cte(
        f"causes{suffix}",
        f"""
SELECT kpi_name, date, anomaly_severity, anomaly_confidence, total_deviation, total_deviation_pct, status, drivers, first_three, parts, dimensions_analysed,
  CASE WHEN status = 'analysed' AND parts IS NOT NULL THEN
         kpi_name || ' was ' || format('{{:.1f}}', abs(total_deviation_pct)) || '% ' || {SIDE.format('total_deviation')} || ' expected on '
         || strftime(date, '%Y-%m-%d') || '. Primary driver: ' || parts[1].d || '=' || parts[1].s || ' accounted for '
         || format('{{:.1f}}', parts[1].p) || '% of the deviation.'
       WHEN status = 'manual_review_required' THEN
         kpi_name || ' anomaly on ' || strftime(date, '%Y-%m-%d') || ' requires manual investigation - ratio KPI cannot be directly segmented.'
       ELSE '' END AS summary
FROM (
  SELECT a.kpi_name, a.date, a.severity AS anomaly_severity, a.confidence AS anomaly_confidence, a.deviation AS total_deviation,
         a.deviation_pct AS total_deviation_pct,
         CASE WHEN a.kpi_name IN {RATIO_KPIS} THEN 'manual_review_required'
              WHEN a.date NOT IN (SELECT week_end FROM {rows}) THEN 'insufficient_data' ELSE 'analysed' END AS status,
         coalesce(d.drivers, '') AS drivers, coalesce(d.first_three, '') AS first_three, d.parts, coalesce(g.dims, '') AS dimensions_analysed
  FROM anomalies a LEFT JOIN drivers{suffix} d USING (kpi_name, date) LEFT JOIN dims{suffix} g USING (kpi_name, date)
  WHERE a.method NOT LIKE '%mann_kendall%')
""",
    )


_causes("", "week_segments", "week_rows")
_causes("_whole", "whole_week_segments", "txd")

DRIVER_COLUMNS = ", ".join(
    f"parts[{i}].d AS driver_{i}_dimension, parts[{i}].s AS driver_{i}_segment, parts[{i}].p AS driver_{i}_contribution_pct, "
    f"parts[{i}].v AS driver_{i}_deviation"
    for i in (1, 2, 3)
)
cte(
    "flat",
    f"SELECT kpi_name, date, anomaly_severity, anomaly_confidence, total_deviation, total_deviation_pct, status, summary, dimensions_analysed, {DRIVER_COLUMNS} FROM causes",
)
cte(
    "exploded",
    """
SELECT kpi_name, date AS anomaly_date, status, d.d AS dimension, d.s AS segment_value,
       round(greatest(-999999.9999, least(999999.9999, d.p)), 4) AS contribution_pct, CAST(r AS INTEGER) AS segment_rank
FROM (SELECT kpi_name, date, status, unnest(parts[1:3]) AS d, unnest(range(1, len(parts[1:3]) + 1)) AS r FROM causes WHERE parts IS NOT NULL)
UNION ALL SELECT kpi_name, date, status, NULL, NULL, NULL, 0 FROM causes WHERE parts IS NULL
""",
)

# --------------------------------------------------------------------- stored tables

cte(
    "anomaly_table",
    """
SELECT CAST(row_number() OVER (ORDER BY kpi_name, date) AS INTEGER) AS id, kpi_name, date AS anomaly_date, severity, confidence, actual_value, expected_value,
       deviation_pct, CASE WHEN deviation_pct IS NULL THEN NULL WHEN deviation_pct > 0 THEN 'above' ELSE 'below' END AS direction, method AS detection_methods
FROM (SELECT * FROM anomalies QUALIFY row_number() OVER (PARTITION BY kpi_name, date ORDER BY confidence DESC, method) = 1)
""",
)
cte("cause_table", "SELECT id AS anomaly_id, e.* FROM exploded e LEFT JOIN anomaly_table a USING (kpi_name, anomaly_date)")
cte("keyed", "SELECT *, kpi_name || '_' || strftime(date, '%Y-%m-%d') AS key FROM flat")
cte(
    "entries",
    """
SELECT key, kpi_name, date, anomaly_severity AS severity, summary AS narrative FROM keyed WHERE status = 'analysed'
""",
)
cte("narratives", "SELECT *, 'v2' AS prompt_version FROM entries WHERE severity IN ('high', 'critical')")
cte(
    "rag_narratives",
    "SELECT *, 'v2-rag' AS prompt_version, CASE WHEN severity <> 'medium' THEN kpi_name || '_' || strftime(date, '%Y-%m-%d') END AS context "
    "FROM entries WHERE severity <> 'high'",
)
cte(
    "raw",
    """
SELECT InvoiceNo AS invoice_no, StockCode AS stock_code, Description AS description, Quantity AS quantity, InvoiceDate AS invoice_date,
       UnitPrice AS unit_price, CAST(CAST(CustomerID AS BIGINT) AS VARCHAR) AS customer_id, Country AS country FROM tx
""",
)
cte(
    "stg",
    "SELECT *, quantity * unit_price AS line_total, CAST(date_trunc('week', invoice_date) AS DATE) AS week_start FROM raw WHERE quantity > 0 AND unit_price > 0",
)
cte(
    "weekly_mart_grain",
    """
SELECT week_start, country, stock_code, count(DISTINCT invoice_no) AS order_count, count(DISTINCT customer_id) AS unique_customers,
       CAST(sum(quantity) AS BIGINT) AS units_sold, sum(line_total) AS revenue FROM stg GROUP BY 1, 2, 3
""",
)
cte(
    "weekly_mart",
    """
SELECT week_start, CAST(sum(revenue) AS DOUBLE) AS total_revenue, CAST(sum(order_count) AS BIGINT) AS order_count,
       CAST(sum(units_sold) AS BIGINT) AS units_sold, CAST(sum(unique_customers) AS BIGINT) AS active_customers FROM weekly_mart_grain GROUP BY 1
""",
)

# ------------------------------------------------------------------------- call log

cte(
    "calls",
    """
SELECT *, input_tokens + output_tokens AS total_tokens,
       round((input_tokens / 1000000) * 0.05 + (output_tokens / 1000000) * 0.08, 8) AS estimated_cost_usd
FROM (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'model-a' AS model, 'v' || CAST(user_id % 3 AS VARCHAR) AS prompt_version,
             event_type AS kpi_name, CASE WHEN event_type = 'signup' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS anomaly_date,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS input_tokens, CAST(event_id % 200 AS INTEGER) AS output_tokens,
             CAST(floor(value) AS INTEGER) AS latency_ms,
             list_filter([CASE WHEN value < 10 THEN 'output_too_short' END, CASE WHEN value > 150 THEN 'output_too_long' END,
                          CASE WHEN event_type = 'purchase' OR value > 100 THEN 'contains_percentages' END], lambda f: f IS NOT NULL) AS quality_flags,
             CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status
      FROM events)
""",
)
cte("good_calls", "SELECT * FROM calls WHERE status = 'success'")
