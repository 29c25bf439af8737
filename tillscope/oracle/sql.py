"""The DuckDB query that stands beside each Spark query."""

from __future__ import annotations

from tillscope.oracle.ctes import (
    HOME,
    KPI_NAMES,
    SIDE,
    build,
    iqr_sql,
    merge_sql,
    rounding,
    segments_sql,
    trend_sql,
    zscore_sql,
)

ANOMALY_NUMBERS = "actual_value expected_value deviation deviation_pct confidence stat_value"
ANOMALY_COLUMNS = f"kpi_name, date, method, severity, description, {rounding(ANOMALY_NUMBERS)}"
KPI_LIST = ", ".join(KPI_NAMES)
REVENUE = "CAST(sum(Quantity * UnitPrice) AS DOUBLE)"

Q: dict[str, str] = {}

# -------------------------------------------------------------- sources and sinks

THIRD = "CAST(replace(InvoiceNo, 'C', '') AS BIGINT) % 3"
Q["scan_transactions_csv"] = f"""
SELECT * EXCLUDE (UnitPrice, Description), CAST(UnitPrice AS DOUBLE) AS UnitPrice,
       CASE WHEN {THIRD} = 2 THEN Description || chr(10) || '2nd "line"' ELSE Description END AS Description FROM tx"""
Q["csv_rejects"] = f"""
SELECT CASE WHEN CAST(StockCode AS BIGINT) % 2 = 0 THEN 'no valid InvoiceDate' ELSE 'no valid Quantity' END AS reject, count(*) AS n
FROM tx WHERE {THIRD} = 0 GROUP BY 1"""
Q["sink_processed_csv"] = f"SELECT Country, count(*) AS n, {REVENUE} AS revenue FROM tx GROUP BY 1"
Q["transactions_by_week_folder"] = "SELECT week_end, count(*) AS n FROM txd GROUP BY 1"
COLUMNS = ["InvoiceNo", "InvoiceDate", "StockCode", "Description", "Quantity", "UnitPrice", "CustomerID", "Country"]
Q["dataset_summary"] = (
    "SELECT count(*) AS total_rows, 8 AS total_columns, min(InvoiceDate) AS start_date, max(InvoiceDate) AS end_date, "
    "count(DISTINCT InvoiceNo) AS unique_invoices, count(DISTINCT CustomerID) AS unique_customers, "
    "count(DISTINCT StockCode) AS unique_products, count(DISTINCT Country) AS unique_countries, "
    + ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in COLUMNS) + " FROM tx"
)
HISTORY = """
SELECT date, total_revenue, order_count, TIMESTAMP '2024-01-01 00:00:00' AS timestamp, DATE '2024-01-01' AS calculation_date, CAST(NULL AS DOUBLE) AS units_sold
FROM weekly WHERE date < DATE '1997-01-01'
UNION ALL SELECT date, total_revenue, NULL, TIMESTAMP '2024-02-02 00:00:00', DATE '2024-02-02', units_sold FROM weekly WHERE date >= DATE '1997-01-01'"""
Q["append_kpi_history"] = HISTORY
Q["anomalies_sink_source"] = f"SELECT {ANOMALY_COLUMNS} FROM anomalies"
Q["root_causes_sink"] = (
    "SELECT kpi_name, date, status, driver_1_segment, driver_2_segment, driver_3_segment, driver_1_contribution_pct FROM flat"
)
Q["cache_materialise"] = (
    "SELECT 'kpi_timeseries' AS table_name, count(*) AS n FROM weekly UNION ALL SELECT 'kpi_latest', count(*) FROM alltime "
    "UNION ALL SELECT 'anomalies', count(*) FROM anomalies UNION ALL SELECT 'root_causes', count(*) FROM flat"
)
_REFRESHED = "total_revenue, order_count, active_customers, repeat_customer_rate, product_revenue_concentration"
Q["cache_refresh"] = f"SELECT date, {_REFRESHED} FROM weekly UNION ALL SELECT NULL, {_REFRESHED} FROM alltime"
Q["cache_read"] = "SELECT date, total_revenue, order_count FROM weekly"
Q["scan_call_log_jsonl"] = "SELECT status, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS latency FROM calls GROUP BY 1"
Q["append_call_log"] = "SELECT prompt_version, count(*) AS n FROM calls GROUP BY 1"
Q["scan_keyed_json"] = (
    "SELECT key, kpi_name, strftime(date, '%Y-%m-%d') || ' 00:00:00' AS date, severity, prompt_version FROM narratives"
)
Q["sink_keyed_json"] = "SELECT key, kpi_name, severity, context FROM rag_narratives"
Q["query_param_select"] = "SELECT kpi_name, date, severity, method FROM anomalies WHERE severity = 'high' AND confidence >= 0.5"
Q["insert_do_nothing"] = """
SELECT kpi_name, date, method, severity FROM both_points b
WHERE NOT EXISTS (SELECT 1 FROM both_points t WHERE t.severity = 'critical' AND t.kpi_name = b.kpi_name AND t.date = b.date)
QUALIFY row_number() OVER (PARTITION BY kpi_name, date ORDER BY method) = 1"""


INVOICE = "CAST(replace(InvoiceNo, 'C', '') AS BIGINT)"


def _customers(parity):
    return (
        f"(SELECT CustomerID, CAST(sum(Quantity) AS BIGINT) AS units, count(*) AS lines, {parity} AS seen FROM tx "
        f"WHERE {INVOICE} % 2 = {parity} GROUP BY 1)"
    )


Q["upsert_rows"] = f"""
SELECT coalesce(t.CustomerID, b.CustomerID) AS CustomerID, CASE WHEN b.lines IS NOT NULL THEN b.units ELSE t.units END AS units,
       CASE WHEN t.lines IS NOT NULL THEN t.lines ELSE b.lines END AS lines, CASE WHEN b.lines IS NOT NULL THEN b.seen ELSE t.seen END AS seen
FROM {_customers(0)} t FULL JOIN {_customers(1)} b ON t.CustomerID = b.CustomerID"""
CHANGED = "SELECT kpi_name, date, value * 2 AS value FROM series WHERE value IS NOT NULL AND year(date) IN (1995, 1997) AND month(date) = 3"
Q["upsert_touched_partitions"] = f"""
SELECT kpi_name, date, CAST(year(date) AS INTEGER) AS year, value, CAST(load AS INTEGER) AS load FROM (
  SELECT s.kpi_name, s.date, coalesce(c.value, s.value) AS value, 1 AS load FROM series s
  LEFT JOIN ({CHANGED}) c ON c.kpi_name = s.kpi_name AND c.date = s.date WHERE s.value IS NOT NULL
  UNION ALL SELECT 'new_kpi', date, value / 2, 2 FROM ({CHANGED}) WHERE kpi_name = 'order_count')"""
Q["table_row_count"] = "SELECT count(*) AS n FROM raw"
Q["truncate_reload"] = (
    "SELECT country, count(*) AS n, CAST(2 * sum(quantity) AS BIGINT) AS units FROM raw GROUP BY 1"
)
# Fixed values.
OWNERS = """(VALUES ('total_revenue', 'Finance'), ('order_count', 'Operations'), ('units_sold', 'Operations'), ('active_customers', 'Growth'),
  ('revenue_per_order', 'Product'), ('revenue_per_customer', 'Product'), ('items_per_order', 'Product'), ('avg_unit_price', 'Pricing'),
  ('repeat_customer_rate', 'Retention'), ('new_customers', 'Growth'), ('product_revenue_concentration', 'Product'),
  ('product_return_rate', 'Operations'), ('revenue_by_country', 'International'), ('international_revenue_share', 'International'),
  ('weekend_revenue_share', 'Operations'), ('peak_hour_concentration', 'Operations')) AS owners(kpi_name, owner)"""
Q["owner_report"] = f"""
SELECT owner, kpi_name, round(value, 6) AS value,
       CASE WHEN regexp_matches(kpi_name, 'rate|share|concentration') THEN format('{{:.2f}}', value * 100) || '%'
            WHEN regexp_matches(kpi_name, 'revenue|price') THEN '£' || format('{{:,.2f}}', value)
            ELSE format('{{:,.0f}}', value) END AS formatted_value
FROM latest JOIN {OWNERS} USING (kpi_name)"""

# ---------------------------------------------------- projections and derived columns

Q["rename_snake"] = (
    "SELECT InvoiceNo AS invoice_no, InvoiceDate AS invoice_date, StockCode AS stock_code, Description AS description, Quantity AS quantity, "
    "CAST(UnitPrice AS DOUBLE) AS unit_price, CustomerID AS customer_id, Country AS country FROM tx"
)
Q["normalise_customer_id"] = "SELECT InvoiceNo, CAST(CAST(CustomerID AS BIGINT) AS VARCHAR) AS customer_id FROM tx"
Q["load_stamp"] = "SELECT true AS stamped, count(*) AS n FROM tx"
Q["stg_transactions"] = (
    "SELECT * EXCLUDE (unit_price, line_total), CAST(unit_price AS DOUBLE) AS unit_price, CAST(line_total AS DOUBLE) AS line_total FROM stg"
)
Q["derived_columns"] = "SELECT InvoiceNo, StockCode, CAST(v AS DOUBLE) AS TransactionValue, DayOfWeek, HourOfDay FROM txd"
Q["contract_derived_fields"] = (
    "SELECT InvoiceNo, CAST(v AS DOUBLE) AS TransactionValue, starts_with(InvoiceNo, 'C') OR Quantity < 0 AS IsReturn, DayOfWeek, HourOfDay, "
    f"Country <> '{HOME}' AS IsInternational FROM txd"
)
Q["resolve_date_column"] = "SELECT kpi_name, date AS anomaly_date, method FROM anomalies"
Q["unpivot_kpis"] = "SELECT kpi_name, date AS week_date, value FROM series"
Q["derive_direction"] = (
    "SELECT kpi_name, date, method, CASE WHEN deviation_pct IS NULL THEN NULL WHEN deviation_pct > 0 THEN 'above' ELSE 'below' END AS direction FROM anomalies"
)
Q["detection_methods_array"] = (
    "SELECT kpi_name, date, 'single' AS form, method AS methods FROM anomalies "
    "UNION ALL SELECT kpi_name, date, 'list', replace(method, '_and_', '|') FROM anomalies"
)
Q["default_missing_columns"] = (
    "SELECT kpi_name, date, severity, CAST(NULL AS DOUBLE) AS actual_value, 'weekly' AS cadence FROM anomalies"
)
DRIVER_NUMBERS = " ".join(f"driver_{i}_contribution_pct driver_{i}_deviation" for i in (1, 2, 3))
DRIVER_NAMES = ", ".join(f"driver_{i}_dimension, driver_{i}_segment" for i in (1, 2, 3))
Q["rc_flatten_drivers"] = (
    "SELECT kpi_name, date, anomaly_severity, round(anomaly_confidence, 4) AS anomaly_confidence, "
    + rounding("total_deviation total_deviation_pct") + f", status, summary, dimensions_analysed, {DRIVER_NAMES}, {rounding(DRIVER_NUMBERS)} FROM flat"
)
Q["rc_explode_drivers"] = "SELECT * FROM exploded"
PARSED = """SELECT kpi_name, date AS anomaly_date, {kind} AS narrative_type, prompt_version, narrative AS narrative_text,
  {context} AS retrieved_context, CAST(date AS TIMESTAMP) + INTERVAL 12 HOUR AS generated_at FROM {source} WHERE narrative <> ''"""
RAG_PARSED = PARSED.format(
    kind="'rag'", source="rag_narratives", context="CASE WHEN context IS NOT NULL THEN '[\"' || context || '\"]' END"
)
Q["parse_narratives"] = RAG_PARSED
Q["anomaly_description"] = "SELECT kpi_name, date, method, description FROM with_trends"
Q["root_cause_summary"] = "SELECT kpi_name, date, status, summary FROM causes"
# Fixed values.
LABELS = """(VALUES ('total_revenue', 'Total Revenue'), ('order_count', 'Order Count'), ('units_sold', 'Units Sold'),
  ('active_customers', 'Active Customers'), ('revenue_per_order', 'Revenue per Order'), ('revenue_per_customer', 'Revenue per Customer'),
  ('items_per_order', 'Items per Order'), ('avg_unit_price', '{avg}'), ('repeat_customer_rate', 'Repeat Customer Rate'),
  ('product_revenue_concentration', 'Product Revenue Concentration'), ('product_return_rate', 'Product Return Rate'),
  ('international_revenue_share', 'International Revenue Share'), ('weekend_revenue_share', 'Weekend Revenue Share'),
  ('peak_hour_concentration', 'Peak Hour Concentration'){more}) AS labels(kpi_name, label)"""
# Fixed values.
DOC_LABELS = LABELS.format(avg="Average Unit Price", more="")
PLAIN = ", ".join(f"driver_{i}_dimension || ' = ' || driver_{i}_segment" for i in (1, 2, 3))
SHARED = ", ".join(
    f"driver_{i}_dimension || '=' || driver_{i}_segment || ' (' || format('{{:.1f}}', driver_{i}_contribution_pct) || '% of deviation)'"
    for i in (1, 2, 3)
)
DOCUMENT = (
    "'KPI: ' || label || '. Date: ' || strftime(date, '%B %Y') || '. Severity: ' || anomaly_severity || '. The metric was ' || "
    f"format('{{:.1f}}', abs(total_deviation_pct)) || '% ' || {SIDE.format('total_deviation')} || ' expected. Status: ' || status || "
    f"'. Top drivers: ' || coalesce(nullif(concat_ws(', ', {PLAIN}), ''), 'no drivers identified') || '.'"
)
FLAT_LABELLED = f"flat JOIN {DOC_LABELS} USING (kpi_name)"
Q["anomaly_document"] = f"SELECT kpi_name, date, {DOCUMENT} AS document FROM {FLAT_LABELLED}"
PCT = f"format('{{:.1f}}', abs(total_deviation_pct)) || '% ' || {SIDE.format('total_deviation')}"
LONG_DATE = "strftime(date, '%B %d, %Y')"
NO_SEGMENT = "'no specific segment identified'"
Q["prompt_render"] = f"""
SELECT kpi_name, date, 'v2' AS prompt_version, 'Explain in two sentences. ' || label || ' on ' || {LONG_DATE} || ', severity ' || upper(anomaly_severity)
  || ': ' || {PCT} || ' expected. Drivers: ' || coalesce(nullif(concat_ws(', ', {SHARED}), ''), {NO_SEGMENT}) || '.' AS prompt
FROM {FLAT_LABELLED} WHERE status = 'analysed'"""
Q["narrative_key"] = "SELECT key FROM keyed"
TITLED = "array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace(kpi_name, '_', ' '), ' ')], ' ')"
Q["split_key"] = f"SELECT key, {TITLED} AS label, strftime(date, '%Y-%m-%d') AS day FROM keyed"


def shown(value="value"):
    percents = "('repeat_customer_rate', 'product_revenue_concentration', 'product_return_rate', 'international_revenue_share', 'weekend_revenue_share', 'peak_hour_concentration')"
    return f"""CASE WHEN kpi_name IN ('total_revenue', 'revenue_per_order', 'revenue_per_customer', 'avg_unit_price') THEN
         CASE WHEN {value} >= 1000000 THEN '£' || format('{{:.2f}}', {value} / 1000000) || 'M'
              WHEN {value} >= 1000 THEN '£' || format('{{:,.0f}}', {value}) ELSE '£' || format('{{:.2f}}', {value}) END
       WHEN kpi_name IN {percents} THEN format('{{:.1f}}', CASE WHEN {value} <= 1 THEN {value} * 100 ELSE {value} END) || '%'
       ELSE CASE WHEN {value} >= 1000000 THEN format('{{:.1f}}', {value} / 1000000) || 'M'
                 WHEN {value} >= 1000 THEN format('{{:,.0f}}', {value}) ELSE format('{{:.1f}}', {value}) END END"""


Q["format_kpi_value"] = f"SELECT kpi_name, date, {shown()} AS shown FROM series"
Q["anomaly_display"] = """
SELECT strftime(date, '%Y-%m-%d') AS Date, kpi_name AS KPI, upper(severity) AS Severity,
       CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS Confidence,
       format('{:.1f}', deviation_pct) || '%' AS Deviation, method AS Method FROM anomalies"""

# ------------------------------------------------------------------------- filters

UNITS = "count(*) AS n, CAST(sum(Quantity) AS BIGINT) AS units"
Q["filter_in_list"] = f"SELECT Country, {UNITS} FROM txd WHERE DayOfWeek IN ('Saturday', 'Sunday') GROUP BY 1"
Q["filter_not_equal"] = "SELECT CustomerID IS NULL AS guest, count(*) AS n FROM tx WHERE CustomerID IS DISTINCT FROM '00001' GROUP BY 1"
Q["filter_compare"] = f"SELECT Country, {UNITS} FROM tx WHERE Quantity < 0 OR UnitPrice >= 1500 GROUP BY 1"
Q["filter_baseline_window"] = (
    "SELECT Country, count(*) AS n, 'dated' AS baseline FROM base_rows GROUP BY 1 "
    "UNION ALL SELECT Country, count(*), 'empty' FROM tx GROUP BY 1"
)
Q["filter_anomaly_week"] = (
    "SELECT week_end, count(*) FILTER (InvoiceDate <= CAST(week_end AS TIMESTAMP)) AS in_period, count(*) AS in_week FROM txd GROUP BY 1"
)
Q["filter_anomalies"] = (
    "SELECT kpi_name, date, severity FROM anomalies WHERE severity IN ('high', 'critical') "
    "AND kpi_name IN ('total_revenue', 'order_count', 'peak_hour_concentration')"
)
Q["filter_point_anomalies"] = "SELECT kpi_name, date, method FROM with_trends WHERE method NOT LIKE '%mann_kendall%'"
Q["filter_explained"] = "SELECT kpi_name, date, status FROM causes WHERE status = 'analysed'"
Q["filter_key_contains"] = "SELECT key, status FROM keyed WHERE key LIKE '%1998-0%'"
Q["filter_prefix"] = "SELECT Country, count(*) AS n FROM tx WHERE InvoiceNo LIKE 'C%' GROUP BY 1"

# --------------------------------------------------------------------------- joins

Q["vw_kpi_with_anomaly_flag"] = """
SELECT s.kpi_name, s.date AS week_date, value, CAST(NULL AS VARCHAR) AS category, a.id IS NOT NULL AS is_anomaly, severity,
       round(confidence, 4) AS confidence, round(deviation_pct, 4) AS deviation_pct, direction
FROM series s LEFT JOIN anomaly_table a ON s.kpi_name = a.kpi_name AND s.date = a.anomaly_date"""
SUMMARY = """
SELECT a.id, a.kpi_name, a.anomaly_date, severity, round(confidence, 4) AS confidence, round(actual_value, 4) AS actual_value,
       round(expected_value, 4) AS expected_value, round(deviation_pct, 4) AS deviation_pct, detection_methods, status,
       dimension AS top_dimension, segment_value AS top_segment, contribution_pct AS top_contribution_pct
FROM anomaly_table a LEFT JOIN (SELECT * FROM cause_table WHERE segment_rank = 1) c ON a.id = c.anomaly_id"""
Q["mart_anomaly_summary"] = SUMMARY
Q["lookup_anomaly_id"] = """
SELECT s.kpi_name, s.date AS anomaly_date, id AS anomaly_id
FROM series s LEFT JOIN anomaly_table a ON s.kpi_name = a.kpi_name AND s.date = a.anomaly_date"""
Q["anomaly_drilldown"] = """
SELECT a.kpi_name, a.date, a.severity, a.method, f.status, f.summary, n.narrative, e.segment_rank AS rank,
       e.dimension || '=' || e.segment_value AS driver, e.contribution_pct
FROM anomalies a JOIN keyed f USING (kpi_name, date) LEFT JOIN narratives n USING (key)
LEFT JOIN (SELECT * FROM exploded WHERE segment_rank > 0) e ON e.kpi_name = a.kpi_name AND e.anomaly_date = a.date"""
Q["narrative_lookup"] = "SELECT k.key, k.kpi_name, k.date, k.status, n.narrative FROM keyed k LEFT JOIN narratives n USING (key)"
Q["narrative_compare"] = f"""
SELECT key, s.prompt_version AS standard_version, s.narrative AS standard, r.prompt_version AS rag_version, r.narrative AS rag,
       CASE WHEN r.context IS NULL THEN 0 ELSE 1 END AS n_retrieved, {TITLED.replace('kpi_name', 's.kpi_name')} || ' — ' || strftime(s.date, '%Y-%m-%d') AS display
FROM narratives s JOIN rag_narratives r USING (key)"""
Q["pending_narratives"] = """
SELECT key, kpi_name, date, anomaly_severity FROM keyed WHERE status = 'analysed' AND key NOT IN (SELECT key FROM narratives)"""
VIOLATIONS = "CAST(sum(len(list_filter(quality_flags, lambda f: f = 'contains_percentages'))) AS BIGINT)"
Q["prompt_version_stats"] = f"""
SELECT p.id AS prompt_version, p.description, coalesce(calls, 0) AS calls, coalesce(pct_violations, 0) AS pct_violations,
       round(coalesce(avg_latency_ms, 0.0), 4) AS avg_latency_ms
FROM (VALUES ('v0', 'first wording'), ('v1', 'second wording'), ('v2', 'with drivers'), ('v9', 'never used')) AS p(id, description)
LEFT JOIN (SELECT prompt_version, count(*) AS calls, {VIOLATIONS} AS pct_violations, sum(latency_ms) / count(*) AS avg_latency_ms
           FROM good_calls GROUP BY 1) s ON s.prompt_version = p.id"""
Q["anomaly_tx_range_join"] = """
SELECT a.kpi_name, a.date, count(*) AS n, CAST(sum(v) AS DOUBLE) AS revenue FROM anomalies a
JOIN txd t ON t.InvoiceDate BETWEEN CAST(a.date AS TIMESTAMP) - INTERVAL 6 DAY AND CAST(a.date AS TIMESTAMP) GROUP BY 1, 2"""
Q["kpi_has_anomaly"] = "SELECT DISTINCT kpi_name FROM series WHERE kpi_name IN (SELECT kpi_name FROM anomalies)"
Q["anomaly_markers"] = """
SELECT kpi_name, date, severity FROM with_trends w WHERE method NOT LIKE '%mann_kendall%'
AND EXISTS (SELECT 1 FROM series s WHERE s.kpi_name = w.kpi_name AND s.date = w.date)"""
Q["pairwise_self_join"] = "SELECT kpi_name, pairs, concordant, discordant, tied FROM trends_pairs"

# -------------------------------------------------------------------- aggregations


def weekly_value(expression):
    return f"SELECT week_end AS date, {expression} AS value FROM txd GROUP BY 1"


Q["agg_sum"] = weekly_value("CAST(sum(Quantity) AS DOUBLE)")
Q["agg_sum_product"] = weekly_value("CAST(sum(v) AS DOUBLE)")
Q["agg_count"] = weekly_value("CAST(count(CustomerID) AS DOUBLE)")
Q["agg_count_distinct"] = weekly_value("CAST(count(DISTINCT CustomerID) AS DOUBLE)")
Q["agg_avg"] = weekly_value("CAST(sum(UnitPrice) AS DOUBLE) / count(UnitPrice)")
Q["agg_avg_product"] = weekly_value("CAST(sum(v) AS DOUBLE) / count(v)")
Q["agg_min"] = weekly_value("CAST(min(UnitPrice) AS DOUBLE)")
Q["agg_max"] = weekly_value("CAST(max(Quantity) AS DOUBLE)")
Q["agg_cond_sum"] = weekly_value(f"CAST(coalesce(sum(v) FILTER (Country IS DISTINCT FROM '{HOME}'), 0) AS DOUBLE)")
Q["agg_cond_count_distinct"] = weekly_value("CAST(count(DISTINCT InvoiceNo) FILTER (Quantity < 0) AS DOUBLE)")
WEEKEND = "FILTER (DayOfWeek IN ('Saturday', 'Sunday'))"
Q["agg_cond_avg"] = weekly_value(f"CAST(sum(v) {WEEKEND} AS DOUBLE) / nullif(count(v) {WEEKEND}, 0)")
Q["agg_entities_over_threshold"] = """
SELECT date, coalesce(n, 0.0) AS value FROM (SELECT DISTINCT week_end AS date FROM txd) LEFT JOIN (
  SELECT date, CAST(count(*) FILTER (c > 2) AS DOUBLE) AS n FROM (
    SELECT week_end AS date, CustomerID, count(DISTINCT InvoiceNo) AS c FROM txd WHERE CustomerID IS NOT NULL GROUP BY 1, 2)
  GROUP BY 1) USING (date)"""
Q["agg_first_seen_in_period"] = """
SELECT CAST(count(*) AS DOUBLE) AS value FROM (SELECT CustomerID, min(InvoiceDate) AS f FROM tx WHERE CustomerID IS NOT NULL GROUP BY 1)
WHERE f BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-12-31'"""
Q["agg_topn_sum_products"] = "SELECT date, top AS value FROM weekly_products"
Q["agg_topn_sum_hours"] = "SELECT date, top AS value FROM weekly_hours"
Q["metric_ratio"] = f"""
SELECT date, revenue, per_customer, half_units, by_nothing, order_size FROM (
  SELECT date, rev AS revenue, CASE WHEN customers = 0 THEN 0.0 ELSE rev / customers END AS per_customer, units / 2.0::DOUBLE AS half_units,
         0.0::DOUBLE AS by_nothing, units / orders AS order_size FROM weekly_main)"""
Q["kpi_single"] = "SELECT revenue_per_customer FROM alltime"
Q["kpi_all"] = f"SELECT {KPI_LIST} FROM alltime"
Q["kpi_all_weekly_cadence"] = (
    "SELECT revenue_per_customer, avg_unit_price, repeat_customer_rate, new_customers, product_revenue_concentration, product_return_rate, "
    "revenue_by_country, international_revenue_share, weekend_revenue_share FROM alltime"
)
Q["kpi_windowed_weekly"] = f"SELECT date, {KPI_LIST} FROM weekly"
Q["kpi_windowed_daily"] = f"SELECT date, {KPI_LIST} FROM daily"
for _name in KPI_NAMES:
    Q[f"kpi_{_name}"] = f"SELECT date, {_name} FROM weekly"
Q["revenue_by_country_breakdown"] = "SELECT week_end AS date, Country AS country, CAST(sum(v) AS DOUBLE) AS revenue FROM txd GROUP BY 1, 2"
Q["new_customers_by_history"] = """
SELECT CAST(date_trunc('week', f) AS DATE) + 6 AS date, CAST(count(*) AS DOUBLE) AS new_customers
FROM (SELECT min(InvoiceDate) AS f FROM tx WHERE CustomerID IS NOT NULL GROUP BY CustomerID) GROUP BY 1"""
Q["int_weekly_transactions"] = """
SELECT week_start, country, stock_code, order_count, unique_customers, units_sold, CAST(revenue AS DOUBLE) AS revenue,
       CAST(revenue AS DOUBLE) / nullif(order_count, 0) AS revenue_per_order, CAST(revenue AS DOUBLE) / nullif(unique_customers, 0) AS revenue_per_customer
FROM weekly_mart_grain"""
MART = "SELECT *, total_revenue / nullif(order_count, 0) AS revenue_per_order, total_revenue / nullif(active_customers, 0) AS revenue_per_customer FROM "
Q["mart_weekly_kpis"] = MART + "weekly_mart"
Q["mart_weekly_kpis_exact"] = MART + """(
SELECT week_start, CAST(sum(line_total) AS DOUBLE) AS total_revenue, count(DISTINCT invoice_no) AS order_count,
       CAST(sum(quantity) AS BIGINT) AS units_sold, count(DISTINCT customer_id) AS active_customers FROM stg GROUP BY 1)"""
Q["vw_llm_monitoring_summary"] = """
SELECT prompt_version, count(*) AS total_calls, count(*) AS successful_calls, round(sum(latency_ms) / count(*), 0) AS avg_latency_ms,
       round(sum(estimated_cost_usd), 6) AS total_cost_usd, round(sum(input_tokens) / count(*), 6) AS avg_input_tokens,
       round(sum(output_tokens) / count(*), 6) AS avg_output_tokens, count(*) FILTER (len(quality_flags) > 0) AS calls_with_violations
FROM calls GROUP BY 1"""
CLUSTERS = """
SELECT anomaly_date, count(*) AS kpi_count, string_agg(kpi_name, ',' ORDER BY kpi_name) AS kpis_affected, {worst} AS max_severity,
       (2 * sum(CAST(round(confidence * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) / 10000 AS avg_confidence
FROM anomaly_table GROUP BY 1 HAVING count(*) > 1"""
Q["vw_anomaly_clusters"] = CLUSTERS.format(worst="max(severity)")
Q["vw_anomaly_clusters_ordinal"] = CLUSTERS.format(
    worst="CASE max(list_position(['low', 'medium', 'high', 'critical'], severity)) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"
)
Q["call_log_summary"] = """
SELECT count(*) AS total_calls, count(*) FILTER (ok) AS successful, count(*) FILTER (status = 'error') AS failed,
       round(count(*) FILTER (ok) / count(*) * 100, 1) AS success_rate_pct, round(sum(estimated_cost_usd), 6) AS total_cost_usd,
       round_even(sum(latency_ms) FILTER (ok) / count(*) FILTER (ok), 0) AS avg_latency_ms,
       round_even(sum(total_tokens) FILTER (ok) / count(*) FILTER (ok), 0) AS avg_tokens_per_call
FROM (SELECT *, status = 'success' AS ok FROM calls)"""
Q["call_log_by_version"] = """
SELECT prompt_version, count(*) AS calls, round(sum(estimated_cost_usd), 6) AS total_cost, round_even(sum(latency_ms) / count(*), 0) AS avg_latency_ms
FROM good_calls GROUP BY 1"""
Q["flag_frequency"] = """
SELECT flag, count(*) AS n, round(count(*) / (SELECT count(*) FROM good_calls) * 100, 4) AS pct_of_calls
FROM (SELECT unnest(quality_flags) AS flag FROM good_calls) GROUP BY 1"""
Q["version_violations"] = f"""
SELECT prompt_version, count(*) AS calls, {VIOLATIONS} AS pct_violations, round(sum(latency_ms) / count(*), 4) AS avg_latency_ms,
       round(sum(total_tokens) / count(*), 4) AS avg_tokens FROM good_calls GROUP BY 1"""
Q["latency_series"] = "SELECT CAST(timestamp AS TIMESTAMP) AS timestamp, latency_ms, prompt_version FROM good_calls"
Q["anomaly_counts"] = """
SELECT 'severity' AS breakdown, severity AS name, count(*) AS n FROM anomalies GROUP BY 2
UNION ALL SELECT 'kpi', kpi_name, count(*) FROM anomalies GROUP BY 2
UNION ALL SELECT 'total', 'all', count(*) FROM anomalies UNION ALL SELECT 'kpis_affected', 'all', count(DISTINCT kpi_name) FROM anomalies"""
Q["rootcause_status_counts"] = "SELECT status, count(*) AS n FROM causes GROUP BY 1"
Q["series_stats"] = """
SELECT kpi_name, round(avg(value), 4) AS mean, round(min(value), 4) AS min, round(max(value), 4) AS max, coalesce(any_value(c.n), 0) AS anomalies
FROM series LEFT JOIN (SELECT kpi_name, count(*) AS n FROM with_trends WHERE method <> 'mann_kendall' GROUP BY 1) c USING (kpi_name) GROUP BY 1"""
ARROWS = """
SELECT kpi_name, CASE WHEN n < 4 OR earlier = 0 THEN '' WHEN (recent - earlier) / abs(earlier) > 0.05 THEN '↑'
                      WHEN (recent - earlier) / abs(earlier) < -0.05 THEN '↓' ELSE '→' END AS trend
FROM (SELECT kpi_name, count(*) AS n, avg(value) FILTER (back <= 4) AS recent,
             CASE WHEN count(*) >= 8 THEN avg(value) FILTER (back BETWEEN 5 AND 8) ELSE avg(value) FILTER (front <= 4) END AS earlier
      FROM (SELECT *, row_number() OVER (PARTITION BY kpi_name ORDER BY date DESC) AS back,
                   row_number() OVER (PARTITION BY kpi_name ORDER BY date) AS front FROM series) GROUP BY 1)"""
# Fixed values.
CATEGORIES = """(VALUES ('Finance', 'total_revenue'), ('Finance', 'revenue_per_order'), ('Finance', 'revenue_per_customer'),
  ('Operations', 'order_count'), ('Operations', 'items_per_order'), ('Operations', 'units_sold'), ('Operations', 'product_return_rate'),
  ('Operations', 'weekend_revenue_share'), ('Operations', 'peak_hour_concentration'), ('Growth', 'active_customers'),
  ('Growth', 'repeat_customer_rate'), ('Growth', 'new_customers'), ('Product', 'product_revenue_concentration'), ('Product', 'avg_unit_price'),
  ('International', 'international_revenue_share')) AS cards(category, kpi_name)"""
Q["kpi_overview"] = f"""
SELECT category, kpi_name, label, round(value, 6) AS value, {shown()} AS formatted_value, trend,
       kpi_name IN (SELECT kpi_name FROM anomalies) AS has_anomaly
FROM {CATEGORIES} JOIN {LABELS.format(avg='Avg Unit Price', more=", ('new_customers', 'New Customers')")} USING (kpi_name)
JOIN latest USING (kpi_name) JOIN ({ARROWS}) USING (kpi_name)"""
Q["driver_share_by_kpi"] = f"""
SELECT kpi_name, round(avg(top_contribution_pct), 4) AS avg_top_contribution, count(*) AS n FROM ({SUMMARY}) WHERE top_contribution_pct IS NOT NULL GROUP BY 1"""

# ------------------------------------------------------------------------- windows

Q["bucket_week_end"] = "SELECT week_end AS bucket, count(*) AS n FROM txd GROUP BY 1"
Q["bucket_day"] = "SELECT day AS bucket, count(*) AS n FROM txd GROUP BY 1"
Q["bucket_week_start"] = "SELECT CAST(date_trunc('week', InvoiceDate) AS DATE) AS bucket, count(*) AS n FROM txd GROUP BY 1"
Q["trend_arrow"] = ARROWS
Q["normalise_to_mean"] = "SELECT kpi_name, date, round(value / avg(value) OVER (PARTITION BY kpi_name) * 100, 4) AS pct_of_mean FROM series"
Q["dedupe_keep_best"] = """
SELECT kpi_name, date, method, confidence FROM both_points
QUALIFY row_number() OVER (PARTITION BY kpi_name, date ORDER BY confidence DESC, method DESC) = 1"""
Q["dedupe_keep_last"] = """
SELECT user_id, event_type, ts, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""
Q["rank_drivers"] = "SELECT kpi_name, date, dimension, segment, contribution_pct, CAST(rank AS INTEGER) AS rank FROM ranked"
Q["series_position"] = "SELECT kpi_name, date, position FROM positioned"

# ------------------------------------------------------------------ sorts and top-k

Q["order_weekly"] = "SELECT week_start, total_revenue FROM weekly_mart"
Q["order_anomalies"] = "SELECT date, kpi_name, method FROM anomalies"
Q["top_confidence"] = "SELECT kpi_name, date, confidence, severity FROM anomalies ORDER BY confidence DESC, kpi_name, date LIMIT 10"
Q["top_products"] = "SELECT StockCode, CAST(revenue AS DOUBLE) AS revenue FROM top20"
Q["top_segments_preview"] = "SELECT kpi_name, date, first_three AS drivers FROM causes"

# ------------------------------------------------------------------ set operations

Q["union_detections"] = "SELECT kpi_name, date, method, severity FROM (SELECT * FROM both_points UNION ALL BY NAME" + trend_sql("drift_trends") + ")"
Q["union_histories"] = f"SELECT date, total_revenue, order_count, units_sold FROM ({HISTORY})"
Q["union_narrative_types"] = """
SELECT kpi_name, date AS anomaly_date, 'standard' AS narrative_type, prompt_version FROM narratives WHERE narrative <> ''
UNION ALL SELECT kpi_name, date, 'rag', prompt_version FROM rag_narratives WHERE narrative <> ''"""
Q["intersect_keys"] = "SELECT key FROM narratives INTERSECT SELECT key FROM rag_narratives"
Q["distinct_values"] = "SELECT DISTINCT Country, HourOfDay AS hour FROM txd"

# -------------------------------------------------------------------- data quality

Q["dq_schema"] = """
SELECT finding, (SELECT count(*) FROM tx) AS n_rows
FROM (VALUES ('Missing columns: [''Country'']'), ('Column ''Quantity'': expected int, got string'), ('Extra: Extra')) AS f(finding)"""
LIMITS = {"InvoiceNo": 0.0, "InvoiceDate": 0.0, "StockCode": 0.0, "Description": 0.05, "Quantity": 0.0, "UnitPrice": 0.0, "CustomerID": 0.25, "Country": 0.0}
Q["dq_completeness"] = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_share, "
    f"CAST({t} AS DOUBLE) AS threshold, count(*) FILTER ({c} IS NULL) / count(*) <= {t} AS passes FROM tx"
    for c, t in LIMITS.items()
)


def _range(c, low, high):
    bad = f"count(*) FILTER ({c} < {low} OR {c} > {high})"
    return (
        f"SELECT '{c}' AS column_name, {bad} AS violations, round({bad} / count(*), 6) AS violation_share, CAST({low} AS DOUBLE) AS min_value, "
        f"CAST({high} AS DOUBLE) AS max_value, CAST(min({c}) AS DOUBLE) AS actual_min, CAST(max({c}) AS DOUBLE) AS actual_max, {bad} = 0 AS passes FROM tx"
    )


Q["dq_value_ranges"] = _range("Quantity", -40, 40) + " UNION ALL " + _range("UnitPrice", 0, 10000)
RULE = "SELECT '{name}' AS rule, count(*) FILTER ({bad}) AS violations, count(*) AS total_checked, count(*) FILTER ({bad}) = 0 AS passes FROM tx {where}"
Q["dq_cancellation_sign"] = RULE.format(name="cancellation_quantity_match", bad=f"CASE WHEN {INVOICE} % 7 = 0 THEN -Quantity ELSE Quantity END > 0", where="WHERE InvoiceNo LIKE 'C%'")
Q["dq_positive_price"] = RULE.format(name="positive_price", bad="CASE WHEN CAST(StockCode AS BIGINT) % 11 = 0 THEN -UnitPrice ELSE UnitPrice END < 0", where="")
Q["dq_transaction_value"] = RULE.format(name="valid_transaction_value", bad="abs(Quantity * UnitPrice) > 40000", where="")


def _checks(limit):
    rows = ["SELECT 'schema' AS check_group, 'schema' AS check_name, true AS passes"]
    rows += [f"SELECT 'completeness', '{c}', count(*) FILTER ({c} IS NULL) / count(*) <= {t} FROM tx" for c, t in LIMITS.items()]
    rows += [f"SELECT 'value_range', '{c}', count(*) FILTER ({c} < {lo} OR {c} > {hi}) = 0 FROM tx" for c, lo, hi in (("Quantity", -10000, 10000), ("UnitPrice", 0, 10000))]
    rows += [
        "SELECT 'consistency', 'cancellation_quantity_match', count(*) FILTER (InvoiceNo LIKE 'C%' AND Quantity > 0) = 0 FROM tx",
        "SELECT 'consistency', 'positive_price', count(*) FILTER (UnitPrice < 0) = 0 FROM tx",
        f"SELECT 'consistency', 'valid_transaction_value', count(*) FILTER (abs(Quantity * UnitPrice) > {limit}) = 0 FROM tx",
    ]
    return " UNION ALL ".join(rows)


Q["dq_checks"] = _checks(100000)


def _report(case, limit, minimum, warning):
    score = "count(*) FILTER (passes) / count(*)"
    return f"""
SELECT round({score}, 6) AS overall_quality_score, count(*) AS total_checks, count(*) FILTER (passes) AS passed_checks,
       count(*) FILTER (NOT passes) AS failed_checks, CASE WHEN {score} >= {minimum} THEN 'PASS' ELSE 'FAIL' END AS recommendation,
       CASE WHEN {score} < {minimum} THEN 'fail' WHEN {score} < {warning} THEN 'warn' ELSE 'ok' END AS band, '{case}' AS "case"
FROM ({_checks(limit)})"""


Q["dq_report"] = " UNION ALL ".join([_report("fail", 40000, 0.95, 0.98), _report("warn", 100000, 0.8, 0.98), _report("pass", 100000, 0.5, 0.8)])
Q["dq_test_not_null"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS failures FROM raw" for c in ("invoice_no", "quantity", "unit_price", "customer_id")
)
Q["dq_test_unique"] = "SELECT invoice_no, count(*) AS n_records FROM raw GROUP BY 1 HAVING count(*) > 1"
Q["dq_pattern"] = (
    "SELECT 'InvoiceNo' AS column_name, count(*) FILTER (NOT regexp_matches(InvoiceNo, '^[0-9]{6}$')) AS violations FROM tx "
    "UNION ALL SELECT 'CustomerID', count(*) FILTER (NOT regexp_matches(CustomerID, '^0[0-9]{4}$')) FROM tx"
)
Q["dq_max_length"] = (
    "SELECT 'StockCode' AS column_name, count(*) FILTER (length(StockCode) > 20) AS violations FROM tx "
    "UNION ALL SELECT 'Description', count(*) FILTER (length(Description) > 10) FROM tx"
)
Q["dq_date_bounds"] = """
SELECT count(*) FILTER (InvoiceDate < TIMESTAMP '1995-06-01') AS too_early, count(*) FILTER (InvoiceDate > TIMESTAMP '1998-06-30') AS too_late,
       min(InvoiceDate) AS earliest, max(InvoiceDate) AS latest FROM tx"""
Q["dq_future_date"] = "SELECT count(*) AS violations FROM tx WHERE InvoiceDate > TIMESTAMP '1998-06-30'"
Q["dq_zero_price_share"] = """
SELECT count(*) FILTER (UnitPrice = 0) AS zero_prices, count(*) FILTER (UnitPrice = 0) / count(UnitPrice) AS zero_share,
       count(*) FILTER (UnitPrice = 0) / count(UnitPrice) <= 0.02 AS passes FROM tx"""


def _outliers(column, reach):
    return f"""
SELECT round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(any_value(lo), 4) AS lower_fence, round(any_value(hi), 4) AS upper_fence,
       count(*) FILTER (p < lo OR p > hi) AS outliers, count(*) AS n_values
FROM (SELECT *, q1 - {reach} * (q3 - q1) AS lo, q3 + {reach} * (q3 - q1) AS hi
      FROM (SELECT CAST({column} AS DOUBLE) AS p, quantile_cont(CAST({column} AS DOUBLE), 0.25) OVER () AS q1,
                   quantile_cont(CAST({column} AS DOUBLE), 0.75) OVER () AS q3 FROM tx))"""


Q["dq_iqr_outliers"] = _outliers("Quantity", 1.5)
Q["dq_iqr_outliers_price"] = _outliers("UnitPrice", 0.25)
Q["dq_monotonic_dates"] = """
SELECT CAST(count(*) FILTER (low < before) AS BIGINT) AS violations
FROM (SELECT low, lag(high) OVER (ORDER BY pos) AS before
      FROM (SELECT CAST(replace(InvoiceNo, 'C', '') AS BIGINT) AS pos, min(InvoiceDate) AS low, max(InvoiceDate) AS high FROM tx GROUP BY 1))"""
COPIES = f"(SELECT * FROM tx UNION ALL SELECT * FROM tx WHERE {INVOICE} % 10 = 0)"
Q["dq_duplicate_rate"] = f"""
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, round((sum(n) - count(*)) / sum(n), 6) AS duplicate_rate,
       (sum(n) - count(*)) / sum(n) <= 0.01 AS passes
FROM (SELECT count(*) AS n FROM {COPIES} GROUP BY {", ".join(COLUMNS)})"""
Q["dq_temporal_gaps"] = """
SELECT day, next_day, CAST(next_day - day AS INTEGER) AS gap_days
FROM (SELECT day, lead(day) OVER (ORDER BY day) AS next_day FROM (SELECT DISTINCT day FROM txd)) WHERE next_day - day > 0"""
MOVED = "(SELECT CASE WHEN dayofweek(day) = 4 THEN CAST(day + INTERVAL 1 DAY AS DATE) ELSE day END AS day FROM txd)"
Q["dq_daily_row_count"] = f"""
SELECT CAST(d.day AS DATE) AS day, count(t.day) AS n_rows, CASE WHEN count(t.day) < 30 THEN 'fail' WHEN count(t.day) < 45 THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM {MOVED}) d
LEFT JOIN {MOVED} t ON t.day = CAST(d.day AS DATE) GROUP BY 1"""
Q["dq_freshness"] = """
SELECT latest, date_diff('second', latest, TIMESTAMP '1999-06-01 12:00:00') // 3600 AS delay_hours,
       date_diff('second', latest, TIMESTAMP '1999-06-01 12:00:00') // 3600 <= 24 AS passes FROM (SELECT max(InvoiceDate) AS latest FROM tx)"""
Q["dq_allowed_values"] = "SELECT Country, count(*) AS n_rows FROM tx WHERE Country NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 4) GROUP BY 1"
Q["dedupe_transactions"] = f"SELECT DISTINCT * EXCLUDE (UnitPrice), CAST(UnitPrice AS DOUBLE) AS UnitPrice FROM {COPIES}"
Q["dq_gate"] = f"SELECT (SELECT count(*) FILTER (passes) / count(*) < 0.95 FROM ({_checks(100000)})) AS stopped, (SELECT count(*) FROM tx) AS passed_on"
Q["daily_kpis_table"] = """
SELECT d.date, kpi_name, value AS kpi_value, round(filled, 4) AS data_completeness
FROM (SELECT * FROM (UNPIVOT daily ON COLUMNS(* EXCLUDE (date)) INTO NAME kpi_name VALUE value)) d
JOIN (SELECT day AS date, 1 - sum(CASE WHEN CustomerID IS NULL THEN 1 ELSE 0 END) / (count(*) * 8) AS filled FROM txd GROUP BY 1) USING (date)"""
Q["insights_table"] = """
SELECT sha256(w.kpi_name || '|' || CAST(w.date AS VARCHAR) || '|' || kind) AS insight_id, w.date AS detection_date, w.kpi_name, kind AS insight_type,
       w.severity, w.confidence AS confidence_score, w.description AS explanation, CASE WHEN kind = 'anomaly' THEN c.status END AS root_cause_status,
       CASE WHEN kind = 'anomaly' THEN n.narrative END AS narrative, 'pending' AS status
FROM (SELECT *, CASE WHEN method = 'mann_kendall' THEN 'trend_break' ELSE 'anomaly' END AS kind FROM with_trends) w
LEFT JOIN causes c USING (kpi_name, date) LEFT JOIN narratives n USING (kpi_name, date)"""

# ----------------------------------------------------------------------- detection

Q["detect_zscore"] = f"SELECT {ANOMALY_COLUMNS} FROM (" + zscore_sql("series", "stats", 2.5) + ")"
Q["detect_iqr"] = f"SELECT {ANOMALY_COLUMNS} FROM (" + iqr_sql("series", "stats", 1.5) + ")"
Q["detect_trend"] = f"SELECT {ANOMALY_COLUMNS} FROM (" + trend_sql("drift_trends") + ")"
Q["trend_statistics_all"] = (
    "SELECT kpi_name, CAST(n AS INTEGER) AS n, CAST(s AS BIGINT) AS s, " + rounding("var_s z slope mean last_value") + ", last_date FROM trends"
)
Q["severity_zscore"] = "SELECT kpi_name, date, severity FROM (" + zscore_sql("series", "stats", 1.0) + ")"
Q["severity_iqr"] = "SELECT kpi_name, date, severity FROM (" + iqr_sql("series", "stats", 0.5) + ")"
Q["severity_trend"] = "SELECT kpi_name, severity FROM (" + trend_sql("drift_trends", 0.6744897501960817) + ")"
Q["baseline_fallback"] = "SELECT kpi_name, n_points, n_baseline, " + rounding("mean std q1 median q3") + " FROM short_stats"
Q["detect_all"] = f"SELECT {ANOMALY_COLUMNS} FROM anomalies"
Q["merge_detections"] = (
    "SELECT kpi_name, date, method, severity, round(confidence, 4) AS confidence, round(stat_value, 4) AS stat_value, description FROM ("
    + merge_sql("mixed_detections") + ")"
)
Q["kpi_timeseries"] = "SELECT kpi_name, date, value FROM series"

# --------------------------------------------------------------------- attribution

METRIC_COLUMNS = rounding("revenue orders units customers") + ", round(units / orders, 4) AS items_per_order"
Q["segment_metric"] = f"SELECT dimension, segment, {METRIC_COLUMNS} FROM (" + segments_sql("base_rows", "", products=False) + ")"
Q["segment_candidates"] = "SELECT dimension, segment FROM base_segments"
SHARE_COLUMNS = rounding("actual expected deviation contribution_pct")
Q["segment_contribution"] = f"SELECT kpi_name, date, dimension, segment, {SHARE_COLUMNS} FROM shares"
CAUSE = (
    "SELECT kpi_name, date, anomaly_severity, round(anomaly_confidence, 4) AS anomaly_confidence, "
    + rounding("total_deviation total_deviation_pct") + ", status, drivers, dimensions_analysed, summary FROM "
)
Q["root_cause"] = CAUSE + "causes WHERE kpi_name = 'order_count'"
Q["root_cause_all"] = CAUSE + "causes"
Q["root_cause_full_week"] = CAUSE + "causes_whole"
Q["top_findings"] = (
    "SELECT kpi_name, date, anomaly_confidence, first_three AS drivers FROM causes WHERE status = 'analysed' "
    "ORDER BY anomaly_confidence DESC, kpi_name, date LIMIT 10"
)

# ---------------------------------------------------------- retrieval and monitoring

CORPUS = f"""
SELECT kpi_name || '_' || strftime(date, '%Y-%m-%d') AS id, {DOCUMENT} AS document, kpi_name, CAST(date AS VARCHAR) AS date, anomaly_severity AS severity,
       status, {SIDE.format('total_deviation')} AS direction FROM {FLAT_LABELLED}"""
Q["retriever_build"] = CORPUS
Q["retriever_append"] = f"SELECT id, severity FROM ({CORPUS}) WHERE severity <> 'low'"
Q["retriever_skip"] = f"SELECT id, severity FROM ({CORPUS}) WHERE severity = 'low'"
NEAREST = """
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 4) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
    SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(c.vec_id AS VARCHAR) AS id,
           1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))
             / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
                    * list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) AS distance
    FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id {same}) {cut})
WHERE rank <= {n}"""
Q["similar_topk"] = NEAREST.format(same="AND q.label = c.label", cut="WHERE distance <= 1.0", n=3)
Q["similar_topk_any_kpi"] = NEAREST.format(same="", cut="", n=2)
SIZE = "sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])))"
CONTEXT_CTES = f"""
corpus AS ({CORPUS}),
vectors AS (
  SELECT corpus.*, embedding FROM (SELECT *, row_number() OVER (ORDER BY date, kpi_name) AS vec_id FROM corpus) corpus JOIN embeddings USING (vec_id)
), near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
    SELECT q.id AS query_id, c.id, c.kpi_name, c.date, c.severity, c.document,
           1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))
             / ({SIZE.format("q.embedding")} * {SIZE.format("c.embedding")}) AS distance
    FROM vectors q JOIN vectors c ON q.kpi_name = c.kpi_name AND q.id <> c.id) WHERE distance <= 1.0
), contexts AS (
  SELECT p.id AS query_id, CASE WHEN count(e.id) = 0 THEN 'No similar historical anomalies found.' ELSE
    'Similar historical anomalies for context:' || chr(10) || string_agg(CAST(e.rank AS VARCHAR) || '. ' || e.kpi_name || ' anomaly in '
    || strftime(CAST(e.date AS DATE), '%B %Y') || ' (severity: ' || e.severity || '): ' || e.document, chr(10) ORDER BY e.rank) END AS context
  FROM corpus p LEFT JOIN near e ON e.query_id = p.id AND e.rank <= 3 GROUP BY p.id
)"""
Q["query_document"] = f"""
SELECT kpi_name, date, 'KPI: ' || label || '.' || CASE WHEN tail = '' THEN ' Anomaly detected.' ELSE tail END AS query_text FROM (
  SELECT kpi_name, date, label, CASE WHEN anomaly_severity <> 'low' THEN ' Severity: ' || anomaly_severity || '.' ELSE '' END
    || CASE WHEN anomaly_severity <> 'medium' THEN ' The metric was ' || {PCT} || ' expected.' ELSE '' END AS tail FROM {FLAT_LABELLED})"""
Q["context_block"] = f"WITH {CONTEXT_CTES} SELECT query_id, context FROM contexts"
Q["prompt_render_rag"] = f"""
WITH {CONTEXT_CTES}
SELECT kpi_name, date, 'v2-rag' AS prompt_version, context || chr(10) || 'Now: ' || label || ' on ' || {LONG_DATE}
  || ' (' || upper(anomaly_severity) || '), ' || {PCT} || '; ' || coalesce(nullif(concat_ws(', ', {PLAIN}), ''), {NO_SEGMENT}) || '.' AS prompt
FROM {FLAT_LABELLED} JOIN contexts ON query_id = kpi_name || '_' || strftime(date, '%Y-%m-%d') WHERE status = 'analysed'"""
Q["call_cost"] = "SELECT timestamp, input_tokens, output_tokens, estimated_cost_usd FROM calls"
Q["quality_flags"] = r"""
SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS output_length_chars, CAST(marks AS INTEGER) AS output_sentence_count,
       array_to_string(list_filter([CASE WHEN length(text) < 50 THEN 'output_too_short' END, CASE WHEN length(text) > 600 THEN 'output_too_long' END,
         CASE WHEN marks > 6 THEN 'too_many_sentences' END, CASE WHEN NOT regexp_matches(text, '\S') THEN 'empty_output' END,
         CASE WHEN starts_with(lower(text), 'i ') THEN 'starts_with_i' END,
         CASE WHEN contains(lower(text), 'percent') OR contains(text, '%') THEN 'contains_percentages' END], lambda f: f IS NOT NULL), ',') AS quality_flags
FROM (SELECT *, length(text) - length(replace(replace(text, '.', ''), '!', '')) AS marks FROM conversations)"""
Q["load_llm_calls"] = """
SELECT CAST(timestamp AS TIMESTAMP) AS called_at, model, prompt_version, kpi_name, TRY_CAST(anomaly_date AS DATE) AS anomaly_date, input_tokens, output_tokens,
       estimated_cost_usd, latency_ms, true AS success, array_to_string(quality_flags, ',') AS quality_flags FROM calls"""
Q["narratives_upsert"] = f"""
SELECT kpi_name, anomaly_date, narrative_type, 'v3' AS prompt_version, narrative_text || ' (revised)' AS narrative_text,
       CASE WHEN anomaly_date < DATE '1998-01-01' THEN retrieved_context ELSE '[]' END AS retrieved_context, generated_at FROM ({RAG_PARSED})"""
Q["table_kpi_results"] = "SELECT kpi_name, date AS week_date, value FROM series"
Q["table_anomalies"] = (
    "SELECT id, kpi_name, anomaly_date, severity, direction, detection_methods, "
    + rounding("confidence actual_value expected_value deviation_pct") + " FROM anomaly_table"
)
Q["table_root_causes"] = "SELECT * FROM cause_table"
Q["table_raw_transactions"] = "SELECT * EXCLUDE (unit_price), CAST(unit_price AS DOUBLE) AS unit_price FROM raw"


def oracle_queries() -> dict[str, str]:
    return {name: build(sql) if not sql.lstrip().startswith("WITH") else _prepend(sql) for name, sql in Q.items()}


def _prepend(sql: str) -> str:
    """A query with blocks of its own: the shared ones go before them."""
    body = sql.lstrip()[len("WITH"):]
    head = build(body)
    shared, own = head[: head.index(body.strip())].rstrip(), body.strip()
    return f"{shared},\n{own}"
