import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillscope import catalogue as cat
from tillscope.functions import metrics as m
from tillscope.operators import kpis
from tillscope.sources.transactions import with_derived

# A weekend of six lines: one return, one foreign order, one repeat customer, one guest.
ROWS = [
    ("100001", "2021-03-06 10:00", "A", 2, 5, "c1", "United Kingdom"),
    ("100001", "2021-03-06 10:00", "B", 1, 10, "c1", "United Kingdom"),
    ("100002", "2021-03-07 15:30", "A", 4, 5, "c1", "United Kingdom"),
    ("100003", "2021-03-08 09:00", "C", 3, 20, "c2", "France"),
    ("C100004", "2021-03-08 09:30", "C", -1, 20, "c2", "France"),
    ("100005", "2021-03-09 09:00", "B", 1, 10, None, "United Kingdom"),
]


@pytest.fixture(scope="module")
def tx(make_tx):
    return make_tx(ROWS)


def value(df, spec, **more):
    return m.evaluate(with_derived(df), {**more, "x": spec}, only=["x"]).first()["x"]


def test_primitives(tx):
    assert value(tx, m.Sum("Quantity")) == 10.0
    assert value(tx, m.Sum("Quantity", "UnitPrice")) == 90.0
    assert value(tx, m.Count("CustomerID")) == 5.0
    assert value(tx, m.CountDistinct("CustomerID")) == 2.0
    assert value(tx, m.Avg("UnitPrice")) == pytest.approx(70 / 6)
    assert value(tx, m.Avg("Quantity", "UnitPrice")) == 15.0
    assert value(tx, m.Min("UnitPrice")) == 5.0
    assert value(tx, m.Max("Quantity")) == 4.0


def test_conditions(tx):
    weekend = m.is_in("DayOfWeek", "Saturday", "Sunday")
    assert value(tx, m.Sum("Quantity", "UnitPrice", where=weekend)) == 40.0
    assert value(tx, m.Sum("TransactionValue", where=m.compare("Quantity", "<", 0))) == -20.0
    assert value(tx, m.Avg("TransactionValue", where=m.not_equal("Country", "United Kingdom"))) == 20.0
    # A conditional count is a distinct one: invoice 100001 has two lines of positive quantity.
    assert value(tx, m.Count("InvoiceNo", where=m.compare("Quantity", ">=", 1))) == 4.0


def test_not_equal_keeps_null_rows(tx):
    assert tx.where(m.not_equal("CustomerID", "c1")).count() == 3
    assert tx.where("CustomerID <> 'c1'").count() == 2


def test_empty_sum_is_zero_and_empty_average_is_null(tx):
    none = tx.where("Quantity > 100")
    assert value(none, m.Sum("Quantity")) == 0.0
    assert value(none, m.Avg("Quantity")) is None


def test_ratio_guard_and_operands(tx):
    assert value(tx, m.Ratio(m.Sum("Quantity"), m.Literal(0.0))) == 0.0
    assert value(tx, m.Ratio("Quantity", m.Literal(4.0))) == 2.5
    units = m.Sum("Quantity")
    assert value(tx, m.Ratio(m.KpiRef("units"), m.CountDistinct("InvoiceNo")), units=units) == 2.0


def test_bad_specs_are_refused(tx):
    with pytest.raises(ValueError):
        m.Sum("a", "b", "c").column()
    with pytest.raises(KeyError):
        value(tx, m.Ratio(m.KpiRef("missing"), m.Literal(1.0)))
    with pytest.raises(ValueError):
        m.evaluate(tx, {"x": m.Ratio(m.KpiRef("x"), m.Literal(1.0))})


def test_two_level_metrics(tx):
    assert value(tx, m.EntitiesOver("CustomerID", "InvoiceNo", 1)) == 2.0
    assert value(tx, m.EntitiesOver("CustomerID", "InvoiceNo", 2)) == 0.0
    assert value(tx, m.FirstSeen("CustomerID", "InvoiceDate")) == 2.0
    assert value(tx, m.FirstSeen("CustomerID", "InvoiceDate", "2021-03-07", "2021-03-31")) == 1.0
    assert value(tx, m.TopNSum("StockCode", 2)) == 70.0
    assert value(tx, m.TopNSum("HourOfDay", 1)) == 50.0


def test_all_time_catalogue(tx):
    row = kpis.kpi_all(tx).first().asDict()
    assert row["total_revenue"] == row["revenue_by_country"] == 90.0
    assert row["order_count"] == 5.0
    assert row["active_customers"] == row["new_customers"] == 2.0
    assert row["revenue_per_order"] == 18.0
    assert row["revenue_per_customer"] == 45.0
    assert row["items_per_order"] == 2.0
    assert row["avg_unit_price"] == 9.0
    assert row["repeat_customer_rate"] == 1.0
    assert row["product_return_rate"] == 0.2
    assert row["international_revenue_share"] == pytest.approx(40 / 90)
    assert row["weekend_revenue_share"] == pytest.approx(40 / 90)
    assert row["product_revenue_concentration"] == 1.0
    assert row["peak_hour_concentration"] == 1.0


@pytest.mark.parametrize("keys", [[], ["date"]])
def test_two_plans_agree(tx, keys):
    """The shared-pass plan and the one-aggregate-per-spec plan give the same catalogue."""
    dated = with_derived(tx).withColumn("date", F.date_add(F.to_date(F.date_trunc("week", "InvoiceDate")), 6))
    slow = m.evaluate(dated, cat.metric_specs(), keys)
    fast = kpis.kpi_windowed(tx) if keys else kpis.kpi_all(tx)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.select(*fast.columns).collect()))


def test_week_boundary(make_tx):
    rows = [
        ("1", "2021-03-07 00:00", "A", 1, 1, "c", "X"),
        ("2", "2021-03-07 15:30", "A", 1, 1, "c", "X"),
        ("3", "2021-03-08 00:00", "A", 1, 1, "c", "X"),
    ]
    weeks = {r["date"]: r["order_count"] for r in kpis.kpi_windowed(make_tx(rows)).collect()}
    assert weeks == {dt.date(2021, 3, 7): 2.0, dt.date(2021, 3, 14): 1.0}
    days = kpis.kpi_windowed(make_tx(rows), "D").collect()
    assert {r["date"]: r["units_sold"] for r in days} == {dt.date(2021, 3, 7): 2.0, dt.date(2021, 3, 8): 1.0}


def test_guest_only_week_has_zero_rates(make_tx):
    row = kpis.kpi_windowed(make_tx([("1", "2021-03-07 10:00", "A", 1, 3, None, "X")])).first()
    assert row["repeat_customer_rate"] == row["revenue_per_customer"] == row["new_customers"] == 0.0


def test_empty_table(make_tx):
    row = kpis.kpi_all(make_tx([])).first().asDict()
    assert set(row.values()) == {0.0}
    assert kpis.kpi_windowed(make_tx([])).count() == 0


def test_cadence_keeps_dependent_ratios(tx):
    row = kpis.kpi_all(tx, "weekly").first().asDict()
    assert len(row) == 9 and row["revenue_per_customer"] == 45.0


def test_top_products_beyond_twenty(make_tx):
    rows = [(str(i), "2021-03-03 10:00", f"p{i:02d}", i, 1, "c", "X") for i in range(1, 26)]
    row = kpis.kpi_all(make_tx(rows)).first()
    assert row["product_revenue_concentration"] == pytest.approx(sum(range(6, 26)) / sum(range(1, 26)))


def test_history_new_customers(tx):
    found = {r["date"]: r["new_customers"] for r in kpis.first_seen_customers(tx).collect()}
    assert found == {dt.date(2021, 3, 7): 1.0, dt.date(2021, 3, 14): 1.0}


def test_append_history_unions_columns(spark):
    old = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    new = spark.createDataFrame([(3.0, 4.0)], "a double, c double")
    out = kpis.append_history(old, new, F.lit("2024-01-01").cast("timestamp_ntz")).orderBy("a").collect()
    assert out[0]["c"] is None and out[1]["b"] is None and out[1]["calculation_date"] == dt.date(2024, 1, 1)


def test_catalogue():
    assert cat.KPI_NAMES == list(cat.metric_specs())
    assert len(cat.KPI_NAMES) == 16
    assert all(k.owner and k.cadence in ("daily", "weekly") for k in cat.KPIS)


def test_facts_give_the_same_kpis_as_the_rows(make_tx):
    tx = make_tx([*ROWS, ("200001", "2021-04-06 10:00", "A", 2, 5, "c1", "United Kingdom"), ("200001", "2021-04-06 11:00", "D", 2, 7, None, "Peru")])
    facts = kpis.kpi_facts(tx)
    assert kpis.kpis_of_facts(facts, False).collect() == kpis.kpi_all(tx).collect()
    assert sorted(kpis.kpis_of_facts(facts, True).collect()) == sorted(kpis.kpi_windowed(tx).collect())


def test_every_kpi_is_watched():
    assert list(cat.WATCHES) == cat.KPI_NAMES
    assert all(0 < w.sensitivity < 1 for w in cat.WATCHES.values())
    assert all(k.owner for k in cat.KPIS) and cat.WATCHES["product_return_rate"].critical_spike == 0.15


def test_sums_are_not_shuffled_with_invoices(spark, tx):
    """Only counts need invoices and customers; the sums of a week are made apart, over rows of null ids too."""
    loose = tx.limit(1).withColumns({"InvoiceNo": F.lit(None).cast("string"), "CustomerID": F.lit(None).cast("string")})
    rows = tx.unionByName(loose)
    plan = kpis.kpi_windowed(rows)._jdf.queryExecution().optimizedPlan().toString()
    by_invoice = [line for line in plan.splitlines() if "Aggregate [" in line and "InvoiceNo" in line]
    assert by_invoice and not any("sum(" in line for line in by_invoice)
    got = kpis.kpi_windowed(rows).agg(F.sum("total_revenue"), F.sum("units_sold"), F.sum("order_count")).first()
    extra = loose.select(F.sum(F.col("Quantity") * F.col("UnitPrice")).cast("double"), F.sum("Quantity").cast("double")).first()
    assert tuple(got) == (90.0 + extra[0], 10.0 + extra[1], 5.0)
    facts = kpis.kpi_facts(rows)
    assert kpis.kpis_of_facts(facts, True).orderBy("date").collect() == kpis.kpi_windowed(rows).orderBy("date").collect()
    assert kpis.kpis_of_facts(facts, False).collect() == kpis.kpi_all(rows).collect()
    assert kpis.kpi_all(rows.limit(0)).first()["total_revenue"] == 0.0


def test_products_and_hours_are_summed_without_repeating_rows(tx):
    """Only the small frame by invoice and customer is expanded; the rows are read by product and by hour as they are."""
    plan = kpis.kpi_windowed(tx)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Expand " in line for line in plan.splitlines()) == 1
