import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillscope.operators import attribution as att
from tillscope.schemas import ANOMALIES, ROOT_CAUSES_FLAT

SUNDAY = dt.date(2021, 3, 28)


def anomaly(spark, *entries):
    data = [
        (kpi, day, 10.0, 10.0 - dev, dev, 50.0, method, "high", 0.8, 3.0, "x") for kpi, day, dev, method in entries
    ]
    return spark.createDataFrame(data, ANOMALIES)


@pytest.fixture(scope="module")
def tx(make_tx):
    # Two baseline weeks (14 days: scale one half) and the anomalous week of 28 March.
    base = [
        ("1", "2021-03-01 10:00", "A", 10, 1, "c1", "UK"),
        ("2", "2021-03-03 11:00", "B", 6, 1, "c2", "FR"),
        ("3", "2021-03-14 00:00", "A", 4, 1, "c1", "UK"),
        ("4", "2021-03-14 09:00", "A", 100, 1, "c9", "UK"),  # daytime of the last day: not baseline
    ]
    week = [
        ("5", "2021-03-22 10:00", "A", 27, 1, "c1", "UK"),
        ("6", "2021-03-23 11:00", "B", 3, 1, "c2", "FR"),
        ("7", "2021-03-24 12:00", "Z", 5, 1, "c3", "DE"),  # segments new in the week
        ("8", "2021-03-28 13:00", "A", 1000, 1, "c4", "UK"),  # Sunday daytime
    ]
    return make_tx(base + week)


BASELINE = ("2021-03-01", "2021-03-14")


def test_status_and_drivers(spark, tx):
    found = anomaly(
        spark,
        ("total_revenue", SUNDAY, 20.0, "zscore"),
        ("revenue_per_order", SUNDAY, 1.0, "iqr"),
        ("order_count", dt.date(2021, 6, 6), 1.0, "iqr"),
        ("units_sold", SUNDAY, 20.0, "mann_kendall"),
        ("units_sold", SUNDAY, 0.0, "iqr"),
    )
    causes = {r["kpi_name"]: r for r in att.root_cause_all(tx, found, BASELINE).collect()}
    assert {k: r["status"] for k, r in causes.items()} == {
        "total_revenue": "analysed",
        "revenue_per_order": "manual_review_required",
        "order_count": "insufficient_data",
        "units_sold": "analysed",
    }
    # Baseline runs 1 March 10:00 to 14 March 00:00: 12 whole days + 1, so the scale is 7/13.
    scale = 7 / 13
    drivers = {(d["dimension"], d["segment"]): d for d in causes["total_revenue"]["drivers"]}
    assert next(iter(drivers)) == ("HourOfDay", "10")  # 27 against 10 units beats UK's 27 against 14
    uk = 27 - 14 * scale
    assert drivers[("Country", "UK")]["contribution_pct"] == round(uk / 20 * 100, 1)
    assert drivers[("Country", "UK")]["deviation"] == round(uk, 2)
    assert {d["segment"] for d in causes["total_revenue"]["drivers"]}.isdisjoint({"DE", "Z", "12"})
    assert causes["units_sold"]["drivers"] == [] and causes["units_sold"]["summary"] == ""
    assert causes["total_revenue"]["dimensions_analysed"] == ["Country", "StockCode", "HourOfDay"]
    assert causes["total_revenue"]["summary"].startswith("total_revenue was 50.0% above expected on 2021-03-28. Primary driver: HourOfDay=10")
    assert "requires manual investigation" in causes["revenue_per_order"]["summary"]


def test_full_week_includes_sunday(spark, tx):
    found = anomaly(spark, ("total_revenue", SUNDAY, 20.0, "zscore"))
    drivers = att.root_cause_all(tx, found, BASELINE, full_week=True).first()["drivers"]
    assert max(d["actual"] for d in drivers) == 1027.0


def test_empty_baseline_falls_back(tx):
    profile = att.BaselineProfile(tx, ("1999-01-01", "1999-12-31"))
    assert profile.baseline is None and profile.days == 28


def shares(spark, entries):
    return spark.createDataFrame(
        [("k", SUNDAY, d, s, o, 0.0, 0.0, 0.0, c) for d, s, o, c in entries],
        "kpi_name string, date date, dimension string, segment string, segment_order int, actual double, "
        "expected double, deviation double, contribution_pct double",
    )


def test_cut_is_before_rounding(spark):
    # Revenue deviations of 2.0 and 1.96 on a total of 100; the second rounds to 2.0 but is out.
    metrics = spark.createDataFrame(
        [(True, None, "Country", s, 0, 0.0, 0.0, 0.0, 0.0, 0.0) for s in ("in", "out")]
        + [(False, SUNDAY, "Country", s, 0, v, 0.0, 0.0, 0.0, 0.0) for s, v in (("in", 2.0), ("out", 1.96))],
        "is_baseline boolean, period date, dimension string, segment string, segment_order int, "
        "revenue double, orders double, units double, customers double, items_per_order double",
    )
    kept = att.contributions(anomaly(spark, ("total_revenue", SUNDAY, 100.0, "iqr")), metrics, 1.0).collect()
    assert [(r["segment"], r["contribution_pct"]) for r in kept] == [("in", 2.0)]


def test_ranking_and_ties(spark):
    entries = [("HourOfDay", "10", 10, 5.0), ("HourOfDay", "9", 9, -5.0), ("Country", "B", 0, 5.0), ("Country", "A", 0, 5.0)]
    entries += [("StockCode", f"p{i}", i, 50.0 - i) for i in range(1, 8)]
    ranked = att.rank_drivers(shares(spark, entries)).orderBy("rank").collect()
    assert [r["segment"] for r in ranked] == ["p1", "p2", "p3", "p4", "p5", "A", "B", "9", "10"]


def flat_row(spark, **values):
    return spark.createDataFrame([tuple(values.get(n) for n in ROOT_CAUSES_FLAT.names)], ROOT_CAUSES_FLAT)


def test_explode_drivers(spark):
    none = att.explode_drivers(flat_row(spark, kpi_name="k", date=SUNDAY, status="manual_review_required")).collect()
    assert [(r["segment_rank"], r["dimension"]) for r in none] == [(0, None)]
    two = flat_row(
        spark, kpi_name="k", date=SUNDAY, status="analysed",
        driver_1_dimension="Country", driver_1_segment="UK", driver_1_contribution_pct=-5e9,
        driver_2_dimension="StockCode", driver_2_segment="23084", driver_2_contribution_pct=12.34567,
    )
    out = att.explode_drivers(two).orderBy("segment_rank").collect()
    assert [(r["segment_rank"], r["contribution_pct"]) for r in out] == [(1, -999999.9999), (2, 12.3457)]


def test_hot_country_and_guests_count_exactly(make_tx):
    rows = [(str(i % 700), "2021-03-01 10:00", "A", 1, 1, None if i % 3 else f"c{i % 40}", "UK") for i in range(2100)]
    out = {(r["dimension"], r["segment"]): r for r in att.segment_metrics(make_tx(rows), []).collect()}
    uk = out[("Country", "UK")]
    assert (uk["orders"], uk["customers"], uk["units"], uk["items_per_order"]) == (700.0, 40.0, 2100.0, 3.0)


def test_top_products_ties(make_tx):
    rows = [(str(i), "2021-03-01 10:00", s, 1, 1, "c", "UK") for i, s in enumerate("CAB")]
    assert [r["StockCode"] for r in att.top_products(make_tx(rows), n=2).collect()] == ["A", "B"]


def test_period_residuals(make_tx):
    rows = [("1", "2021-03-22 00:00", "A", 1, 1, "c", "X"), ("2", "2021-03-28 00:00", "A", 1, 1, "c", "X"), ("3", "2021-03-28 00:01", "A", 1, 1, "c", "X")]
    tx = make_tx(rows)
    day = F.lit(SUNDAY)
    ts = F.col("InvoiceDate")
    assert tx.where(att.in_anomaly_week(ts, day)).count() == 2
    assert tx.where(att.in_anomaly_week(ts, day, "D")).count() == 1
    assert tx.where(att.in_anomaly_week(ts, day, full_week=True)).count() == 3


def test_stored_weeks_are_pruned_and_agree(spark, tx, tmp_path):
    from tillscope.sources import transactions as src

    src.write_transactions(tx, str(tmp_path / "tx"))
    stored = src.read_transactions(spark, str(tmp_path / "tx"))
    rows = att.baseline_rows(stored, BASELINE)
    assert "2021-03-14" in rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert rows.count() == att.baseline_rows(tx, BASELINE).count() == 3
    found = anomaly(spark, ("total_revenue", SUNDAY, 20.0, "zscore"))
    profile = att.BaselineProfile(stored, BASELINE)
    for pruned in (att.period_and_baseline(stored, found, profile), att.anomaly_transactions(stored, found)):
        assert str(SUNDAY) in pruned._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert att.anomaly_transactions(stored, found).count() == att.anomaly_transactions(tx, found).count() > 0
    same = [att.root_cause_all(t, found, BASELINE).first()["drivers"] for t in (tx, stored)]
    assert same[0] == same[1] and len(same[0]) > 0


def test_names_of_dimensions_are_not_shuffled_with_invoices(spark, tx):
    """A dimension is a number until the segments are made. Rows of null ids, and of a null country, hour or product, count in the sums as before."""
    loose = tx.limit(1).withColumns({c: F.lit(None).cast("string") for c in ("InvoiceNo", "CustomerID", "Country")})
    undated = tx.limit(1).withColumn("InvoiceDate", F.lit(None).cast("timestamp_ntz"))
    rows = tx.unionByName(loose).unionByName(undated)
    ranked = spark.createDataFrame([("A", 1)], "StockCode string, product_rank int")
    for products in (None, ranked):
        metrics = att.segment_metrics(rows, [], products)
        plan = metrics._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("HourOfDay") < plan.index("Aggregate [")
        assert "HourOfDay" not in plan[plan.index("Aggregate [") :]
        got = {(r["dimension"], r["segment"]): (r["revenue"], r["units"], r["orders"], r["customers"]) for r in metrics.collect()}
        want = {}
        for dimension, segment in (("Country", "Country"), ("StockCode", "StockCode"), ("HourOfDay", "cast(hour(InvoiceDate) as string)")):
            kept = rows if dimension != "StockCode" or products is None else rows.where("StockCode = 'A'")
            for r in kept.groupBy(F.expr(segment).alias("s")).agg(
                F.sum(F.col("Quantity") * F.col("UnitPrice")).cast("double"),
                F.sum("Quantity").cast("double"),
                F.count_distinct("InvoiceNo").cast("double"),
                F.count_distinct("CustomerID").cast("double"),
            ).collect():
                want[dimension, r["s"]] = tuple(r[1:])
        assert got == want
