import datetime as dt
import time
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.operators import detection as det
from tillscope.operators import trend


def rows(df):
    return {(r["kpi_name"], r["date"]): r for r in df.collect()}


WEEK = [dt.date(2020, 1, 5) + dt.timedelta(weeks=i) for i in range(40)]


def test_short_and_constant_series_are_skipped(make_series):
    series = make_series({"six": [1, 1, 1, 1, 1, 99], "flat": [5] * 12})
    for found in (det.detect_zscore(series, 1.0), det.detect_iqr(series), det.detect_trend(series)):
        assert found.count() == 0


def test_seven_points_reach_point_methods_only(make_series):
    series = make_series({"k": [1, 2, 1, 2, 1, 2, 50]})
    assert rows(det.detect_iqr(series)).keys() == {("k", WEEK[6])}
    assert det.detect_trend(series, 1.0).count() == 0


def test_zscore_at_the_threshold_is_flagged(make_series):
    # Baseline 0 and 2 alternating over ten points: mean 1, sample deviation sqrt(10/9).
    base = [0, 2] * 5
    std = math.sqrt(10 / 9)
    series = make_series({"k": base + [1 + 3 * std]})
    baseline = (str(WEEK[0]), str(WEEK[9]))
    threshold = abs((1 + 3 * std) - 1) / std
    hit = rows(det.detect_zscore(series, threshold, baseline))[("k", WEEK[10])]
    assert hit["confidence"] == 0.5 and hit["expected_value"] == 1.0 and hit["stat_value"] == pytest.approx(3.0)


def test_value_on_the_fence_is_not_flagged(make_series):
    # Quartiles of 0..8 are 2 and 6, so the fences are -4 and 12.
    baseline = (str(WEEK[0]), str(WEEK[8]))
    found = rows(det.detect_iqr(make_series({"k": [*range(9), 12, 12.5]}), baseline=baseline))
    assert found.keys() == {("k", WEEK[10])}
    hit = found[("k", WEEK[10])]
    assert hit["expected_value"] == 4.0 and hit["stat_value"] == 1.625 and hit["severity"] == "low"
    assert hit["confidence"] == 0.525


def test_short_baseline_falls_back_to_everything(make_series):
    series = make_series({"k": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]})
    few = det.baseline_statistics(series, (str(WEEK[0]), str(WEEK[3]))).first()
    enough = det.baseline_statistics(series, (str(WEEK[0]), str(WEEK[4]))).first()
    assert few["mean"] == 5.5 and few["n_baseline"] == 4
    assert enough["mean"] == 3.0


def detections(spark, entries):
    base = (10.0, 5.0, 5.0, 100.0)
    data = [(k, d, *base, method, "low", conf, 1.0, f"by {method}") for k, d, method, conf in entries]
    from tillscope.schemas import ANOMALIES

    return spark.createDataFrame(data, ANOMALIES)


def test_merge(spark):
    day, other = WEEK[0], WEEK[1]
    merged = det.merge_detections(
        detections(
            spark,
            [
                ("a", day, "zscore", 0.6), ("a", day, "iqr", 0.6),
                ("b", day, "zscore", 0.5), ("b", day, "iqr", 0.95),
                ("c", other, "iqr", 0.7), ("a", day, "mann_kendall", 0.97),
            ],
        )
    ).collect()
    assert len(merged) == 4
    by = {(r["kpi_name"], r["method"]): r for r in merged}
    tie = by[("a", "zscore_and_iqr")]
    assert tie["confidence"] == 0.7
    assert tie["description"] == "by zscore [Confirmed by 2 methods: zscore, iqr]"
    assert by[("b", "zscore_and_iqr")]["confidence"] == 0.99
    assert by[("b", "zscore_and_iqr")]["description"].startswith("by iqr ")
    assert by[("c", "iqr")]["description"] == "by iqr"
    assert by[("a", "mann_kendall")]["confidence"] == 0.97


def test_trend_of_a_rising_series(make_series):
    found = det.detect_trend(make_series({"up": range(12), "down": [-i * 0.01 for i in range(12)]}))
    by = {r["kpi_name"]: r for r in found.collect()}
    # n = 12 without ties: S = 66, variance 12 * 11 * 29 / 18, z = 65 / sqrt(variance).
    z = 65 / math.sqrt(12 * 11 * 29 / 18)
    assert by["up"]["stat_value"] == round(z, 4) and by["down"]["stat_value"] == -round(z, 4)
    assert by["up"]["severity"] == "high" and by["down"]["severity"] == "medium"
    assert by["up"]["date"] == WEEK[11] and by["up"]["deviation"] == 5.5
    assert "upward trend (p=0.000, slope=1.0000 per period)" in by["up"]["description"]


def test_trend_statistics_against_all_pairs(make_series):
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7]
    row = trend.trend_statistics(make_series({"k": values})).first()
    pairs = [(values[j] - values[i], j - i) for i in range(14) for j in range(i + 1, 14)]
    signs = [np.sign(d) for d, _ in pairs]
    assert row["s"] == sum(signs)
    assert (row["concordant"], row["discordant"], row["tied"]) == (signs.count(1), signs.count(-1), signs.count(0))
    assert row["slope"] == np.median([d / s for d, s in pairs])
    ties = [2, 2, 3, 2]  # ones, threes, fives, nines
    variance = (14 * 13 * 33 - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18
    assert row["var_s"] == pytest.approx(variance)


SERIES = {
    "walk": lambda rng, n: rng.normal(size=n).cumsum(),
    "ties": lambda rng, n: rng.integers(0, 4, n).astype(float),
    "tenths": lambda rng, n: np.round(rng.normal(size=n), 1),
    "constant": lambda rng, n: np.ones(n),
    "line": lambda rng, n: np.arange(n) * 0.1,
    "outliers": lambda rng, n: np.where(rng.random(n) < 0.1, 1e9, rng.random(n)),
    "offset": lambda rng, n: 1e6 + rng.normal(size=n),
}


def _all_slopes(values):
    i, j = np.triu_indices(len(values), 1)
    return (values[j] - values[i]) / (j - i)


@pytest.mark.parametrize("kind", SERIES)
def test_long_series_slope_is_exact(monkeypatch, kind):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(trend, "_HELD", 60)
    monkeypatch.setattr(trend, "_DRAWN", 300)
    for n in (13, 40, 41, 301):
        values = SERIES[kind](rng, n)
        assert trend.median_slope(values) == pytest.approx(np.median(_all_slopes(values)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 200])
def test_inversions_are_counted_and_listed(n):
    rng = np.random.default_rng(n)
    for ranks in (rng.permutation(n), rng.integers(0, 5, n), np.zeros(n, int)):
        i, j = np.triu_indices(n, 1)
        wrong = ranks[i] > ranks[j]
        assert trend.inversions(ranks) == wrong.sum()
        earlier, later = trend._inverted_pairs(ranks)
        assert sorted(zip(earlier.tolist(), later.tolist())) == sorted(zip(i[wrong].tolist(), j[wrong].tolist()))


def test_a_hundred_thousand_points_take_seconds():
    rng = np.random.default_rng(1)
    values = 0.01 * np.arange(100_000) + rng.normal(size=100_000)
    start = time.perf_counter()
    row = trend.series_statistics(values)
    assert time.perf_counter() - start < 20
    assert row["slope"] == pytest.approx(0.01, abs=1e-6)
    assert row["concordant"] + row["discordant"] + row["tied"] == 100_000 * 99_999 // 2


def test_detect_all_skips_two_series(make_series):
    wild = [1, 2, 1, 2, 1, 2, 1, 2, 99]
    series = make_series({"order_count": wild, "new_customers": wild, "revenue_by_country": wild})
    assert {r["kpi_name"] for r in det.detect_all(series).collect()} == {"order_count"}


def test_description_text(make_series):
    hit = det.detect_iqr(make_series({"k": [*range(9), 1234.5]}), baseline=(str(WEEK[0]), str(WEEK[8]))).first()
    assert hit["description"] == (
        "k was 30762.5% above expected on 2020-03-08 (actual: 1,234.50, expected: 4.00) — detected by iqr with 99% confidence"
    )


def test_display_and_counts(spark):
    found = detections(spark, [("a", WEEK[0], "iqr", 0.585), ("b", WEEK[0], "zscore", 0.6)])
    shown = det.anomaly_display(found).where(F.col("KPI") == "a").first()
    assert (shown["Confidence"], shown["Deviation"], shown["Severity"]) == ("58%", "100.0%", "LOW")
    counts = {(r["breakdown"], r["name"]): r["n"] for r in det.anomaly_counts(found).collect()}
    assert counts[("total", "all")] == 2 and counts[("kpis_affected", "all")] == 2 and counts[("severity", "low")] == 2


def test_published_confidences_follow_from_their_statistics():
    """Multipliers and confidences of known pure-quartile rows obey the same arithmetic."""
    for multiplier, confidence in ((2.4335, 0.687), (1.6685, 0.534)):
        assert round(min(0.99, 0.5 + (multiplier - 1.5) * 0.2), 3) == confidence
