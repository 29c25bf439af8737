"""The whole batch: weekly series, all-time values, anomalies and root causes, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillscope import catalogue as cat
from tillscope.operators.attribution import flatten_drivers, root_cause_all
from tillscope.operators.detection import detect_all
from tillscope.operators.kpis import kpi_facts, kpi_windowed, kpis_of_facts, unpivot_kpis
from tillscope.session import stage
from tillscope.sources.files import write_cache


def weekly_series(tx: DataFrame, home_country: str = cat.HOME_COUNTRY) -> DataFrame:
    """The wide weekly KPI table, staged: one row per week, read by everything after it."""
    return stage(kpi_windowed(tx, "W", home_country), "kpi_timeseries")


def precompute_all(tx: DataFrame, path: str, home_country: str = cat.HOME_COUNTRY, baseline=None) -> None:
    """Three passes over the rows: the facts of both KPI tables, the baseline profile, the segments."""
    facts = stage(kpi_facts(tx, "W", home_country), "kpi_facts")
    wide = stage(kpis_of_facts(facts, True, home_country), "kpi_timeseries")
    anomalies = stage(detect_all(unpivot_kpis(wide), baseline), "anomalies")
    causes = flatten_drivers(root_cause_all(tx, anomalies, baseline))
    write_cache(
        path,
        kpi_timeseries=wide,
        kpi_latest=kpis_of_facts(facts, False, home_country),
        anomalies=anomalies,
        root_causes=causes,
    )
