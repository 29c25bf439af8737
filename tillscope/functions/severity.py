"""Severity ladders. Fixed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    (first, label), *rest = steps
    out = F.when(value >= first, label)
    for step, name in rest:
        out = out.when(value >= step, name)
    return out.otherwise(otherwise)


def severity_zscore(z: Column) -> Column:
    return _ladder(F.abs(z), [(4.0, "critical"), (3.0, "high"), (2.5, "medium")], "low")


def severity_iqr(multiplier: Column) -> Column:
    return _ladder(multiplier, [(3.0, "critical"), (2.5, "high"), (2.0, "medium")], "low")


def severity_trend(p: Column, slope: Column) -> Column:
    steep = F.abs(slope)
    return (
        F.when(p <= 0.01, F.when(steep > 0.05, "high").otherwise("medium"))
        .when(p <= 0.05, F.when(steep > 0.02, "medium").otherwise("low"))
        .otherwise("low")
    )


def severity_rank(severity: Column) -> Column:
    """Ordinal form for callers who want the true maximum, not the alphabetical one."""
    return (
        F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)
    )
