"""Time buckets. KPI series label a week by its Sunday, the marts by its Monday."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def week_end(ts: Column) -> Column:
    """The Sunday that ends the week (Monday 00:00 to Sunday 23:59:59)."""
    return F.date_add(week_start(ts), 6)


def day(ts: Column) -> Column:
    return F.to_date(ts)


def bucket(ts: Column, window: str) -> Column:
    if window == "W":
        return week_end(ts)
    if window == "D":
        return day(ts)
    raise ValueError(f"window must be 'W' or 'D', got {window!r}")


def midnight(date: Column) -> Column:
    return date.cast("timestamp_ntz")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def lenient_timestamp(text: Column) -> Column:
    """Parse a timestamp string; null when it cannot be parsed."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")
