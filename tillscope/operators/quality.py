"""Data-quality checks against the contract. Row checks share one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope import catalogue as cat
from tillscope.functions import dates
from tillscope.operators.quantiles import quantiles
from tillscope.sources.transactions import repeated_rows
from tillscope.schemas import TRANSACTIONS

_FAMILIES = {
    "string": (T.StringType,),
    "integer": (T.IntegerType, T.LongType, T.ShortType, T.ByteType),
    "float": (T.DoubleType, T.FloatType, T.DecimalType),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


class QualityGateError(ValueError):
    """Raised when the contract says a breach stops the load."""


def _family(kind: T.DataType) -> str | None:
    return next((name for name, kinds in _FAMILIES.items() if isinstance(kind, kinds)), None)


def schema_errors(df: DataFrame, expected: T.StructType = TRANSACTIONS) -> list[str]:
    """Missing columns and wrong type families; extra columns are allowed. Runs no job."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in expected.fields if f.name not in actual]
    errors = [f"Missing columns: {sorted(missing)}"] if missing else []
    for f in expected.fields:
        if f.name in actual and _family(f.dataType) != _family(actual[f.name]):
            errors.append(f"Column '{f.name}': expected {f.dataType.simpleString()}, got {actual[f.name].simpleString()}")
    return errors


def extra_columns(df: DataFrame, expected: T.StructType = TRANSACTIONS) -> list[str]:
    return sorted(set(df.columns) - set(expected.names))


# ---------------------------------------------------------------- one-pass row checks


def _value() -> Column:
    return F.col("Quantity") * F.col("UnitPrice")


def _is_cancellation() -> Column:
    return F.coalesce(F.col("InvoiceNo").startswith("C"), F.lit(False))


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def _rows_of(totals: DataFrame, structs: list[Column]) -> DataFrame:
    """One-row aggregate to one row per check."""
    return totals.select(F.inline(F.array(*structs)))


def completeness(df: DataFrame, limits: dict = cat.COMPLETENESS_LIMITS) -> DataFrame:
    """Null count and share per column against the allowed share."""
    columns = [c for c in limits if c in df.columns]
    totals = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _rows_of(totals, [_completeness_row(c, limits[c]) for c in columns])


def _completeness_row(c: str, limit: float) -> Column:
    share = F.coalesce(_share(F.col(c), F.col("n")), F.lit(0.0))
    return F.struct(
        F.lit(c).alias("column_name"),
        F.col(c).alias("missing_count"),
        share.alias("missing_share"),
        F.lit(float(limit)).alias("threshold"),
        (share <= limit).alias("passes"),
    )


def value_ranges(df: DataFrame, ranges: dict = cat.VALUE_RANGES) -> DataFrame:
    """Rows below the minimum or above the maximum, with the extremes found."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c, (low, high) in ranges.items():
        aggs += [
            F.count_if((F.col(c) < low) | (F.col(c) > high)).alias(f"{c}_bad"),
            F.min(c).cast("double").alias(f"{c}_min"),
            F.max(c).cast("double").alias(f"{c}_max"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}_bad").alias("violations"),
            F.coalesce(_share(F.col(f"{c}_bad"), F.col("n")), F.lit(0.0)).alias("violation_share"),
            F.lit(float(low)).alias("min_value"),
            F.lit(float(high)).alias("max_value"),
            F.col(f"{c}_min").alias("actual_min"),
            F.col(f"{c}_max").alias("actual_max"),
            (F.col(f"{c}_bad") == 0).alias("passes"),
        )
        for c, (low, high) in ranges.items()
    ]
    return _rows_of(df.agg(*aggs), rows)


def consistency_rules(value_limit: float = cat.MAX_TRANSACTION_VALUE) -> dict[str, tuple[Column, Column]]:
    """Rule name to (rows it looks at, rows that break it).

    A cancellation with quantity zero passes, and the value limit itself passes.
    """
    everything = F.lit(True)
    return {
        "cancellation_quantity_match": (_is_cancellation(), F.col("Quantity") > 0),
        "positive_price": (everything, F.col("UnitPrice") < 0),
        "valid_transaction_value": (everything, F.abs(_value()) > value_limit),
    }


def consistency(df: DataFrame, value_limit: float = cat.MAX_TRANSACTION_VALUE, rules: list[str] | None = None) -> DataFrame:
    chosen = {n: r for n, r in consistency_rules(value_limit).items() if rules is None or n in rules}
    aggs = []
    for name, (scope, broken) in chosen.items():
        aggs += [F.count_if(scope).alias(f"{name}_n"), F.count_if(scope & broken).alias(f"{name}_bad")]
    rows = [
        F.struct(
            F.lit(n).alias("rule"),
            F.col(f"{n}_bad").alias("violations"),
            F.col(f"{n}_n").alias("total_checked"),
            (F.col(f"{n}_bad") == 0).alias("passes"),
        )
        for n in chosen
    ]
    return _rows_of(df.agg(*aggs), rows)


def quality_checks(
    df: DataFrame,
    value_limit: float = cat.MAX_TRANSACTION_VALUE,
    limits: dict = cat.COMPLETENESS_LIMITS,
    ranges: dict = cat.VALUE_RANGES,
) -> DataFrame:
    """Every executed check as ``(check_group, check_name, passes)``, from one pass over the rows."""
    rules = consistency_rules(value_limit)
    columns = [c for c in limits if c in df.columns]
    ranged = {c: r for c, r in ranges.items() if c in df.columns}
    totals = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        *[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"range_{c}") for c, (lo, hi) in ranged.items()],
        *[F.count_if(scope & broken).alias(f"rule_{n}") for n, (scope, broken) in rules.items()],
    )

    def row(group, name, passes):
        return F.struct(F.lit(group).alias("check_group"), F.lit(name).alias("check_name"), passes.alias("passes"))

    rows = [row("schema", "schema", F.lit(not schema_errors(df)))]
    rows += [
        row("completeness", c, F.coalesce(_share(F.col(f"null_{c}"), F.col("n")), F.lit(0.0)) <= limits[c]) for c in columns
    ]
    rows += [row("value_range", c, F.col(f"range_{c}") == 0) for c in ranged]
    rows += [row("consistency", n, F.col(f"rule_{n}") == 0) for n in rules]
    return _rows_of(totals, rows)


def quality_report(
    df: DataFrame, minimum: float = cat.MIN_QUALITY_SCORE, warning: float = cat.WARN_QUALITY_SCORE, **options
) -> DataFrame:
    """Score, pass and fail counts, the recommendation, and the score's band (fail, warn, ok), one row."""
    score_ = F.col("overall_quality_score")
    passed = F.count_if("passes")
    score = F.try_divide(passed.cast("double"), F.count(F.lit(1)))
    return quality_checks(df, **options).agg(
        score.alias("overall_quality_score"),
        F.count(F.lit(1)).alias("total_checks"),
        passed.alias("passed_checks"),
        F.count_if(~F.col("passes")).alias("failed_checks"),
    ).withColumns(
        {
            "recommendation": F.when(score_ >= minimum, "PASS").otherwise("FAIL"),
            "band": F.when(score_ < minimum, "fail").when(score_ < warning, "warn").otherwise("ok"),
        }
    )


def quality_gate(df: DataFrame, on_breach: str = "fail", **options) -> DataFrame:
    """Pass the frame on, or raise: always on a schema mismatch, on a low score if ``fail``."""
    errors = schema_errors(df)
    if errors:
        raise QualityGateError("; ".join(errors))
    report = quality_report(df, **options).first()
    if report["recommendation"] == "FAIL" and on_breach == "fail":
        raise QualityGateError(f"quality score {report['overall_quality_score']:.2%} is below the minimum")
    return df


# ------------------------------------------------------------------- column tests


def failing_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Failing-row count per column, as the SQL column tests report it."""
    totals = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _rows_of(totals, [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns])


def failing_unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; nulls are not tested."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .where(F.col("n_records") > 1)
    )


# ------------------------------------------------- checks the contract declares besides


def pattern_violations(df: DataFrame, patterns: dict = cat.PATTERNS) -> DataFrame:
    """Non-null values that do not match; null is a matter for completeness."""
    totals = df.agg(*[F.count_if(~F.col(c).rlike(p)).alias(c) for c, p in patterns.items()])
    return _rows_of(totals, [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in patterns])


def length_violations(df: DataFrame, limits: dict = cat.MAX_LENGTHS) -> DataFrame:
    totals = df.agg(*[F.count_if(F.length(c) > n).alias(c) for c, n in limits.items()])
    return _rows_of(totals, [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in limits])


def date_bound_violations(df: DataFrame, bounds: tuple = cat.DATE_BOUNDS, column: str = "InvoiceDate") -> DataFrame:
    low, high = (F.lit(b).cast("timestamp_ntz") for b in bounds)
    ts = F.col(column)
    return df.agg(
        F.count_if(ts < low).alias("too_early"),
        F.count_if(ts > high).alias("too_late"),
        F.min(ts).alias("earliest"),
        F.max(ts).alias("latest"),
    )


def future_dates(df: DataFrame, as_of: Column | None = None, column: str = "InvoiceDate") -> DataFrame:
    as_of = F.current_date() if as_of is None else as_of
    return df.agg(F.count_if(F.col(column) > as_of.cast("timestamp_ntz")).alias("violations"))


def zero_price_share(df: DataFrame, limit: float = cat.MAX_ZERO_PRICE_SHARE) -> DataFrame:
    zero = F.count_if(F.col("UnitPrice") == 0)
    share = F.coalesce(_share(zero, F.count("UnitPrice")), F.lit(0.0))
    return df.agg(zero.alias("zero_prices"), share.alias("zero_share"), (share <= limit).alias("passes"))


def iqr_outliers(df: DataFrame, column: str = "Quantity", multiplier: float = cat.IQR_MULTIPLIER) -> DataFrame:
    """Exact quartile fences and the rows outside them, in counting passes over the column."""
    (q1, q3), _ = quantiles(df, column, [0.25, 0.75])
    fences = (None, None) if q1 is None else (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
    v = F.col(column).cast("double")
    low, high = (F.lit(f).cast("double") for f in fences)
    return df.agg(
        *[F.lit(x).cast("double").alias(n) for n, x in (("q1", q1), ("q3", q3), ("lower_fence", fences[0]), ("upper_fence", fences[1]))],
        F.count_if((v < low) | (v > high)).alias("outliers"),
        F.count(v).alias("n_values"),
    )


#: Spans of at least a million and three levels of them cover all 64-bit positions.
_LEAST_SPAN, _SEAM_LEVELS = 1_000_000, 3


def monotonic_violations(df: DataFrame, order: str, column: str = "InvoiceDate", span: int = 1_000_000) -> DataFrame:
    """Rows dated before the row just ahead of them in load order.

    ``order`` is a whole-number load position. Order is cut into spans of positions, so no
    task sees more than one span's distinct positions; the seam between two spans is
    checked from the first and last position of each. Rows sharing a position are reduced
    to their first and last date before any window runs.
    """
    positions = df.groupBy(F.col(order).alias("pos")).agg(
        F.min(column).alias("low"), F.max(column).alias("high"), F.count(F.lit(1)).alias("rows")
    ).withColumn("span", F.floor(F.col("pos") / span))
    inside = Window.partitionBy("span").orderBy("pos")
    steps = positions.select(
        F.when(F.col("low") < F.lag("high").over(inside), 1).otherwise(0).alias("bad"), F.lit(0).alias("seams")
    )
    edges = positions.groupBy("span").agg(
        F.min_by("low", "pos").alias("low"), F.max_by("high", "pos").alias("high")
    )
    return steps.unionByName(_seams(edges, span)).agg(F.sum("bad").alias("violations"))


def _seams(edges: DataFrame, span: int) -> DataFrame:
    """Steps back between the spans of ``edges``: within coarser spans of spans, then between those.

    Every level has ``span`` times fewer groups, so three levels end at one group for any
    64-bit position and no task orders more than ``span`` rows.
    """
    level, found = edges.withColumn("pos", F.col("span")), []
    for _ in range(_SEAM_LEVELS):
        level = level.withColumn("span", F.floor(F.col("pos") / max(span, _LEAST_SPAN)))
        inside = Window.partitionBy("span").orderBy("pos")
        found.append(level.select(F.when(F.col("low") < F.lag("high").over(inside), 1).otherwise(0).alias("bad"), F.lit(1).alias("seams")))
        level = level.groupBy("span").agg(F.min_by("low", "pos").alias("low"), F.max_by("high", "pos").alias("high")).withColumn("pos", F.col("span"))
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def duplicate_rate(df: DataFrame, limit: float = cat.MAX_DUPLICATE_RATE) -> DataFrame:
    """Share of rows that repeat an earlier row in every column.

    Rows are counted by fingerprint, so what is shuffled does not depend on their width; those
    whose fingerprint repeats are then compared in full.
    """
    counts, repeated = repeated_rows(df)
    groups = repeated.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.where("n = 1").select("n").unionByName(groups.select("n"))
    rate = F.coalesce(_share(F.sum(F.col("n") - 1), F.sum("n")), F.lit(0.0))
    return parts.agg(
        F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"), rate.alias("duplicate_rate")
    ).withColumn("passes", F.col("duplicate_rate") <= limit)


def temporal_gaps(df: DataFrame, max_gap_days: int = cat.MAX_GAP_DAYS, column: str = "InvoiceDate") -> DataFrame:
    """Stretches without data. The window runs over distinct calendar days only."""
    days = df.select(dates.day(F.col(column)).alias("day")).distinct()
    ahead = Window.orderBy("day")
    return (
        days.withColumn("next_day", F.lead("day").over(ahead))
        .withColumn("gap_days", F.datediff("next_day", "day"))
        .where(F.col("gap_days") > max_gap_days)
    )


def daily_row_counts(
    df: DataFrame, minimum: int = cat.MIN_DAILY_ROWS, warning: int = cat.WARN_DAILY_ROWS, column: str = "InvoiceDate"
) -> DataFrame:
    """Rows of every calendar day from the first to the last, those without any included, and their band.

    Undated rows are not counted. The calendar is made from the first and last day alone.
    """
    n = F.coalesce("n_rows", F.lit(0)).cast("bigint")
    band = F.when(n < minimum, "fail").when(n < warning, "warn").otherwise("ok")
    counted = df.groupBy(dates.day(F.col(column)).alias("day")).agg(F.count(F.lit(1)).alias("n_rows")).where("day is not null")
    span = counted.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first is not null")
    calendar = span.select(F.explode(F.sequence("first", "last")).alias("day"))
    return calendar.join(counted, "day", "left").select("day", n.alias("n_rows"), band.alias("status"))


def freshness(df: DataFrame, as_of: Column, max_hours: int = cat.MAX_DELAY_HOURS, column: str = "InvoiceDate") -> DataFrame:
    latest = df.agg(F.max(column).alias("latest"))
    hours = F.timestamp_diff("HOUR", F.col("latest"), as_of.cast("timestamp_ntz"))
    return latest.withColumn("delay_hours", hours).withColumn("passes", F.col("delay_hours") <= max_hours)


def disallowed_values(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Values outside the allowed list with their row counts; reduced before the join."""
    found = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.join(allowed.select(column).distinct(), column, "left_anti")
