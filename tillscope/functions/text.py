"""Display text, keys and generated-text checks as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope import catalogue as cat
from tillscope.functions.literals import label_lookup
from tillscope.functions.numbers import fixed, half_even


def whole_percent(share: Column) -> Column:
    """``0.585`` as ``58%``: half-even, which is what a printed percentage shows."""
    return F.concat(fixed(share * 100, 0), F.lit("%"))


def direction(deviation: Column) -> Column:
    """above / below / null; zero counts as below."""
    return F.when(deviation.isNull(), None).when(deviation > 0, "above").otherwise("below")


def side(deviation: Column) -> Column:
    """above / below where a missing deviation counts as zero."""
    return F.when(deviation > 0, "above").otherwise("below")


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def anomaly_sentence(kpi, date, pct, deviation, actual, expected, method, confidence) -> Column:
    # Fixed format.
    return F.concat(
        kpi, F.lit(" was "), fixed(F.abs(pct), 1), F.lit("% "), side(deviation), F.lit(" expected on "), iso(date),
        F.lit(" (actual: "), fixed(actual, 2, grouped=True), F.lit(", expected: "), fixed(expected, 2, grouped=True), F.lit(")"),
        F.lit(" — detected by "), method, F.lit(" with "), whole_percent(confidence), F.lit(" confidence"),
    )


# Fixed format.
def confirmed_suffix(n: Column, methods: Column) -> Column:
    return F.concat(F.lit(" [Confirmed by "), n.cast("string"), F.lit(" methods: "), methods, F.lit("]"))


# Fixed format.
def trend_sentence(kpi, s, p, slope, last, mean) -> Column:
    return F.concat(
        kpi, F.lit(" shows a statistically significant "), F.when(s > 0, "upward").otherwise("downward"),
        F.lit(" trend (p="), fixed(p, 3), F.lit(", slope="), fixed(slope, 4), F.lit(" per period). Current value "),
        fixed(last, 2, grouped=True), F.lit(" vs series mean "), fixed(mean, 2, grouped=True), F.lit("."),
    )


# Fixed format.
def root_cause_sentence(kpi, date, pct, deviation, status, dimension, segment, contribution) -> Column:
    explained = F.concat(
        kpi, F.lit(" was "), fixed(F.abs(pct), 1), F.lit("% "), side(deviation), F.lit(" expected on "), iso(date),
        F.lit(". Primary driver: "), dimension, F.lit("="), segment,
        F.lit(" accounted for "), fixed(contribution, 1), F.lit("% of the deviation."),
    )
    manual = F.concat(
        kpi, F.lit(" anomaly on "), iso(date),
        F.lit(" requires manual investigation - ratio KPI cannot be directly segmented."),
    )
    return (
        F.when((status == "analysed") & dimension.isNotNull(), explained)
        .when(status == "manual_review_required", manual)
        .otherwise(F.lit(""))
    )


def _drivers(pattern) -> Column:
    parts = [
        F.when(F.col(f"driver_{i}_dimension").isNotNull(), pattern(i)) for i in (1, 2, 3)
    ]
    return F.concat_ws(", ", *parts)


def drivers_plain(empty: str) -> Column:
    text = _drivers(lambda i: F.concat(F.col(f"driver_{i}_dimension"), F.lit(" = "), F.col(f"driver_{i}_segment")))
    return F.when(text == "", empty).otherwise(text)


def drivers_with_share(empty: str) -> Column:
    text = _drivers(
        lambda i: F.concat(
            F.col(f"driver_{i}_dimension"), F.lit("="), F.col(f"driver_{i}_segment"),
            F.lit(" ("), fixed(F.col(f"driver_{i}_contribution_pct"), 1), F.lit("% of deviation)"),
        )
    )
    return F.when(text == "", empty).otherwise(text)


def document_label(kpi: Column) -> Column:
    return label_lookup(kpi, cat.DOCUMENT_LABELS)


def month_year(date: Column) -> Column:
    return F.date_format(date, "MMMM yyyy")


def anomaly_document() -> Column:
    """The text stored for retrieval, from a flat root-cause row. Fixed format."""
    pct = F.abs(F.coalesce(F.col("total_deviation_pct"), F.lit(0.0)))
    return F.concat(
        F.lit("KPI: "), document_label(F.col("kpi_name")),
        F.lit(". Date: "), month_year(F.col("date")),
        F.lit(". Severity: "), F.coalesce(F.col("anomaly_severity"), F.lit("unknown")),
        F.lit(". The metric was "), fixed(pct, 1), F.lit("% "), side(F.col("total_deviation")),
        F.lit(" expected. Status: "), F.coalesce(F.col("status"), F.lit("unknown")),
        F.lit(". Top drivers: "), drivers_plain("no drivers identified"), F.lit("."),
    )


def query_document(kpi: Column, severity: Column, pct: Column, side_text: Column) -> Column:
    """The query text for an anomaly; a bare KPI gets a closing phrase. Fixed format."""
    severity_part = F.when(severity.isNotNull() & (severity != ""), F.concat(F.lit(" Severity: "), severity, F.lit(".")))
    deviation_part = F.when(
        pct.isNotNull() & side_text.isNotNull(),
        F.concat(F.lit(" The metric was "), fixed(pct, 1), F.lit("% "), side_text, F.lit(" expected.")),
    )
    tail = F.concat(F.coalesce(severity_part, F.lit("")), F.coalesce(deviation_part, F.lit("")))
    return F.concat(
        F.lit("KPI: "), document_label(kpi), F.lit("."), F.when(tail == "", " Anomaly detected.").otherwise(tail)
    )


def narrative_key(kpi: Column, date: Column) -> Column:
    return F.concat_ws("_", kpi, iso(date))


_KEY = r"^(.*)_([^_]*)$"


def key_label(key: Column) -> Column:
    """The title-cased part before the last underscore; a key without one is shown as it is."""
    titled = F.initcap(F.replace(F.regexp_extract(key, _KEY, 1), F.lit("_"), F.lit(" ")))
    return F.when(key.rlike(_KEY), titled).otherwise(key)


def key_date(key: Column) -> Column:
    return F.when(key.rlike(_KEY), F.regexp_extract(key, _KEY, 2))


def format_kpi_value(kpi: Column, value: Column) -> Column:
    """Dashboard form: pounds, percent or plain, with millions and thousands scaling."""
    millions, thousands = value >= 1_000_000, value >= 1_000
    pound = F.lit("£")
    currency = (
        F.when(millions, F.concat(pound, fixed(value / 1_000_000, 2), F.lit("M")))
        .when(thousands, F.concat(pound, fixed(value, 0, grouped=True)))
        .otherwise(F.concat(pound, fixed(value, 2)))
    )
    percent = F.concat(fixed(F.when(value <= 1, value * 100).otherwise(value), 1), F.lit("%"))
    plain = (
        F.when(millions, F.concat(fixed(value / 1_000_000, 1), F.lit("M")))
        .when(thousands, fixed(value, 0, grouped=True))
        .otherwise(fixed(value, 1))
    )
    return F.when(kpi.isin(*cat.CURRENCY_KPIS), currency).when(kpi.isin(*cat.PERCENT_KPIS), percent).otherwise(plain)


def report_kpi_value(kpi: Column, value: Column) -> Column:
    """Owner-report form, chosen by words in the name; rates come before revenue."""
    name = F.lower(kpi)
    return (
        F.when(name.rlike("rate|share|concentration"), F.concat(fixed(value * 100, 2), F.lit("%")))
        .when(name.rlike("revenue|price"), F.concat(F.lit("£"), fixed(value, 2, grouped=True)))
        .otherwise(fixed(value, 0, grouped=True))
    )


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def sentence_count(text: Column) -> Column:
    """Full stops and exclamation marks, decimals included."""
    return count_char(text, ".") + count_char(text, "!")


def quality_flags(text: Column) -> Column:
    """Heuristic flags on a generated text, in fixed order."""
    checks = [
        (F.length(text) < cat.MIN_TEXT_CHARS, "output_too_short"),
        (F.length(text) > cat.MAX_TEXT_CHARS, "output_too_long"),
        (sentence_count(text) > cat.MAX_TEXT_SENTENCES, "too_many_sentences"),
        (~text.rlike(r"\S"), "empty_output"),
        (F.lower(text).startswith("i "), "starts_with_i"),
        (F.lower(text).contains("percent") | text.contains("%"), "contains_percentages"),
    ]
    return F.array_compact(F.array(*[F.when(test, flag) for test, flag in checks]))


def call_cost(input_tokens: Column, output_tokens: Column) -> Column:
    cost = (input_tokens / 1_000_000) * cat.COST_PER_M_INPUT + (output_tokens / 1_000_000) * cat.COST_PER_M_OUTPUT
    return half_even(cost, 8)
