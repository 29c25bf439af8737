"""The log of text-generation calls: loading rules, summaries and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions import dates, text



def succeeded() -> Column:
    return F.coalesce(F.col("status") == "success", F.lit(False))


def successful(calls: DataFrame) -> DataFrame:
    return calls.where(succeeded())


def _flags() -> Column:
    return F.coalesce(F.col("quality_flags"), F.array().cast("array<string>"))


def _version() -> Column:
    return F.coalesce(F.col("prompt_version"), F.lit("unknown"))


def _mean(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0))


def violations(flag: str = "contains_percentages") -> Column:
    """How often a flag was raised over the grouped calls."""
    return F.sum(F.size(F.filter(_flags(), lambda f: f == flag))).cast("bigint")


def evaluate_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Length, sentence count and quality flags of generated texts."""
    t = F.col(column)
    return texts.withColumns(
        {
            "output_length_chars": F.length(t),
            "output_sentence_count": text.sentence_count(t),
            "quality_flags": text.quality_flags(t),
        }
    )


def with_cost(calls: DataFrame) -> DataFrame:
    return calls.withColumn("estimated_cost_usd", text.call_cost(F.col("input_tokens"), F.col("output_tokens")))


def call_log_summary(calls: DataFrame) -> DataFrame:
    """Totals over the log. Cost counts every call; latency and tokens only successful ones."""
    ok = succeeded()
    good = F.count_if(ok)
    return calls.agg(
        F.count(F.lit(1)).alias("total_calls"),
        good.alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.round(_mean(good, F.count(F.lit(1))) * 100, 1).alias("success_rate_pct"),
        F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
        F.bround(_mean(F.sum(F.when(ok, F.col("latency_ms"))), good), 0).alias("avg_latency_ms"),
        F.bround(_mean(F.sum(F.when(ok, F.col("total_tokens"))), good), 0).alias("avg_tokens_per_call"),
    )


def flag_frequency(calls: DataFrame) -> DataFrame:
    """How often each flag was raised, and its share of the successful calls."""
    good = successful(calls)
    flags = good.select(F.explode(_flags()).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    total = good.agg(F.count(F.lit(1))).scalar()
    return flags.withColumn("pct_of_calls", F.round(F.try_divide(F.col("n").cast("double"), total) * 100, 4))


def version_stats(calls: DataFrame) -> DataFrame:
    """Successful calls per prompt version: cost and rounded latency."""
    n = F.count(F.lit(1))
    return (
        successful(calls)
        .groupBy(_version().alias("prompt_version"))
        .agg(
            n.alias("calls"),
            F.round(F.sum("estimated_cost_usd"), 6).alias("total_cost"),
            F.bround(_mean(F.sum("latency_ms"), n), 0).alias("avg_latency_ms"),
        )
    )


def version_violations(calls: DataFrame) -> DataFrame:
    """Per version: calls, percentage violations, mean latency and tokens."""
    n = F.count(F.lit(1))
    return (
        successful(calls)
        .groupBy(_version().alias("prompt_version"))
        .agg(
            n.alias("calls"),
            violations().alias("pct_violations"),
            _mean(F.sum("latency_ms"), n).alias("avg_latency_ms"),
            _mean(F.sum("total_tokens"), n).alias("avg_tokens"),
        )
    )


def prompt_version_stats(prompts: DataFrame, calls: DataFrame) -> DataFrame:
    """Every declared prompt version with its call statistics, zeros when never used."""
    stats = version_violations(calls).select("prompt_version", "calls", "pct_violations", "avg_latency_ms")
    return (
        prompts.select(F.col("id").alias("prompt_version"), "description")
        .join(stats, "prompt_version", "left")
        .fillna(0, subset=["calls", "pct_violations", "avg_latency_ms"])
    )


def latency_series(calls: DataFrame) -> DataFrame:
    """Latency by time and version of successful calls; unreadable times are dropped."""
    return (
        successful(calls)
        .select(
            dates.lenient_timestamp(F.col("timestamp")).alias("timestamp"),
            F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
            _version().alias("prompt_version"),
        )
        .where(F.col("timestamp").isNotNull())
        .orderBy("timestamp", "prompt_version", "latency_ms")
    )


def load_calls(log: DataFrame) -> DataFrame:
    """Log rows as the stored call table.

    A ``cost_usd`` column takes the place of the estimate; flags default to empty, dates
    are read leniently, and ``success`` is true unless the log says otherwise.
    """
    if "cost_usd" in log.columns:
        log = log.drop("estimated_cost_usd").withColumnRenamed("cost_usd", "estimated_cost_usd")

    def given(name, kind, default=None):
        return F.col(name) if name in log.columns else F.lit(default).cast(kind)

    flags = _flags() if "quality_flags" in log.columns else F.array().cast("array<string>")
    return log.select(
        F.to_timestamp_ntz("timestamp").alias("called_at"),
        "model",
        "prompt_version",
        "kpi_name",
        F.to_date(dates.lenient_timestamp(given("anomaly_date", "string"))).alias("anomaly_date"),
        given("input_tokens", "int").alias("input_tokens"),
        given("output_tokens", "int").alias("output_tokens"),
        given("estimated_cost_usd", "double", 0.0).alias("estimated_cost_usd"),
        given("latency_ms", "int").alias("latency_ms"),
        F.coalesce(given("success", "boolean", True), F.lit(True)).alias("success"),
        flags.alias("quality_flags"),
        F.current_timestamp().alias("loaded_at"),
    )


def monitoring_summary(table: DataFrame) -> DataFrame:
    """The SQL view over the stored table, which trusts ``success``."""
    return (
        table.groupBy("prompt_version")
        .agg(
            F.count(F.lit(1)).alias("total_calls"),
            F.count_if("success").alias("successful_calls"),
            F.round(F.try_divide(F.sum("latency_ms").cast("double"), F.count("latency_ms")), 0).alias("avg_latency_ms"),
            F.sum("estimated_cost_usd").alias("total_cost_usd"),
            F.try_divide(F.sum("input_tokens").cast("double"), F.count("input_tokens")).alias("avg_input_tokens"),
            F.try_divide(F.sum("output_tokens").cast("double"), F.count("output_tokens")).alias("avg_output_tokens"),
            F.count_if(F.size("quality_flags") > 0).alias("calls_with_violations"),
        )
        .orderBy("prompt_version")
    )
