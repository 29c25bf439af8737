"""One runnable query per operator, over the order-schema tables seen as transactions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope import catalogue as cat
from tillscope.functions import dates, text
from tillscope.functions import metrics as m
from tillscope.functions.literals import literal_frame
from tillscope.operators import attribution as att
from tillscope.operators import detection as det
from tillscope.operators import kpis, monitoring, quality, retrieval
from tillscope.operators.trend import trend_statistics
from tillscope.plans import incremental, marts, precompute, reports
from tillscope.session import app_id, configure, stage, stage_path
from tillscope.sources import files, tables, versions
from tillscope.sources import transactions as src

HOME = "NATION_2"
BASELINE = ("1996-01-01", "1998-12-31")
LATE = "1998-03-04"
DRIFT = 500.0
STAMP = "2024-01-01 00:00:00"

PROMPTS = [
    ("v0", "first wording", "Metric {kpi} moved on {date}."),
    ("v1", "second wording", "On {date} {kpi} was {deviation_pct:.1f}% {direction} plan ({severity})."),
    (
        "v2",
        "with drivers",
        "Explain in two sentences. {kpi} on {date}, severity {severity}: "
        "{deviation_pct:.1f}% {direction} expected. Drivers: {drivers_text}.",
    ),
]
RAG_PROMPT = [
    ("v2-rag", "with context", "{context}\nNow: {kpi} on {date} ({severity}), {deviation_pct:.1f}% {direction}; {drivers_text}.")
]


class Inputs:
    """Frames the queries start from. Small intermediate results are staged once per session."""

    _staged: dict[tuple, DataFrame] = {}
    _sources: dict[tuple, DataFrame] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    @classmethod
    def forget(cls) -> None:
        cls._staged.clear()

    def _once(self, name: str, build) -> DataFrame:
        key = (app_id(self.spark), self.folder, name)
        if key not in Inputs._staged:
            Inputs._staged[key] = stage(build(), name)
        return Inputs._staged[key]

    def _source(self, name: str, build) -> DataFrame:
        """An unexecuted source frame, kept so that file footers are read once per session."""
        key = (app_id(self.spark), self.folder, name)
        if key not in Inputs._sources:
            Inputs._sources[key] = build()
        return Inputs._sources[key]

    def table(self, name: str) -> DataFrame:
        return self._source(name, lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    @cached_property
    def tx(self) -> DataFrame:
        """The order tables as transactions, stored once per session: the mapping is a five-way join."""
        mapped = lambda: src.from_order_tables(self.spark, self.folder)
        return self._source("tx", lambda: stage(mapped(), "transactions"))

    @cached_property
    def derived(self) -> DataFrame:
        return src.with_derived(self.tx)

    @cached_property
    def weekly(self) -> DataFrame:
        return self._once("weekly", lambda: kpis.kpi_windowed(self.tx, "W", HOME))

    @cached_property
    def series(self) -> DataFrame:
        return kpis.unpivot_kpis(self.weekly)

    @cached_property
    def drifted(self) -> DataFrame:
        """The series with a steady drift added, so that trends are found."""
        return reports.series_position(self.series).withColumn("value", F.col("value") * (1 + F.col("position") / DRIFT)).drop("position")

    @cached_property
    def anomalies(self) -> DataFrame:
        return self._once("anomalies", lambda: det.detect_all(self.series, BASELINE))

    @cached_property
    def with_trends(self) -> DataFrame:
        return self._once("with_trends", lambda: det.detect_all(self.drifted, BASELINE))

    @cached_property
    def profile(self) -> att.BaselineProfile:
        return att.BaselineProfile(self.tx, BASELINE)

    @cached_property
    def causes(self) -> DataFrame:
        return self._once("causes", lambda: att.root_cause_all(self.tx, self.anomalies, BASELINE))

    @cached_property
    def flat(self) -> DataFrame:
        return att.flatten_drivers(self.causes)

    @cached_property
    def anomaly_table(self) -> DataFrame:
        return tables.load_anomalies(self.anomalies)

    @cached_property
    def cause_table(self) -> DataFrame:
        return tables.load_root_causes(self.flat, self.anomaly_table)

    @cached_property
    def kpi_table(self) -> DataFrame:
        """Every point loaded twice: a first, wrong value and the one that replaces it."""
        names = [c for c in self.weekly.columns if c != "date"]
        first = self.weekly.withColumns({c: F.col(c) + 1 for c in names}).withColumn("loaded", F.lit(1))
        return tables.load_kpi_results(self.weekly.withColumn("loaded", F.lit(2)).unionByName(first), "loaded")

    @cached_property
    def raw(self) -> DataFrame:
        return src.raw_table(self.tx).drop("loaded_at")

    @cached_property
    def stg(self) -> DataFrame:
        return marts.stg_transactions(self.raw)

    @cached_property
    def calls(self) -> DataFrame:
        """The event table seen as a call log."""
        value, kind = F.col("value"), F.col("event_type")
        flags = F.array_compact(
            F.array(
                F.when(value < 10, "output_too_short"),
                F.when(value > 150, "output_too_long"),
                F.when((kind == "purchase") | (value > 100), "contains_percentages"),
            )
        )
        log = self.table("events").select(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            F.lit("model-a").alias("model"),
            F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("prompt_version"),
            kind.alias("kpi_name"),
            F.when(kind == "signup", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("anomaly_date"),
            F.get_json_object("props", "$.k").cast("int").alias("input_tokens"),
            (F.col("event_id") % 200).cast("int").alias("output_tokens"),
            F.floor(value).cast("int").alias("latency_ms"),
            flags.alias("quality_flags"),
            F.when(kind == "error", "error").otherwise("success").alias("status"),
        )
        return monitoring.with_cost(log).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))

    def _entries(self, version: str) -> DataFrame:
        day = F.col("date").cast("string")
        return retrieval.with_key(att.explained(self.flat)).select(
            "key",
            "kpi_name",
            F.concat(day, F.lit(" 00:00:00")).alias("date"),
            F.lit(None).cast("string").alias("anomaly_date"),
            F.col("anomaly_severity").alias("severity"),
            F.col("summary").alias("narrative"),
            F.lit(None).cast("string").alias("narrative_text"),
            F.when(F.lit(version == "v2-rag") & (F.col("anomaly_severity") != "medium"), F.array(F.concat("kpi_name", F.lit("_"), day))).alias("retrieved_context"),
            F.lit(version).alias("prompt_version"),
            F.concat(day, F.lit(" 12:00:00")).alias("generated_at"),
        )

    @cached_property
    def narratives(self) -> DataFrame:
        """Stored narratives: those of the severe anomalies."""
        return self._entries("v2").where(F.col("severity").isin("high", "critical"))

    @cached_property
    def rag_narratives(self) -> DataFrame:
        return self._entries("v2-rag").where(F.col("severity") != "high")

    @cached_property
    def cause_vectors(self) -> DataFrame:
        """A vector for each stored anomaly: the embedding of its number in the order of dates and KPIs."""
        placed = retrieval.build_corpus(self.flat).select("id", "kpi_name", F.row_number().over(Window.orderBy("date", "kpi_name")).alias("vec_id"))
        return placed.join(self.table("embeddings"), "vec_id").select("id", "kpi_name", "embedding")

    @cached_property
    def corpus(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("kpi_name"), "embedding"
        )


def rounded(df: DataFrame, digits: int = 4, exact: tuple = ()) -> DataFrame:
    """Doubles rounded for comparison, since sums of doubles depend on their order."""
    return df.select(
        *[F.round(c, digits).alias(c) if k == "double" and c not in exact else F.col(c) for c, k in df.dtypes]
    )


def joined(df: DataFrame, **separators: str) -> DataFrame:
    """Array columns as text."""
    return df.withColumns({c: F.array_join(c, s) for c, s in separators.items()})


def driver_text(df: DataFrame, column: str = "drivers") -> DataFrame:
    shown = F.transform(
        column, lambda d: F.concat(d["dimension"], F.lit("="), d["segment"], F.format_string(":%.1f", d["contribution_pct"]))
    )
    return df.withColumn(column, F.array_join(shown, "; "))


QUERIES: dict[str, object] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, folder: fn(Inputs(spark, folder))
    QUERIES[fn.__name__].__name__ = fn.__name__
    return fn


# -------------------------------------------------------------- sources and sinks


@query
def scan_transactions_csv(x):
    path = _mixed_csv(x)
    rows = src.read_transactions_csv(x.spark, path, multiline=True, on_reject="skip")
    return rows.withColumn("UnitPrice", F.col("UnitPrice").cast("double"))


def _mixed_csv(x):
    """All transactions as CSV: a third with month-first dates, a third with a line break in the text, and bad copies."""
    path = stage_path(x.spark, "transactions_csv")
    kind = F.pmod(F.regexp_replace("InvoiceNo", "^C", "").cast("bigint"), F.lit(3))
    iso = F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")
    good = x.tx.select(
        "InvoiceNo",
        F.when(kind == 1, F.date_format("InvoiceDate", "M/d/yyyy H:mm")).otherwise(iso).alias("InvoiceDate"),
        "StockCode",
        F.when(kind == 2, F.concat("Description", F.lit("\n2nd \"line\""))).otherwise(F.col("Description")).alias("Description"),
        F.col("Quantity").cast("string").alias("Quantity"),
        F.col("UnitPrice").cast("string").alias("UnitPrice"),
        "CustomerID",
        "Country",
    )
    bad = good.where(kind == 0).withColumns(
        {
            "InvoiceDate": F.when(F.col("StockCode") % 2 == 0, "some day").otherwise(F.col("InvoiceDate")),
            "Quantity": F.when(F.col("StockCode") % 2 == 1, "many").otherwise(F.col("Quantity")),
        }
    )
    src.write_transactions_csv(good.unionByName(bad), path)
    return path


@query
def csv_rejects(x):
    return src.read_csv_rejects(x.spark, _mixed_csv(x), multiline=True).groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


@query
def sink_processed_csv(x):
    path = stage_path(x.spark, "processed_csv")
    src.write_transactions_csv(x.tx, path)
    back = src.read_transactions_csv(x.spark, path)
    return back.groupBy("Country").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("Quantity") * F.col("UnitPrice")).cast("double").alias("revenue")
    )


@query
def transactions_by_week_folder(x):
    path = stage_path(x.spark, "transactions")
    src.write_transactions(x.tx, path)
    return src.read_transactions(x.spark, path).groupBy("week_end").agg(F.count(F.lit(1)).alias("n"))


@query
def dataset_summary(x):
    return src.dataset_summary(x.tx)


@query
def append_kpi_history(x):
    cut = F.lit("1997-01-01").cast("date")
    history = x.weekly.where(F.col("date") < cut).select("date", "total_revenue", "order_count")
    history = history.withColumns({"timestamp": F.lit(STAMP).cast("timestamp_ntz"), "calculation_date": F.lit("2024-01-01").cast("date")})
    new = x.weekly.where(F.col("date") >= cut).select("date", "total_revenue", "units_sold")
    return kpis.append_history(history, new, F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"))


@query
def anomalies_sink_source(x):
    path = stage_path(x.spark, "anomalies_csv")
    files.write_anomalies(x.anomalies, path)
    return rounded(files.read_anomalies(x.spark, path))


@query
def root_causes_sink(x):
    path = stage_path(x.spark, "root_causes_csv")
    files.write_root_causes(x.flat, path)
    return rounded(files.read_root_causes(x.spark, path)).select(
        "kpi_name", "date", "status", "driver_1_segment", "driver_2_segment", "driver_3_segment", "driver_1_contribution_pct"
    )


def _cached(x, name):
    path = stage_path(x.spark, "cache")
    files.write_cache(
        path, kpi_timeseries=x.weekly, kpi_latest=kpis.kpi_all(x.tx, home_country=HOME), anomalies=x.anomalies, root_causes=x.flat
    )
    return files.read_cache(x.spark, path, name)


@query
def cache_materialise(x):
    path = stage_path(x.spark, "precomputed")
    precompute.precompute_all(x.tx, path, HOME, BASELINE)
    counts = [
        files.read_cache(x.spark, path, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
        for n in files.CACHE_TABLES
    ]
    return det.union_detections(*counts)


@query
def cache_refresh(x):
    """All rows in two loads that share a week: the second refresh reads the later weeks; a null date is all time."""
    table, path = stage_path(x.spark, "tx_by_week"), stage_path(x.spark, "refreshed")
    late = F.coalesce(F.col("InvoiceDate") >= F.lit(LATE).cast("timestamp_ntz"), F.lit(False))
    for rows, mode in ((~late, "overwrite"), (late, "append")):
        src.write_transactions(x.tx.where(rows), table, mode)
        incremental.refresh(src.read_transactions(x.spark, table), path, HOME, BASELINE)
    names = ["total_revenue", "order_count", "active_customers", "repeat_customer_rate", "product_revenue_concentration"]
    weekly = files.read_cache(x.spark, path, "kpi_timeseries").select("date", *names)
    return weekly.unionByName(files.read_cache(x.spark, path, "kpi_latest").select(F.lit(None).cast("date").alias("date"), *names))


@query
def cache_read(x):
    return _cached(x, "kpi_timeseries").select("date", "total_revenue", "order_count")


@query
def scan_call_log_jsonl(x):
    path = stage_path(x.spark, "calls_jsonl")
    files.append_call_log(x.calls, path)
    # Malformed and blank lines beside the good ones: both are skipped.
    x.spark.range(2).select(F.when(F.col("id") == 0, "{broken").otherwise("").alias("value")).write.mode("append").text(path)
    back = files.read_call_log(x.spark, path)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency"))


@query
def append_call_log(x):
    path = stage_path(x.spark, "calls_appended")
    good = x.calls.where(F.col("status") == "success")
    files.append_call_log(good, path)
    files.append_call_log(x.calls.where(F.col("status") != "success"), path)
    return files.read_call_log(x.spark, path, strict=True).groupBy("prompt_version").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_keyed_json(x):
    path = stage_path(x.spark, "keyed")
    entry = F.struct(*[c for c in x.narratives.columns if c != "key"])
    # One object per KPI and year: the calendar bounds its entries.
    objects = x.narratives.groupBy(F.col("kpi_name").alias("kpi"), F.substring("date", 1, 4).alias("year")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("key", entry)))).alias("value")
    )
    objects.write.partitionBy("kpi", "year").text(path)
    return files.read_keyed_json(x.spark, path).select("key", "kpi_name", "date", "severity", "prompt_version")


@query
def sink_keyed_json(x):
    path = stage_path(x.spark, "keyed_rows")
    files.write_keyed_json(x.rag_narratives, path)
    return files.read_keyed_rows(x.spark, path).select("key", "kpi_name", "severity", F.array_join("retrieved_context", ",").alias("context"))


@query
def query_param_select(x):
    sql = "SELECT kpi_name, date, severity, method FROM {anomalies} WHERE severity = :severity AND confidence >= :floor"
    return tables.query(x.spark, sql, {"severity": "high", "floor": 0.5}, anomalies=x.anomalies)


def _both_detections(x):
    watched = x.series.where(~F.col("kpi_name").isin(*cat.SKIPPED_IN_DETECTION))
    return det.union_detections(det.detect_zscore(watched, baseline=BASELINE), det.detect_iqr(watched, baseline=BASELINE))


@query
def insert_do_nothing(x):
    batch = _both_detections(x).select("kpi_name", "date", "method", "severity")
    target = batch.where(F.col("severity") == "critical")
    return tables.insert_do_nothing(target, batch, ["kpi_name", "date"], ["method"])


def invoice_number():
    return F.regexp_replace("InvoiceNo", "^C", "").cast("bigint")


def _customers(x, parity):
    """Customers of the even or of the odd invoices."""
    return (
        x.tx.where(invoice_number() % 2 == parity)
        .groupBy("CustomerID")
        .agg(F.sum("Quantity").alias("units"), F.count(F.lit(1)).alias("lines"), F.lit(parity).alias("seen"))
    )


@query
def upsert_rows(x):
    return tables.upsert(_customers(x, 0), _customers(x, 1), ["CustomerID"], ["units", "seen"])


@query
def table_row_count(x):
    return tables.row_count(x.raw)


@query
def truncate_reload(x):
    path = stage_path(x.spark, "raw_transactions")
    x.raw.write.parquet(path)
    versions.reload_table(versions.read_table(x.spark, path).withColumn("quantity", F.col("quantity") * 2), path)
    return versions.read_table(x.spark, path).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("units"))


@query
def upsert_touched_partitions(x):
    """KPI values by year; a batch doubles those of one month of each of two years and adds a KPI."""
    path = stage_path(x.spark, "kpis_by_year")
    stored = x.series.where(F.col("value").isNotNull()).select("kpi_name", "date", F.year("date").alias("year"), "value", F.lit(1).alias("load"))
    stored.write.partitionBy("year").parquet(path)
    month = stored.where(F.col("year").isin(1995, 1997) & (F.month("date") == 3))
    changed = month.withColumn("value", F.col("value") * 2).unionByName(month.where("kpi_name = 'order_count'").withColumn("kpi_name", F.lit("new_kpi")))
    tables.merge_touched(path, changed.withColumn("load", F.lit(2)), ["kpi_name", "date", "year"], ["value"], ["year"])
    return x.spark.read.parquet(path).select("kpi_name", "date", "year", "value", "load")


@query
def owner_report(x):
    return rounded(reports.owner_report(kpis.kpi_all(x.tx, home_country=HOME)), 6)


# ---------------------------------------------------- projections and derived columns


@query
def rename_snake(x):
    return src.rename_snake(x.tx).withColumn("unit_price", F.col("unit_price").cast("double"))


@query
def normalise_customer_id(x):
    floats = x.tx.select("InvoiceNo", (F.col("CustomerID").cast("double")).cast("string").alias("customer_id"))
    return src.normalise_customer_id(floats)


@query
def load_stamp(x):
    return tables.load_raw_transactions(x.tx).groupBy(F.col("loaded_at").isNotNull().alias("stamped")).agg(F.count(F.lit(1)).alias("n"))


@query
def stg_transactions(x):
    return x.stg.withColumns({"unit_price": F.col("unit_price").cast("double"), "line_total": F.col("line_total").cast("double")})


@query
def derived_columns(x):
    return x.derived.select(
        "InvoiceNo", "StockCode", F.col("TransactionValue").cast("double").alias("TransactionValue"), "DayOfWeek", "HourOfDay"
    )


@query
def contract_derived_fields(x):
    return src.with_contract_fields(x.tx, HOME).select(
        "InvoiceNo", F.col("TransactionValue").cast("double").alias("TransactionValue"),
        "IsReturn", "DayOfWeek", "HourOfDay", "IsInternational",
    )


@query
def resolve_date_column(x):
    return tables.resolve_column(x.anomalies, ["anomaly_date", "date", "week_date"], "anomaly_date").select("kpi_name", "anomaly_date", "method")


@query
def unpivot_kpis(x):
    return kpis.unpivot_kpis(x.weekly, "date", "week_date")


@query
def derive_direction(x):
    return x.anomalies.select("kpi_name", "date", "method", text.direction(F.col("deviation_pct")).alias("direction"))


@query
def detection_methods_array(x):
    listed = x.anomalies.select("kpi_name", "date", F.replace("method", F.lit("_and_"), F.lit(",")).alias("detection_methods"))
    single = x.anomalies.select("kpi_name", "date", "method")
    return listed.select("kpi_name", "date", F.lit("list").alias("form"), F.array_join(tables.methods_array(listed), "|").alias("methods")).unionByName(
        single.select("kpi_name", "date", F.lit("single").alias("form"), F.array_join(tables.methods_array(single), "|").alias("methods"))
    )


@query
def default_missing_columns(x):
    short = x.anomalies.select("kpi_name", "date", "severity")
    return tables.default_missing(short, {"actual_value": ("double", None), "severity": ("string", "low"), "cadence": ("string", "weekly")})


@query
def rc_flatten_drivers(x):
    return rounded(x.flat)


@query
def rc_explode_drivers(x):
    return att.explode_drivers(x.flat)


@query
def parse_narratives(x):
    return joined(retrieval.parse_narratives(x.rag_narratives, "rag"))


@query
def anomaly_description(x):
    return x.with_trends.select("kpi_name", "date", "method", "description")


@query
def root_cause_summary(x):
    return x.causes.select("kpi_name", "date", "status", "summary")


@query
def anomaly_document(x):
    return x.flat.select("kpi_name", "date", text.anomaly_document().alias("document"))


@query
def prompt_render(x):
    return retrieval.render_prompts(att.explained(x.flat), retrieval.prompt_catalogue(x.spark, PROMPTS))


@query
def prompt_render_rag(x):
    """Retrieval to prompt: neighbours, their context, the filled template."""
    prompts = retrieval.prompt_catalogue(x.spark, RAG_PROMPT)
    return retrieval.retrieved_prompts(att.explained(x.flat), retrieval.build_corpus(x.flat), x.cause_vectors, prompts, 3, 1.0)


@query
def narrative_key(x):
    return x.causes.select(text.narrative_key(F.col("kpi_name"), F.col("date")).alias("key"))


@query
def split_key(x):
    keys = narrative_key(x)
    return keys.select("key", text.key_label(F.col("key")).alias("label"), text.key_date(F.col("key")).alias("day"))


@query
def format_kpi_value(x):
    return x.series.select("kpi_name", "date", text.format_kpi_value(F.col("kpi_name"), F.col("value")).alias("shown"))


@query
def anomaly_display(x):
    return det.anomaly_display(x.anomalies)


# ------------------------------------------------------------------------- filters


def _filtered(x, condition):
    return x.derived.where(condition).groupBy("Country").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Quantity").alias("units")
    )


@query
def filter_in_list(x):
    return _filtered(x, m.is_in("DayOfWeek", "Saturday", "Sunday"))


@query
def filter_not_equal(x):
    return (
        x.tx.where(m.not_equal("CustomerID", "00001"))
        .groupBy(F.col("CustomerID").isNull().alias("guest")).agg(F.count(F.lit(1)).alias("n"))
    )


@query
def filter_compare(x):
    return _filtered(x, m.compare("Quantity", "<", 0) | m.compare("UnitPrice", ">=", 1500))


@query
def filter_baseline_window(x):
    """A baseline with rows, and one without any, for which all rows stand in."""
    counts = []
    for name, period in (("dated", BASELINE), ("empty", ("2090-01-01", "2090-12-31"))):
        rows = att.BaselineProfile(x.tx, period).rows(x.tx)
        counts.append(rows.groupBy("Country").agg(F.count(F.lit(1)).alias("n")).withColumn("baseline", F.lit(name)))
    return det.union_detections(*counts)


@query
def filter_anomaly_week(x):
    day = F.col("week_end")
    tagged = x.tx.withColumn("week_end", dates.week_end(F.col("InvoiceDate")))
    kept = att.in_anomaly_week(F.col("InvoiceDate"), day)
    return tagged.groupBy("week_end").agg(F.count_if(kept).alias("in_period"), F.count(F.lit(1)).alias("in_week"))


@query
def filter_anomalies(x):
    return det.filter_anomalies(x.anomalies, ["high", "critical"], ["total_revenue", "order_count", "peak_hour_concentration"]).select(
        "kpi_name", "date", "severity"
    )


@query
def filter_point_anomalies(x):
    return det.point_anomalies(x.with_trends).select("kpi_name", "date", "method")


@query
def filter_explained(x):
    return att.explained(x.causes).select("kpi_name", "date", "status")


@query
def filter_key_contains(x):
    return retrieval.with_key(x.causes).where(F.col("key").contains("1998-0")).select("key", "status")


@query
def filter_prefix(x):
    return x.tx.where(F.coalesce(F.col("InvoiceNo").startswith("C"), F.lit(False))).groupBy("Country").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- joins


@query
def vw_kpi_with_anomaly_flag(x):
    return rounded(marts.kpi_with_anomaly_flag(x.kpi_table, x.anomaly_table), exact=("value",))


@query
def mart_anomaly_summary(x):
    return rounded(joined(marts.anomaly_summary(x.anomaly_table, x.cause_table), detection_methods="|"))


@query
def lookup_anomaly_id(x):
    rows = x.series.select("kpi_name", F.col("date").alias("anomaly_date"))
    return tables.with_anomaly_id(rows, x.anomaly_table)


@query
def anomaly_drilldown(x):
    return reports.anomaly_drilldown(x.anomalies, x.flat, x.narratives)


@query
def narrative_lookup(x):
    return retrieval.narrative_lookup(x.causes.select("kpi_name", "date", "status"), x.narratives)


@query
def narrative_compare(x):
    return retrieval.narrative_compare(x.narratives, x.rag_narratives)


@query
def pending_narratives(x):
    return retrieval.pending_narratives(x.flat, x.narratives).select("key", "kpi_name", "date", "anomaly_severity")


@query
def prompt_version_stats(x):
    return rounded(monitoring.prompt_version_stats(retrieval.prompt_catalogue(x.spark, PROMPTS + [("v9", "never used", "{kpi}")]), x.calls))


@query
def anomaly_tx_range_join(x):
    return att.anomaly_week_totals(x.tx, x.anomalies)


@query
def kpi_has_anomaly(x):
    return reports.flagged_kpis(x.series.select("kpi_name").distinct(), x.anomalies)


@query
def anomaly_markers(x):
    return reports.anomaly_markers(x.with_trends, x.series).select("kpi_name", "date", "severity")


@query
def pairwise_self_join(x):
    """Pair outcomes of every series: the reference walks all pairs, here none are emitted."""
    return trend_statistics(x.series).select(
        "kpi_name", (F.col("n").cast("bigint") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), "concordant", "discordant", "tied"
    )


# -------------------------------------------------------------------- aggregations


def _metric(x, **specs):
    weekly = x.derived.withColumn("date", dates.week_end(F.col("InvoiceDate")))
    return m.evaluate(weekly, specs, ["date"])


@query
def agg_sum(x):
    return _metric(x, value=m.Sum("Quantity"))


@query
def agg_sum_product(x):
    return _metric(x, value=m.Sum("Quantity", "UnitPrice"))


@query
def agg_count(x):
    return _metric(x, value=m.Count("CustomerID"))


@query
def agg_count_distinct(x):
    return _metric(x, value=m.CountDistinct("CustomerID"))


@query
def agg_avg(x):
    return _metric(x, value=m.Avg("UnitPrice"))


@query
def agg_avg_product(x):
    return _metric(x, value=m.Avg("Quantity", "UnitPrice"))


@query
def agg_min(x):
    return _metric(x, value=m.Min("UnitPrice"))


@query
def agg_max(x):
    return _metric(x, value=m.Max("Quantity"))


@query
def agg_cond_sum(x):
    return _metric(x, value=m.Sum("TransactionValue", where=m.not_equal("Country", HOME)))


@query
def agg_cond_count_distinct(x):
    return _metric(x, value=m.Count("InvoiceNo", where=m.compare("Quantity", "<", 0)))


@query
def agg_cond_avg(x):
    return _metric(x, value=m.Avg("TransactionValue", where=m.is_in("DayOfWeek", "Saturday", "Sunday")))


@query
def agg_entities_over_threshold(x):
    return _metric(x, value=m.EntitiesOver("CustomerID", "InvoiceNo", 2))


@query
def agg_first_seen_in_period(x):
    spec = m.FirstSeen("CustomerID", "InvoiceDate", "1995-03-01", "1995-12-31")
    return m.evaluate(x.tx, {"value": spec})


@query
def agg_topn_sum_products(x):
    return _metric(x, value=m.TopNSum("StockCode", 20))


@query
def agg_topn_sum_hours(x):
    return _metric(x, value=m.TopNSum("HourOfDay", 3))


@query
def metric_ratio(x):
    return _metric(
        x,
        revenue=m.Sum("Quantity", "UnitPrice"),
        per_customer=m.Ratio(m.KpiRef("revenue"), m.CountDistinct("CustomerID")),
        half_units=m.Ratio("Quantity", m.Literal(2.0)),
        by_nothing=m.Ratio("Quantity", m.Literal(0.0)),
        order_size=m.Ratio("Quantity", m.CountDistinct("InvoiceNo")),
    )


@query
def kpi_single(x):
    return m.evaluate(x.derived, cat.metric_specs(HOME), only=["revenue_per_customer"])


@query
def kpi_all(x):
    return kpis.kpi_all(x.tx, home_country=HOME)


@query
def kpi_all_weekly_cadence(x):
    return kpis.kpi_all(x.tx, "weekly", HOME)


@query
def kpi_windowed_weekly(x):
    return kpis.kpi_windowed(x.tx, "W", HOME)


@query
def kpi_windowed_daily(x):
    return kpis.kpi_windowed(x.tx, "D", HOME)


def _kpi_query(name):
    def run(spark, folder):
        x = Inputs(spark, folder)
        weekly = x.derived.withColumn("date", dates.week_end(F.col("InvoiceDate")))
        return m.evaluate(weekly, cat.metric_specs(HOME), ["date"], only=[name])

    return run


for _name in cat.KPI_NAMES:
    QUERIES[f"kpi_{_name}"] = _kpi_query(_name)


@query
def revenue_by_country_breakdown(x):
    return kpis.revenue_by_country(x.tx)


@query
def new_customers_by_history(x):
    return kpis.first_seen_customers(x.tx)


@query
def int_weekly_transactions(x):
    return marts.int_weekly_transactions(x.stg)


@query
def mart_weekly_kpis(x):
    return marts.mart_weekly_kpis(x.stg)


@query
def mart_weekly_kpis_exact(x):
    return marts.mart_weekly_kpis(x.stg, exact=True)


@query
def vw_llm_monitoring_summary(x):
    return rounded(monitoring.monitoring_summary(monitoring.load_calls(x.calls)), 6)


@query
def vw_anomaly_clusters(x):
    return joined(marts.anomaly_clusters(x.anomaly_table), kpis_affected=",")


@query
def vw_anomaly_clusters_ordinal(x):
    return joined(marts.anomaly_clusters(x.anomaly_table, ordinal=True), kpis_affected=",")


@query
def call_log_summary(x):
    return monitoring.call_log_summary(x.calls)


@query
def call_log_by_version(x):
    return monitoring.version_stats(x.calls)


@query
def flag_frequency(x):
    return monitoring.flag_frequency(x.calls)


@query
def version_violations(x):
    return rounded(monitoring.version_violations(x.calls))


@query
def latency_series(x):
    return monitoring.latency_series(x.calls)


@query
def anomaly_counts(x):
    return det.anomaly_counts(x.anomalies)


@query
def rootcause_status_counts(x):
    return att.status_counts(x.causes)


@query
def series_stats(x):
    return rounded(reports.series_stats(x.series, x.with_trends))


@query
def kpi_overview(x):
    return rounded(reports.kpi_overview(kpis.kpi_all(x.tx, home_country=HOME), x.series, x.anomalies), 6)


@query
def driver_share_by_kpi(x):
    return rounded(marts.driver_share_by_kpi(marts.anomaly_summary(x.anomaly_table, x.cause_table)))


# ------------------------------------------------------------------------- windows


def _buckets(x, bucket):
    return x.tx.groupBy(bucket(F.col("InvoiceDate")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def bucket_week_end(x):
    return _buckets(x, dates.week_end)


@query
def bucket_day(x):
    return _buckets(x, dates.day)


@query
def bucket_week_start(x):
    return _buckets(x, dates.week_start)


@query
def trend_arrow(x):
    return reports.trend_arrows(x.series)


@query
def normalise_to_mean(x):
    return rounded(reports.normalise_to_mean(x.series).select("kpi_name", "date", "pct_of_mean"))


@query
def dedupe_keep_best(x):
    best = tables.keep_best(_both_detections(x), ["kpi_name", "date"], "confidence", [F.desc("method")])
    return best.select("kpi_name", "date", "method", "confidence")


@query
def dedupe_keep_last(x):
    """The last event of every user and type."""
    events = x.table("events").select("user_id", "event_type", "ts", "event_id")
    return tables.keep_last(events, ["user_id", "event_type"], "ts", [F.desc("event_id")])


@query
def rank_drivers(x):
    return rounded(att.rank_drivers(_shares(x))).select("kpi_name", "date", "dimension", "segment", "contribution_pct", "rank")


@query
def series_position(x):
    return reports.series_position(x.series).select("kpi_name", "date", "position")


# ------------------------------------------------------------------ sorts and top-k


@query
def order_weekly(x):
    return marts.mart_weekly_kpis(x.stg).select("week_start", "total_revenue").orderBy("week_start")


@query
def order_anomalies(x):
    return det.order_anomalies(x.anomalies).select("date", "kpi_name", "method")


@query
def top_confidence(x):
    return det.top_confidence(x.anomalies).select("kpi_name", "date", "confidence", "severity")


@query
def top_products(x):
    return att.top_products(x.tx, BASELINE).withColumn("revenue", F.col("revenue").cast("double"))


@query
def top_segments_preview(x):
    return driver_text(att.top_segments_preview(x.causes)).select("kpi_name", "date", "drivers")


# ------------------------------------------------------------------ set operations


@query
def union_detections(x):
    return det.union_detections(_both_detections(x), det.detect_trend(x.drifted)).select("kpi_name", "date", "method", "severity")


@query
def union_histories(x):
    return append_kpi_history(x).select("date", "total_revenue", "order_count", "units_sold")


@query
def union_narrative_types(x):
    both = retrieval.parse_narratives(x.narratives, "standard").unionByName(retrieval.parse_narratives(x.rag_narratives, "rag"))
    return both.select("kpi_name", "anomaly_date", "narrative_type", "prompt_version")


@query
def intersect_keys(x):
    return x.narratives.select("key").intersect(x.rag_narratives.select("key"))


@query
def distinct_values(x):
    return x.tx.select("Country", F.hour("InvoiceDate").alias("hour")).distinct()


# -------------------------------------------------------------------- data quality


@query
def dq_schema(x):
    broken = x.tx.withColumn("Quantity", F.col("Quantity").cast("string")).drop("Country").withColumn("Extra", F.lit(1))
    errors = [(e,) for e in quality.schema_errors(broken)] + [(f"Extra: {c}",) for c in quality.extra_columns(broken)]
    found = literal_frame(x.spark, errors, ["finding"])
    return found.withColumn("n_rows", broken.agg(F.count(F.lit(1))).scalar())


@query
def dq_completeness(x):
    return rounded(quality.completeness(x.tx), 6)


@query
def dq_value_ranges(x):
    return rounded(quality.value_ranges(x.tx, {"Quantity": (-40, 40), "UnitPrice": (0.0, 10000.0)}), 6)


@query
def dq_cancellation_sign(x):
    flipped = F.when(invoice_number() % 7 == 0, -F.col("Quantity")).otherwise(F.col("Quantity"))
    return quality.consistency(x.tx.withColumn("Quantity", flipped), rules=["cancellation_quantity_match"])


@query
def dq_positive_price(x):
    flipped = F.when(F.col("StockCode").cast("bigint") % 11 == 0, -F.col("UnitPrice")).otherwise(F.col("UnitPrice"))
    return quality.consistency(x.tx.withColumn("UnitPrice", flipped), rules=["positive_price"])


@query
def dq_transaction_value(x):
    return quality.consistency(x.tx, 40000, ["valid_transaction_value"])


@query
def dq_checks(x):
    return quality.quality_checks(x.tx)


@query
def dq_report(x):
    """Three limits on the transaction value and the score: one report fails, one warns, one passes."""
    cases = {"fail": {"value_limit": 40000}, "warn": {"minimum": 0.8}, "pass": {"minimum": 0.5, "warning": 0.8}}
    reports_ = [quality.quality_report(x.tx, **options).withColumn("case", F.lit(n)) for n, options in cases.items()]
    return rounded(det.union_detections(*reports_), 6)


@query
def dq_test_not_null(x):
    return quality.failing_not_null(x.raw, ["invoice_no", "quantity", "unit_price", "customer_id"])


@query
def dq_test_unique(x):
    return quality.failing_unique(x.raw, "invoice_no")


@query
def dq_pattern(x):
    return quality.pattern_violations(x.tx, {"InvoiceNo": "^[0-9]{6}$", "CustomerID": "^0[0-9]{4}$"})


@query
def dq_max_length(x):
    return quality.length_violations(x.tx, {"StockCode": 20, "Description": 10})


@query
def dq_date_bounds(x):
    return quality.date_bound_violations(x.tx, ("1995-06-01", "1998-06-30"))


@query
def dq_future_date(x):
    return quality.future_dates(x.tx, F.lit("1998-06-30").cast("date"))


@query
def dq_zero_price_share(x):
    return quality.zero_price_share(x.tx)


@query
def dq_iqr_outliers(x):
    """As the contract declares it: quantities, the usual multiplier."""
    return rounded(quality.iqr_outliers(x.tx, "Quantity"))


@query
def dq_iqr_outliers_price(x):
    return rounded(quality.iqr_outliers(x.tx, "UnitPrice", 0.25))


@query
def dq_monotonic_dates(x):
    order = F.regexp_replace("InvoiceNo", "^C", "").cast("bigint")
    return quality.monotonic_violations(x.tx.withColumn("load_order", order), "load_order", span=1000)


def _with_copies(x):
    """All rows in all columns, those of every tenth invoice twice."""
    return x.tx.unionByName(x.tx.where(invoice_number() % 10 == 0))


@query
def dq_duplicate_rate(x):
    return rounded(quality.duplicate_rate(_with_copies(x)), 6)


@query
def dq_temporal_gaps(x):
    return quality.temporal_gaps(x.tx, 0)


@query
def dq_daily_row_count(x):
    """The rows of Thursdays count a day later, so that there are days without rows."""
    moved = F.when(F.dayofweek("InvoiceDate") == 5, F.col("InvoiceDate") + F.make_dt_interval(F.lit(1))).otherwise(F.col("InvoiceDate"))
    return quality.daily_row_counts(x.tx.withColumn("InvoiceDate", moved), 30, 45)


@query
def dq_freshness(x):
    return quality.freshness(x.tx, F.lit("1999-06-01 12:00:00").cast("timestamp_ntz"))


@query
def dq_allowed_values(x):
    allowed = x.table("nation").where(F.col("n_regionkey") < 4).select(F.col("n_name").alias("Country"))
    return quality.disallowed_values(x.tx, "Country", allowed)


@query
def dedupe_transactions(x):
    return src.dedupe_transactions(_with_copies(x)).withColumn("UnitPrice", F.col("UnitPrice").cast("double"))


@query
def dq_gate(x):
    try:
        quality.quality_gate(x.tx)
        stopped = False
    except quality.QualityGateError:
        stopped = True
    passed_on = quality.quality_gate(x.tx, on_breach="log")
    return passed_on.agg(F.lit(stopped).alias("stopped"), F.count(F.lit(1)).alias("passed_on"))


@query
def daily_kpis_table(x):
    daily = kpis.unpivot_kpis(kpis.kpi_windowed(x.tx, "D", HOME))
    table = marts.daily_kpi_table(daily, x.tx).drop("calculation_timestamp", "confidence_score")
    return rounded(table, exact=("kpi_value",))


@query
def insights_table(x):
    narratives = x.narratives.withColumn("date", F.to_date("date"))
    table = marts.insights_table(x.with_trends, x.causes, narratives)
    return table.select(
        "insight_id", "detection_date", "kpi_name", "insight_type", "severity", "confidence_score", "explanation",
        F.get_json_object("root_cause", "$.status").alias("root_cause_status"), "narrative", "status",
    )


# ----------------------------------------------------------------------- detection


@query
def detect_zscore(x):
    return rounded(det.detect_zscore(x.series, baseline=BASELINE))


@query
def detect_iqr(x):
    return rounded(det.detect_iqr(x.series, baseline=BASELINE))


@query
def detect_trend(x):
    return rounded(det.detect_trend(x.drifted))


@query
def trend_statistics_all(x):
    return rounded(trend_statistics(x.series)).select(
        "kpi_name", "n", "s", "var_s", "z", "slope", "mean", "last_date", "last_value"
    )


@query
def severity_zscore(x):
    return det.detect_zscore(x.series, 1.0, BASELINE).select("kpi_name", "date", "severity")


@query
def severity_iqr(x):
    return det.detect_iqr(x.series, 0.5, BASELINE).select("kpi_name", "date", "severity")


@query
def severity_trend(x):
    return det.detect_trend(x.drifted, 0.5).select("kpi_name", "severity")


@query
def baseline_fallback(x):
    """A window of two weeks is too short, so the statistics are those of the whole series."""
    return rounded(det.baseline_statistics(x.series, ("1996-01-01", "1996-01-14")))


@query
def detect_all(x):
    return rounded(det.detect_all(x.series, BASELINE))


@query
def merge_detections(x):
    merged = det.merge_detections(det.union_detections(_both_detections(x), det.detect_trend(x.drifted)))
    return rounded(merged).select("kpi_name", "date", "method", "severity", "confidence", "stat_value", "description")


@query
def kpi_timeseries(x):
    return kpis.unpivot_kpis(kpis.kpi_windowed(x.tx, "W", HOME))


# --------------------------------------------------------------------- attribution


@query
def segment_metric(x):
    in_base = x.tx.where(att.in_baseline_period(F.col("InvoiceDate"), BASELINE))
    return rounded(att.segment_metrics(in_base, [])).drop("segment_order")


@query
def segment_candidates(x):
    in_base = x.tx.where(att.in_baseline_period(F.col("InvoiceDate"), BASELINE))
    return att.segment_candidates(in_base, x.profile.top_products())


def _shares(x):
    metrics = att.period_and_baseline(x.tx, det.point_anomalies(x.anomalies), x.profile)
    sliceable = det.point_anomalies(x.anomalies).where(~F.col("kpi_name").isin(*cat.RATIO_KPIS))
    return att.contributions(sliceable, stage(metrics, "metrics"), x.profile.scale)


@query
def segment_contribution(x):
    return rounded(_shares(x)).drop("segment_order")


@query
def root_cause(x):
    """One KPI's anomalies."""
    one = x.anomalies.where(F.col("kpi_name") == "order_count")
    return driver_text(joined(rounded(att.root_cause_all(x.tx, one, BASELINE)), dimensions_analysed=", "))


@query
def root_cause_all(x):
    causes = att.root_cause_all(x.tx, x.anomalies, BASELINE)
    return driver_text(joined(rounded(causes), dimensions_analysed=", "))


@query
def root_cause_full_week(x):
    causes = att.root_cause_all(x.tx, x.anomalies, BASELINE, full_week=True)
    return driver_text(joined(rounded(causes), dimensions_analysed=", "))


@query
def top_findings(x):
    return driver_text(att.top_findings(x.causes)).select("kpi_name", "date", "anomaly_confidence", "drivers")


# ---------------------------------------------------------- retrieval and monitoring


@query
def retriever_build(x):
    return retrieval.build_corpus(x.flat)


@query
def retriever_append(x):
    stored = retrieval.build_corpus(x.flat).where(F.col("severity") == "low")
    return retrieval.missing_documents(stored, x.flat).select("id", "severity")


@query
def retriever_skip(x):
    stored = retrieval.build_corpus(x.flat).where(F.col("severity") == "low")
    return retrieval.refresh_corpus(stored, x.flat).select("id", "severity")


@query
def similar_topk(x):
    return retrieval.similar_topk(x.corpus, x.corpus, 3, 1.0, same_kpi_only=True).select("query_id", "id", "rank", "distance")


@query
def similar_topk_any_kpi(x):
    return retrieval.similar_topk(x.corpus, x.corpus, 2, None, block_rows=200).select("query_id", "id", "rank", "distance")


@query
def query_document(x):
    sev = F.when(F.col("anomaly_severity") != "low", F.col("anomaly_severity"))
    pct = F.when(F.col("anomaly_severity") != "medium", F.abs("total_deviation_pct"))
    return x.flat.select(
        "kpi_name", "date", text.query_document(F.col("kpi_name"), sev, pct, text.side(F.col("total_deviation"))).alias("query_text")
    )


@query
def context_block(x):
    """The context of every cause from its nearest stored anomalies of the same KPI."""
    corpus = retrieval.build_corpus(x.flat)
    near = retrieval.similar_topk(x.cause_vectors, x.cause_vectors, 3, 1.0, same_kpi_only=True)
    return retrieval.context_block(corpus, retrieval.with_metadata(near, corpus))


@query
def call_cost(x):
    return x.calls.select("timestamp", "input_tokens", "output_tokens", "estimated_cost_usd")


@query
def quality_flags(x):
    evaluated = monitoring.evaluate_texts(x.table("conversations"))
    return joined(evaluated, quality_flags=",").drop("text")


@query
def load_llm_calls(x):
    return joined(monitoring.load_calls(x.calls).drop("loaded_at"), quality_flags=",")


def _stored_narratives(x):
    return retrieval.parse_narratives(x.rag_narratives, "rag").where(F.col("anomaly_date") < F.lit("1998-01-01").cast("date"))


@query
def narratives_upsert(x):
    fresh = retrieval.parse_narratives(x.rag_narratives, "rag").withColumns(
        {"narrative_text": F.concat("narrative_text", F.lit(" (revised)")), "prompt_version": F.lit("v3"), "retrieved_context": F.lit("[]")}
    )
    return tables.upsert_narratives(_stored_narratives(x), fresh)


@query
def table_kpi_results(x):
    return x.kpi_table.drop("computed_at", "category", "cadence")


@query
def table_anomalies(x):
    return rounded(joined(x.anomaly_table, detection_methods="|").drop("detected_at"))


@query
def table_root_causes(x):
    return x.cause_table.drop("analysed_at")


@query
def table_raw_transactions(x):
    return tables.load_raw_transactions(x.tx).drop("loaded_at").withColumn("unit_price", F.col("unit_price").cast("double"))
