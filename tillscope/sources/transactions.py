"""Reading, mapping and writing the transaction table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions import dates
from tillscope.schemas import SNAKE_NAMES, TRANSACTIONS
from tillscope.session import stage
from tillscope.sources.splitting import csv_records


_CSV = {"header": "true", "encoding": "ISO-8859-1", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}

#: Date formats tried one after the other.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def _looks_like(text: Column, date_format: str) -> Column:
    """False only where ``text`` cannot be of a format of numbers and signs; a failed parse costs far more than this."""
    if not re.fullmatch(r"(?:y{1,4}|M{1,2}|d{1,2}|[Hh]{1,2}|m{1,2}|s{1,2}|[-/:. ])+", date_format):
        return F.lit(True)
    return text.rlike("^" + re.sub(r"[A-Za-z]+", r"[+-]?[0-9]+", re.escape(date_format)) + "$")


def _once(row: Column) -> Column:
    """The fields of a struct as columns that are computed once a row, also if a filter and several columns use them."""
    return F.inline(F.array(row))


def _csv_fields(spark: SparkSession, path: str, date_formats: tuple[str, ...], multiline: bool) -> DataFrame:
    """Every CSV row with its typed fields and ``reject``, why it is not a transaction (null: it is one)."""
    names = TRANSACTIONS.names
    schema = ", ".join(f"`{n}` string" for n in [*names, "_corrupt"])
    if multiline:
        options = {**_CSV, "columnNameOfCorruptRecord": "_corrupt"}
        raw = csv_records(spark, path, _CSV["encoding"]).select(_once(F.from_csv("value", schema, options)))
    else:
        raw = spark.read.schema(schema).options(**_CSV, columnNameOfCorruptRecord="_corrupt").csv(path)
    typed, reasons = {}, [F.when(F.col("_corrupt").isNotNull(), "malformed row")]
    for field in TRANSACTIONS:
        text = F.col(field.name)
        if field.dataType.simpleString() == "timestamp_ntz":
            tried = [F.when(_looks_like(text, f), F.try_to_timestamp(text, F.lit(f))).cast("timestamp_ntz") for f in date_formats]
            typed[field.name] = F.coalesce(*tried)
        else:
            typed[field.name] = text.try_cast(field.dataType)
        if not field.nullable:
            reasons.append(F.when(F.col(field.name).isNull(), f"no valid {field.name}"))
    parsed = raw.select(F.struct(*names).alias("_raw"), "_corrupt", _once(F.struct(*[c.alias(n) for n, c in typed.items()])))
    return parsed.select(*names, F.coalesce(*reasons).alias("reject"), F.to_json("_raw").alias("fields"))


def read_transactions_csv(
    spark: SparkSession,
    path: str,
    date_formats: tuple[str, ...] = DATE_FORMATS,
    multiline: bool = False,
    on_reject: str = "fail",
) -> DataFrame:
    """Latin-1 CSV with a header; ids stay strings, nothing is inferred.

    A row whose required fields are missing or do not parse is a reject: it stops the job
    (``on_reject="fail"``) or is left out (``"skip"``), and ``read_csv_rejects`` lists it.
    ``multiline`` admits line breaks within quotes; a file is still read in many tasks.
    """
    if on_reject not in ("fail", "skip"):
        raise ValueError("on_reject is 'fail' or 'skip'")
    rows = _csv_fields(spark, path, date_formats, multiline)
    if on_reject == "skip":
        return rows.where("reject is null").select(*TRANSACTIONS.names)
    # The check hangs on a required column, so no projection that counts or sums rows can lose it.
    stop = F.raise_error(F.concat(F.lit("rejected CSV row, "), F.col("reject"), F.lit(": "), F.col("fields")))
    return rows.where(F.when(F.col("reject").isNull(), True).otherwise(stop.cast("boolean"))).select(*TRANSACTIONS.names)


def read_csv_rejects(
    spark: SparkSession, path: str, date_formats: tuple[str, ...] = DATE_FORMATS, multiline: bool = False
) -> DataFrame:
    """The rows that ``read_transactions_csv`` does not take: the reason and the fields as read."""
    return _csv_fields(spark, path, date_formats, multiline).where("reject is not null").select("reject", "fields")


def write_transactions_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def write_transactions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by week: a baseline or a filter on ``week_end`` then reads only its folders.

    Rebalancing by week merges small weeks and splits a heavy one by its real size. ``mode`` is
    "overwrite" or "append".
    """
    (
        df.withColumn("week_end", dates.week_end(F.col("InvoiceDate")))
        .hint("rebalance", F.col("week_end"))
        .write.mode(mode)
        .partitionBy("week_end")
        .parquet(path)
    )


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_order_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The order schema (lineitem, orders, customer, nation, part) seen as transactions.

    Plain inner joins: Catalyst broadcasts the sides it knows to be small and adaptive
    execution splits a hot key on the others.
    """
    t = {
        name: spark.read.parquet(f"{folder}/{name}.parquet")
        for name in ("lineitem", "orders", "customer", "nation", "part")
    }
    returned = F.col("l_returnflag") == "R"
    hours = F.make_dt_interval(hours=((F.col("o_orderkey") * 7) % 24).cast("int"))
    # Orders are placed and parts named before the wide rows are made, so lineitem is shuffled with few columns.
    placed = (
        t["orders"]
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderdate", "o_custkey", "n_name")
    )
    return (
        t["lineitem"]
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat(
                F.when(returned, "C").otherwise(""), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
            ).alias("InvoiceNo"),
            (F.col("o_orderdate") + hours).alias("InvoiceDate"),
            F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("StockCode"),
            F.col("p_name").alias("Description"),
            F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int").alias("Quantity"),
            F.col("p_retailprice").cast("decimal(10,4)").alias("UnitPrice"),
            F.when(F.col("o_orderkey") % 4 != 0, F.lpad(F.col("o_custkey").cast("string"), 5, "0")).alias("CustomerID"),
            F.col("n_name").alias("Country"),
        )
    )


# --------------------------------------------------------------- derived columns


def with_derived(df: DataFrame) -> DataFrame:
    """TransactionValue, DayOfWeek, HourOfDay; a column already present is left alone."""
    derived = {
        "TransactionValue": F.col("Quantity") * F.col("UnitPrice"),
        "DayOfWeek": dates.day_name(F.col("InvoiceDate")),
        "HourOfDay": F.hour("InvoiceDate"),
    }
    return df.withColumns({n: c for n, c in derived.items() if n not in df.columns})


def with_contract_fields(df: DataFrame, home_country: str) -> DataFrame:
    """The five derived fields the contract declares."""
    return with_derived(df).withColumns(
        {
            "IsReturn": F.col("InvoiceNo").startswith("C") | (F.col("Quantity") < 0),
            "IsInternational": F.col("Country") != home_country,
        }
    )


def rename_snake(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SNAKE_NAMES)


def normalise_customer_id(df: DataFrame, column: str = "customer_id") -> DataFrame:
    """``'12345.0'`` becomes ``'12345'``; null stays null and an id that is no number stays as it is."""
    whole = F.col(column).try_cast("decimal(38,10)").try_cast("bigint").cast("string")
    return df.withColumn(column, F.coalesce(whole, F.col(column)))


def raw_table(df: DataFrame) -> DataFrame:
    """Rows for the raw transaction table, in its column order, with a load stamp."""
    columns = [
        "invoice_no", "stock_code", "description", "quantity",
        "invoice_date", "unit_price", "customer_id", "country",
    ]
    return (
        normalise_customer_id(rename_snake(df))
        .select(*columns)
        .withColumn("loaded_at", F.current_timestamp())
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """Row and column counts, date range, distinct ids and nulls, in one aggregate."""
    distinct = {
        "unique_invoices": "InvoiceNo",
        "unique_customers": "CustomerID",
        "unique_products": "StockCode",
        "unique_countries": "Country",
    }
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.min("InvoiceDate").alias("start_date"),
        F.max("InvoiceDate").alias("end_date"),
        *[F.count_distinct(c).alias(n) for n, c in distinct.items()],
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in TRANSACTIONS.names],
    )


def fingerprint(df: DataFrame) -> list:
    """Two hashes of all columns; which of them are null is hashed too, for a hash passes over nulls."""
    missing = F.array(*[F.col(c).isNull() for c in df.columns])
    return [F.xxhash64(F.lit(seed), missing, *df.columns) for seed in (1, 2)]


def repeated_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The number ``n`` of rows of every fingerprint, and the rows whose fingerprint is not theirs alone.

    Only 16 bytes a row are shuffled to find them; rows that repeat nothing are not.
    """
    keyed = df.select(*[h.alias(f"_h{i}") for i, h in enumerate(fingerprint(df))])
    counts = stage(keyed.groupBy("_h0", "_h1").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    return counts, _with_fingerprint(df, counts.where("n > 1"), "left_semi")


def _with_fingerprint(df: DataFrame, counts: DataFrame, how: str) -> DataFrame:
    named = counts.select("_h0", "_h1")
    own = fingerprint(df)
    return df.join(named, (own[0] == named["_h0"]) & (own[1] == named["_h1"]), how)


def dedupe_transactions(df: DataFrame) -> DataFrame:
    """The distinct rows. Rows are only compared, and shuffled, where their fingerprint repeats."""
    counts, repeated = repeated_rows(df)
    return _with_fingerprint(df, counts.where("n > 1"), "left_anti").unionByName(repeated.dropDuplicates())
