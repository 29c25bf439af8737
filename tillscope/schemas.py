"""Explicit schemas. Identifiers are strings everywhere and are never inferred."""

from pyspark.sql import types as T


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


STR, DBL, INT, BIG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
TS, DATE, BOOL = T.TimestampNTZType(), T.DateType(), T.BooleanType()
PRICE = T.DecimalType(10, 4)

TRANSACTIONS = _s(
    ("InvoiceNo", STR, False),
    ("InvoiceDate", TS, False),
    ("StockCode", STR, False),
    ("Description", STR, True),
    ("Quantity", INT, False),
    ("UnitPrice", PRICE, False),
    ("CustomerID", STR, True),
    ("Country", STR, False),
)

# Contract column -> table column.
SNAKE_NAMES = {
    "InvoiceNo": "invoice_no",
    "InvoiceDate": "invoice_date",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "UnitPrice": "unit_price",
    "CustomerID": "customer_id",
    "Country": "country",
}

ANOMALIES = _s(
    ("kpi_name", STR, False),
    ("date", DATE, False),
    ("actual_value", DBL, True),
    ("expected_value", DBL, True),
    ("deviation", DBL, True),
    ("deviation_pct", DBL, True),
    ("method", STR, False),
    ("severity", STR, False),
    ("confidence", DBL, False),
    ("stat_value", DBL, True),
    ("description", STR, True),
)

ROOT_CAUSES_FLAT = _s(
    ("kpi_name", STR, False),
    ("date", DATE, False),
    ("anomaly_severity", STR, True),
    ("anomaly_confidence", DBL, True),
    ("total_deviation", DBL, True),
    ("total_deviation_pct", DBL, True),
    ("status", STR, False),
    ("summary", STR, True),
    ("dimensions_analysed", STR, True),
    *[
        (f"driver_{i}_{field}", kind, True)
        for i in (1, 2, 3)
        for field, kind in (
            ("dimension", STR),
            ("segment", STR),
            ("contribution_pct", DBL),
            ("deviation", DBL),
        )
    ],
)

CALL_LOG = _s(
    ("timestamp", STR, True),
    ("model", STR, True),
    ("prompt_version", STR, True),
    ("kpi_name", STR, True),
    ("anomaly_date", STR, True),
    ("input_tokens", INT, True),
    ("output_tokens", INT, True),
    ("total_tokens", INT, True),
    ("estimated_cost_usd", DBL, True),
    ("latency_ms", INT, True),
    ("output_length_chars", INT, True),
    ("output_sentence_count", INT, True),
    ("quality_flags", T.ArrayType(STR), True),
    ("status", STR, True),
    ("error_message", STR, True),
)

# One entry of a keyed narrative file; both name variants of date and text are accepted.
NARRATIVE_ENTRY = _s(
    ("kpi_name", STR, True),
    ("date", STR, True),
    ("anomaly_date", STR, True),
    ("severity", STR, True),
    ("narrative", STR, True),
    ("narrative_text", STR, True),
    ("retrieved_context", T.ArrayType(STR), True),
    ("prompt_version", STR, True),
    ("generated_at", STR, True),
)
