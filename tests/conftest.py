import datetime as dt
import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillscope.schemas import TRANSACTIONS  # noqa: E402
from tillscope.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture(scope="session")
def make_tx(spark):
    """Transactions from ``(invoice, 'yyyy-mm-dd hh:mm', stock, quantity, price, customer, country)``."""

    def make(rows):
        full = [
            (inv, dt.datetime.fromisoformat(ts), stock, f"item {stock}", qty, Decimal(str(price)), customer, country)
            for inv, ts, stock, qty, price, customer, country in rows
        ]
        return spark.createDataFrame(full, TRANSACTIONS)

    return make


@pytest.fixture(scope="session")
def make_series(spark):
    """A long series from ``{kpi: [values]}``, weekly from Sunday 2020-01-05."""

    def make(values):
        rows = [
            (kpi, dt.date(2020, 1, 5) + dt.timedelta(weeks=i), float(v))
            for kpi, points in values.items()
            for i, v in enumerate(points)
        ]
        return spark.createDataFrame(rows, "kpi_name string, date date, value double")

    return make
