"""The batch brought up to date week by week against the whole batch."""

import datetime as dt
import glob
import random

import pytest

from tillscope.plans import incremental, precompute
from tillscope.sources import files
from tillscope.sources import transactions as src

PERIOD = ("2021-01-01", "2021-06-27")


def _rows(first, days, seed, big=()):
    """Some lines a day; customers, products and a few invoices come back in several weeks."""
    draw = random.Random(seed)
    made = []
    for i in range(days):
        day = dt.date.fromisoformat(first) + dt.timedelta(days=i)
        for k in range(3):
            invoice = f"{seed}{i // 9}{k}" if k == 0 else f"{seed}x{i}x{k}"
            quantity = 400 if day.isoformat() in big else draw.randrange(1, 9)
            made.append((invoice, f"{day} {10 + k}:00", f"p{draw.randrange(6)}", quantity, 2, draw.choice(["a", "b", "c", None]), draw.choice(["UK", "FR"])))
    return made


def _tables(spark, path):
    return {n: sorted(map(repr, files.read_cache(spark, path, n).collect())) for n in files.CACHE_TABLES}


def _near(a, b):
    """Rows as text, with numbers to 9 digits: sums of doubles may be added in another order."""
    import re

    cut = lambda t: re.sub(r"-?\d+\.\d+(e-?\d+)?", lambda m: f"{float(m[0]):.9g}", t)
    return {n: sorted(map(cut, rows)) for n, rows in a.items()} == {n: sorted(map(cut, rows)) for n, rows in b.items()}


def _whole(spark, table, path, baseline=PERIOD):
    precompute.precompute_all(src.read_transactions(spark, table), path, "UK", baseline)
    return _tables(spark, path)


@pytest.fixture()
def store(spark, make_tx, tmp_path):
    table, cache = str(tmp_path / "tx"), str(tmp_path / "cache")
    src.write_transactions(make_tx(_rows("2021-01-04", 203, 1, big=("2021-07-06", "2021-03-02"))), table)
    return table, cache, lambda: src.read_transactions(spark, table)


def test_refreshes_equal_the_whole_batch(spark, make_tx, store, tmp_path):
    table, cache, tx = store
    first = incremental.refresh(tx(), cache, "UK", PERIOD)
    assert len(first.made) == 29 and first.gone == [] and first.explained > 0
    assert _tables(spark, cache)["root_causes"]
    assert incremental.refresh(tx(), cache, "UK", PERIOD) == incremental.Refresh([], [], 0)

    # a new week with an anomaly of its own, and rows without a date
    more = _rows("2021-07-26", 4, 2, big=("2021-07-27",))
    undated = make_tx(more[:2]).selectExpr("InvoiceNo", "cast(null as timestamp_ntz) as InvoiceDate", "StockCode", "Description", "Quantity", "UnitPrice", "CustomerID", "Country")
    src.write_transactions(make_tx(more).unionByName(undated), table, "append")
    second = incremental.refresh(tx(), cache, "UK", PERIOD)
    assert second.made == ["2021-08-01", incremental.UNDATED] and 0 < second.explained < first.explained + second.explained
    assert _near(_tables(spark, cache), _whole(spark, table, str(tmp_path / "w2")))

    # lines come late to a week of the baseline: everything is explained anew
    src.write_transactions(make_tx(_rows("2021-05-03", 2, 3)), table, "append")
    third = incremental.refresh(tx(), cache, "UK", PERIOD)
    assert third.made == ["2021-05-09"]
    assert _near(_tables(spark, cache), _whole(spark, table, str(tmp_path / "w3")))

    # another baseline reads no facts anew
    moved = ("2021-01-01", "2021-05-30")
    assert incremental.refresh(tx(), cache, "UK", moved).made == []
    assert _near(_tables(spark, cache), _whole(spark, table, str(tmp_path / "w4"), moved))


def test_a_week_that_is_gone(spark, make_tx, store, tmp_path):
    table, cache, tx = store
    incremental.refresh(tx(), cache, "UK", PERIOD)
    rest = tx().where("week_end <> date'2021-07-18'").drop("week_end")
    other = str(tmp_path / "rest")
    rest.write.parquet(str(tmp_path / "copy"))
    src.write_transactions(spark.read.parquet(str(tmp_path / "copy")), other)
    done = incremental.refresh(src.read_transactions(spark, other), cache, "UK", PERIOD)
    assert done.gone == ["2021-07-18"]
    assert _near(_tables(spark, cache), _whole(spark, other, str(tmp_path / "w")))


def test_one_changed_week_reads_one_folder(spark, make_tx, store):
    """All other weeks' files are overwritten with rubbish, so reading one of them would fail."""
    table, cache, tx = store
    schema = tx().schema
    incremental.refresh(tx(), cache, "UK", PERIOD)
    before = {r["date"].isoformat(): r for r in files.read_cache(spark, cache, "kpi_timeseries").collect()}
    held = tx().where("week_end = date'2021-07-18'").first()
    line = (held["InvoiceNo"], str(held["InvoiceDate"]), held["StockCode"], 1, 2, held["CustomerID"], held["Country"])
    src.write_transactions(make_tx([line]), table, "append")
    for file in glob.glob(f"{table}/week_end=*/*.parquet"):
        if "2021-07-18" not in file:
            with open(file, "wb") as f:
                f.write(b"rubbish")
    done = incremental.refresh(spark.read.schema(schema).parquet(table), cache, "UK", PERIOD)
    assert done == incremental.Refresh(["2021-07-18"], [], 0)
    after = {r["date"].isoformat(): r for r in files.read_cache(spark, cache, "kpi_timeseries").collect()}
    week = "2021-07-18"
    assert after[week]["total_revenue"] == before[week]["total_revenue"] + 2 and after[week]["order_count"] == before[week]["order_count"]
    assert {w: r for w, r in after.items() if w != week} == {w: r for w, r in before.items() if w != week}


def test_a_failed_refresh_leaves_the_cache(spark, make_tx, store, monkeypatch):
    table, cache, tx = store
    incremental.refresh(tx(), cache, "UK", PERIOD)
    before = _tables(spark, cache)
    src.write_transactions(make_tx(_rows("2021-07-26", 4, 2)), table, "append")

    def fails(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(incremental, "detect_all", fails)
        with pytest.raises(RuntimeError, match="lost"):
            incremental.refresh(tx(), cache, "UK", PERIOD)
    assert _tables(spark, cache) == before
    # the facts of the failed load are named by nothing, so the next refresh makes them anew, and cleaning removes them
    assert incremental.refresh(tx(), cache, "UK", PERIOD).made == ["2021-08-01"]
    after = _tables(spark, cache)
    removed = incremental.drop_stale(spark, cache, keep=1)
    assert len(removed) == 2 and sum(r.startswith("facts/") for r in removed) == 1
    assert _tables(spark, cache) == after and incremental.drop_stale(spark, cache, keep=1) == []


def test_only_tables_stored_by_week(spark, make_tx, tmp_path):
    make_tx(_rows("2021-01-04", 3, 1)).write.parquet(str(tmp_path / "flat"))
    with pytest.raises(ValueError, match="by week|folder of a week"):
        incremental.refresh(spark.read.parquet(str(tmp_path / "flat")), str(tmp_path / "cache"))
