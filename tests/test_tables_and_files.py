import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.operators import monitoring, quality, quantiles, retrieval
from tillscope.plans import marts, precompute, reports
from tillscope.schemas import CALL_LOG, NARRATIVE_ENTRY, ROOT_CAUSES_FLAT
from tillscope.sources import files, splitting, tables, versions
from tillscope.sources import transactions as src

DAY = dt.date(2021, 3, 28)


# ----------------------------------------------------------------- table maintenance


def test_insert_do_nothing(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    batch = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (None, "x"), (None, "y")], "k int, v string")
    added = tables.insert_do_nothing(target, batch, ["k"], ["v"]).collect()
    assert sorted((r["k"] or 0, r["v"]) for r in added) == [(0, "x"), (0, "y"), (2, "a")]


def test_upsert_leaves_unlisted_columns(spark):
    target = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep"), (None, "n", "keep")], "k int, v string, w string")
    batch = spark.createDataFrame([(2, None, "lost"), (3, "c", "given"), (None, "m", "given")], "k int, v string, w string")
    out = {(r["k"], r["v"], r["w"]) for r in tables.upsert(target, batch, ["k"], ["v"]).collect()}
    assert out == {(1, "a", "keep"), (2, None, "keep"), (3, "c", "given"), (None, "n", "keep"), (None, "m", "given")}


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.9, 2), ("a", 0.7, 3)], "k string, confidence double, seq int")
    assert tables.keep_best(df, ["k"]).first()["seq"] == 2
    assert tables.keep_last(df, ["k"], "seq").first()["confidence"] == 0.7


def test_reload_of_a_table_read_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    assert versions.read_table(spark, path).count() == 10
    versions.reload_table(versions.read_table(spark, path).where("id > 6"), path)
    assert tables.row_count(versions.read_table(spark, path)).first()["n"] == 3
    tables.append(spark.range(2), path)
    assert versions.read_table(spark, path).count() == 5
    reader = versions.read_table(spark, path)
    versions.reload_table(versions.read_table(spark, path).where("id > 100"), path)
    assert versions.read_table(spark, path).count() == 0 and reader.count() == 5
    for n in (1, 2, 3):
        versions.reload_table(spark.range(n), path)
    assert versions.read_table(spark, path).count() == 3
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir() and p.name != "versions"]) == 2


def test_a_failed_reload_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.reload_table(spark.range(4), path)
    broken = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.reload_table(broken, path)
    assert versions.read_table(spark, path).count() == 4

    def fails(*_):
        raise OSError("no space left")

    monkeypatch.setattr(versions, "publish", fails)
    with pytest.raises(OSError):
        versions.reload_table(spark.range(7), path)
    assert versions.read_table(spark, path).count() == 4


def test_merge_writes_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, 2000 + k % 4, f"v{k}", "keep") for k in range(40)] + [(100, None, "none", "keep")]
    spark.createDataFrame(rows, "k int, year int, v string, w string").write.partitionBy("year").parquet(path)

    def written():
        return {f.name: {p.name for p in f.glob("*.parquet")} for f in (tmp_path / "t").iterdir() if f.is_dir()}

    before = written()
    batch = [(1, 2001, "new", "lost"), (77, 2001, "added", "given"), (5, 1999, "old year", "given"), (None, 2003, "null key", "given")]
    tables.merge_touched(path, spark.createDataFrame(batch, "k int, year int, v string, w string"), ["k", "year"], ["v"], ["year"])
    after = written()
    assert all(after[f] == before[f] for f in ("year=2000", "year=2002", "year=__HIVE_DEFAULT_PARTITION__"))
    assert after["year=2001"].isdisjoint(before["year=2001"]) and "year=1999" in after
    got = {(r["k"], r["year"], r["v"], r["w"]) for r in spark.read.parquet(path).collect()}
    assert got == ({tuple(r) for r in rows} - {(1, 2001, "v1", "keep")}) | {(1, 2001, "new", "keep"), *batch[1:]}
    tables.merge_touched(path, spark.createDataFrame([], "k int, year int, v string, w string"), ["k", "year"], ["v"], ["year"])
    assert written() == after
    tables.merge_touched(path, spark.createDataFrame([(200, None, "x", "y")], "k int, year int, v string, w string"), ["k", "year"], ["v"], ["year"])
    assert spark.read.parquet(path).where("year is null").count() == 2
    with pytest.raises(ValueError):
        tables.merge_touched(path, spark.createDataFrame(batch, "k int, year int, v string, w string"), ["k"], ["v"], ["year"])


# ------------------------------------------------------------- files cut anywhere


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of some hundred bytes."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        for k in keep:
            spark.conf.set(k, size)

    yield cut
    for k, v in keep.items():
        spark.conf.set(k, v)


FIELDS = ["plain", "", "two\nlines", 'a "quoted" word', "comma, inside", "é Latin", "\n\n", '"', "x" * 700, "many\n" * 90, "tab\t", " edges "]


@pytest.mark.parametrize("size", [150, 1000, 10**8])
def test_quoted_breaks_are_read_in_many_tasks(spark, tmp_path, small_ranges, size):
    rng = np.random.default_rng(size)
    want = []
    for part in range(2):
        rows = [(str(i), FIELDS[rng.integers(0, len(FIELDS))], FIELDS[rng.integers(0, len(FIELDS))]) for i in range(60)]
        lines = [",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v for v in r) for r in [("id", "a", "b"), *rows]]
        end = "\r\n" if part else "\n"
        (tmp_path / f"f{part}.csv").write_bytes((end.join(lines) + (end if size != 150 else "")).encode("latin-1"))
        want += rows
    small_ranges(size)
    records = splitting.csv_records(spark, str(tmp_path))
    assert size == 10**8 or records.rdd.getNumPartitions() > 4
    parsed = records.select(F.from_csv("value", "id string, a string, b string", {"escape": '"', "emptyValue": ""}).alias("r")).select("r.*")
    assert sorted((r["id"], r["a"] or "", r["b"] or "") for r in parsed.collect()) == sorted(want)


def test_csv_that_ends_inside_quotes(spark, tmp_path, small_ranges):
    (tmp_path / "f.csv").write_text('id,a\n1,"x\ny"\n\n2,"open\nto the end' + "\nline" * 50)
    small_ranges(40)
    got = sorted(r["value"] for r in splitting.csv_records(spark, str(tmp_path)).collect())
    assert got == ['1,"x\ny"', '2,"open\nto the end' + "\nline" * 50]
    (tmp_path / "none.csv").write_text("")
    assert splitting.csv_records(spark, str(tmp_path / "none.csv")).collect() == []


ENTRY = "a string, n long, inner struct<x:string>, l array<string>"


@pytest.mark.parametrize("size,indent", [(200, None), (300, 2), (10**8, None)])
def test_one_json_object_is_read_in_many_tasks(spark, tmp_path, small_ranges, size, indent):
    texts = ["", "a } brace", '{"not": "an entry"}', 'quote " and \\ slash', "line\nbreak", "é ü", "[,]", "x" * 500, '}"}', "\\"]
    entries = {f"k{i} {texts[i % 10][:9]}": {"a": texts[i % 10], "n": i, "inner": {"x": texts[(i * 3) % 10]}, "l": [texts[(i * 7) % 10]] * (i % 3)} for i in range(30)}
    mixed = dict(entries)
    mixed["scalar"], mixed["list"], mixed["null"], mixed["text"] = 5, [1, [2]], None, "} {"
    mixed["last one"] = {"a": "z", "n": 1000}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "object.json").write_text(json.dumps(mixed, indent=indent, ensure_ascii=bool(indent)))
    (tmp_path / "o" / "list.json").write_text("\n " + json.dumps([7, *entries.values(), "text"], indent=indent))
    for name, text in (("empty", "{}"), ("none", "[]"), ("blank", " \n"), ("scalars", '{"a": 1}')):
        (tmp_path / "o" / f"{name}.json").write_text(text)
    small_ranges(size)
    schema = spark.createDataFrame([], ENTRY).schema
    got = files.read_keyed_json(spark, str(tmp_path / "o"), schema).collect()
    full = lambda e: (e["a"], e["n"], (e.get("inner") or {}).get("x"), e.get("l"))
    want = [(k, *full(e)) for k, e in mixed.items() if isinstance(e, dict)] + [(None, *full(e)) for e in entries.values()]
    assert sorted((r["key"] or "", r["a"], r["n"]) for r in got) == sorted((k or "", a, n) for k, a, n, _, _ in want)
    assert sorted(map(repr, ((r["key"], r["a"], r["n"], r["inner"] and r["inner"]["x"], r["l"]) for r in got))) == sorted(map(repr, want))


def test_a_json_object_of_many_entries(spark, tmp_path, small_ranges):
    path = tmp_path / "many.json"
    with path.open("w") as out:
        out.write("{" + ",".join(f'"k{i}": {{"a": "text }} {i}", "n": {i}}}' for i in range(200_000)) + "}")
    small_ranges(1 << 20)
    rows = files.read_keyed_json(spark, str(path), spark.createDataFrame([], "a string, n long").schema)
    assert rows.rdd.getNumPartitions() > 4
    assert rows.agg(F.count("*"), F.sum("n"), F.count_distinct("key")).first()[:] == (200_000, 199_999 * 100_000, 200_000)


def test_resolve_and_default(spark):
    df = spark.createDataFrame([(1,)], "week int")
    assert tables.resolve_column(df, ["date", "week"], "date").columns == ["date"]
    with pytest.raises(ValueError):
        tables.resolve_column(df, ["a"], "b")
    row = tables.default_missing(df, {"x": ("double", None), "week": ("int", 9)}).first()
    assert row["x"] is None and row["week"] == 1


def test_load_anomalies_keeps_the_best(spark):
    rows = [("k", DAY, 3.0, "iqr", 0.5), ("k", DAY, 0.0, "mann_kendall", 0.9)]
    df = spark.createDataFrame(rows, "kpi_name string, date date, deviation_pct double, method string, confidence double").withColumn("severity", F.lit("low"))
    row = tables.load_anomalies(df).first()
    assert (row["id"], row["detection_methods"], row["direction"], row["actual_value"]) == (1, ["mann_kendall"], "below", None)


def test_load_kpi_results_takes_first_date_candidate_and_the_last_row(spark):
    rows = [("2024-01-01 10:00:00", "2024-01-01", 9.0, None, 1), ("2024-01-01 10:00:00", "2024-01-01", 5.0, None, 2)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "timestamp string, calculation_date string, a double, b double, seq int")
        rows_ = tables.load_kpi_results(df, "seq").collect()
        assert [(r["kpi_name"], r["week_date"], r["value"]) for r in rows_] == [("a", dt.date(2024, 1, 1), 5.0)]


def test_parameterised_query(spark):
    frame = spark.range(5)
    assert tables.query(spark, "SELECT * FROM {t} WHERE id >= :low", {"low": 3}, t=frame).count() == 2


# ---------------------------------------------------------------------- files


def test_transactions_csv_round_trip(spark, make_tx, tmp_path):
    tx = make_tx([("536365", "2021-03-06 10:00", "0123", 2, 5, None, "Côte d'Ivoire"), ("C536366", "2021-03-06 10:00", "x,\"y\"", -2, 5.1234, "00012", "B")])
    src.write_transactions_csv(tx, str(tmp_path / "csv"))
    back = src.read_transactions_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tx.collect()))


def test_csv_dates_breaks_and_rejects(spark, tmp_path):
    text = (
        "InvoiceNo,InvoiceDate,StockCode,Description,Quantity,UnitPrice,CustomerID,Country\n"
        '1,12/1/2010 8:26,A,"two\nlines",3,1.5,,UK\n'
        "2,2010-12-01 08:26:00,B,x,4,2.5,c,UK\n"
        "3,someday,B,x,4,2.5,c,UK\n"
        "4,2010-12-01 08:26:00,B,x,many,2.5,c,UK\n"
        "5,2010-12-01 08:26:00,B\n"
    )
    (tmp_path / "t.csv").write_text(text)
    path = str(tmp_path / "t.csv")
    rows = src.read_transactions_csv(spark, path, multiline=True, on_reject="skip").orderBy("InvoiceNo").collect()
    assert [(r["InvoiceNo"], str(r["InvoiceDate"]), r["Description"], r["Quantity"]) for r in rows] == [
        ("1", "2010-12-01 08:26:00", "two\nlines", 3),
        ("2", "2010-12-01 08:26:00", "x", 4),
    ]
    rejects = [r["reject"] for r in src.read_csv_rejects(spark, path, multiline=True).collect()]
    assert sorted(rejects) == ["malformed row", "no valid InvoiceDate", "no valid Quantity"]
    with pytest.raises(Exception, match="rejected CSV row"):
        src.read_transactions_csv(spark, path, multiline=True).count()
    # without the option the broken row is reported, not lost
    assert src.read_csv_rejects(spark, path).count() == 5


def test_csv_fields_are_parsed_once(spark, tmp_path):
    """Neither the filter on rejects nor the columns repeat the parsing, and only formats that a text can have are tried."""
    (tmp_path / "t.csv").write_text("header\n1,12/1/2010 8:26,A,x,1,2.0,,N\n")
    rows = src.read_transactions_csv(spark, str(tmp_path / "t.csv"), multiline=True, on_reject="skip")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1 and plan.count("gettimestamp(") == len(src.DATE_FORMATS)
    texts = [
        "2010-12-01 08:26:00", "2010-12-01 08:26", "2010-12-01", "12/1/2010 8:26", "12/01/2010 08:26", " 2010-12-01", "2010-12-01\n", "+20100-12-01",
        "-2010-12-01", "2010-1-1", "12/1/10 8:26", "12/1/+2010 8:26", "00012/1/2010 8:26", "2010-02-30", "some day", "", "2010-12-01T08:26:00", None,
    ]
    given, text = spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")
    for form in [*src.DATE_FORMATS, "d MMM yyyy"]:
        plain = F.try_to_timestamp(text, F.lit(form)).cast("string")
        assert given.where(~F.when(src._looks_like(text, form), plain).eqNullSafe(plain)).collect() == []


def test_lineitem_is_shuffled_before_it_is_wide(spark, tmp_path):
    """Orders meet customers on their own, so lineitem goes through two joins with large tables; orders without customer or nation drop out."""
    tables_ = {
        "nation": ("n_nationkey int, n_name string", [(0, "A"), (1, "B")]),
        "customer": ("c_custkey long, c_nationkey int", [(1, 0), (2, 1), (2, 1), (3, 9)]),
        "part": ("p_partkey long, p_name string, p_retailprice double", [(7, "bolt", 1.5), (8, "nut", 2.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", [(k, c, dt.datetime(1996, 1, k)) for k, c in ((1, 1), (2, 2), (3, 3), (4, None), (5, 1))]),
        "lineitem": ("l_orderkey long, l_partkey long, l_quantity double, l_returnflag string", [(1, 7, 1.0, "N"), (2, 8, 2.0, "R"), (3, 7, 1.0, "N"), (4, 7, 1.0, "N"), (5, 9, 1.0, "N"), (5, 8, 3.0, None)]),
    }
    for name, (schema, rows) in tables_.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    tx = src.from_order_tables(spark, str(tmp_path))
    got = sorted(tuple(r) for r in tx.select("InvoiceNo", "Description", "Quantity", "Country").collect())
    assert got == [("000001", "bolt", 1, "A"), ("000005", "nut", 3, "A"), ("C000002", "nut", -2, "B"), ("C000002", "nut", -2, "B")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = src.from_order_tables(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 4 and "l_orderkey" in joins[0] and sum("l_" in j for j in joins) == 2


def test_week_folders_prune(spark, make_tx, tmp_path):
    rows = [(str(i), f"2021-03-{1 + i:02d} 10:00", "A", 1, 1, "c", "X") for i in range(20)]
    src.write_transactions(make_tx(rows), str(tmp_path / "tx"))
    stored = src.read_transactions(spark, str(tmp_path / "tx"))
    assert stored.count() == 20 and stored.where(F.col("week_end") == DAY).count() == 0
    assert "PartitionFilters: [isnotnull(week_end" in stored.where(F.col("week_end") == DAY)._jdf.queryExecution().toString()


def test_call_log_lines(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    good = '{"timestamp": "2024-01-01T00:00:00", "status": "success", "latency_ms": 5, "quality_flags": ["a"]}'
    (path / "x.jsonl").write_text(f"{good}\n\n{{broken\n{good}\n")
    assert files.read_call_log(spark, str(path)).count() == 2
    with pytest.raises(Exception):
        files.read_call_log(spark, str(path), strict=True).collect()
    files.append_call_log(files.read_call_log(spark, str(path)), str(tmp_path / "log2"))
    assert files.read_call_log(spark, str(tmp_path / "log2"), strict=True).first()["quality_flags"] == ["a"]


def test_keyed_json_objects_and_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k_2021-03-28": {"kpi_name": "k", "date": "2021-03-28", "narrative": "t", "retrieved_context": ["x"]}}')
    (tmp_path / "b.json").write_text('[{"kpi_name": "m", "anomaly_date": "2021-03-21", "narrative_text": "u"}]')
    rows = files.read_keyed_json(spark, str(tmp_path / "*.json")).orderBy("kpi_name").collect()
    assert [(r["key"], r["kpi_name"]) for r in rows] == [("k_2021-03-28", "k"), (None, "m")]
    files.write_keyed_json(files.read_keyed_json(spark, str(tmp_path / "a.json")), str(tmp_path / "out"))
    assert files.read_keyed_rows(spark, str(tmp_path / "out")).first()["retrieved_context"] == ["x"]


def test_root_causes_keep_stock_codes_as_text(spark, tmp_path):
    row = tuple({"kpi_name": "k", "date": DAY, "status": "analysed", "driver_2_segment": "023084"}.get(n) for n in ROOT_CAUSES_FLAT.names)
    files.write_root_causes(spark.createDataFrame([row], ROOT_CAUSES_FLAT), str(tmp_path / "rc"))
    assert files.read_root_causes(spark, str(tmp_path / "rc")).first()["driver_2_segment"] == "023084"


def test_precompute_writes_four_tables(spark, make_tx, tmp_path):
    rows = [(str(i), f"2021-{1 + i // 28:02d}-{1 + i % 28:02d} 10:00", f"p{i % 3}", 1 + (i == 60) * 500, 2, f"c{i % 5}", "X") for i in range(84)]
    precompute.precompute_all(make_tx(rows), str(tmp_path / "cache"))
    precompute.precompute_all(make_tx(rows), str(tmp_path / "cache"))
    counts = {n: files.read_cache(spark, str(tmp_path / "cache"), n).count() for n in files.CACHE_TABLES}
    assert counts["kpi_timeseries"] == 13 and counts["kpi_latest"] == 1
    assert counts["anomalies"] >= counts["root_causes"] > 0


# ------------------------------------------------------------------ data quality


def test_quality_report(spark, make_tx):
    tx = make_tx(
        [
            ("100001", "2021-03-06 10:00", "A", 1, 5, "10001", "UK"),
            ("C100002", "2021-03-06 10:00", "A", 0, 5, None, "UK"),  # zero quantity passes
            ("100003", "2021-03-07 10:00", "A", 10, 10000, "10001", "UK"),  # exactly the value limit
        ]
    )
    checks = {(r["check_group"], r["check_name"]): r["passes"] for r in quality.quality_checks(tx).collect()}
    assert len(checks) == 14 and [k for k, ok in checks.items() if not ok] == [("completeness", "CustomerID")]
    report = quality.quality_report(tx).first()
    assert (report["total_checks"], report["passed_checks"], report["recommendation"]) == (14, 13, "FAIL")
    with pytest.raises(quality.QualityGateError):
        quality.quality_gate(tx)
    assert quality.quality_gate(tx, on_breach="log").count() == 3
    with pytest.raises(quality.QualityGateError):
        quality.quality_gate(tx.drop("Country"), on_breach="log")


def test_schema_errors(make_tx):
    tx = make_tx([])
    assert quality.schema_errors(tx) == []
    assert quality.schema_errors(tx.withColumn("UnitPrice", F.lit(1.0))) == []
    assert len(quality.schema_errors(tx.drop("Country").withColumn("Quantity", F.lit("1")))) == 2
    assert quality.extra_columns(tx.withColumn("z", F.lit(1))) == ["z"]


def test_monotonic_violations_across_spans(spark):
    days = [1, 2, 5, 4, 6, 3, 7]
    df = spark.createDataFrame([(i, dt.datetime(2021, 1, d)) for i, d in enumerate(days)], "pos int, InvoiceDate timestamp_ntz")
    for span in (1, 2, 3, 100):
        assert quality.monotonic_violations(df, "pos", span=span).first()["violations"] == 2


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantiles_match_the_builtin(spark, n):
    df = spark.range(n).select(F.pmod(F.hash("id"), F.lit(13)).cast("double").alias("x"))
    q1, q3 = df.agg(F.percentile("x", [0.25, 0.75])).first()[0]
    row = quality.iqr_outliers(df, "x").first()
    assert (row["q1"], row["q3"], row["n_values"]) == (q1, q3, n)


@pytest.mark.parametrize("held,steps", [(20_000, 1000), (4, 10)])
def test_quantiles_of_awkward_columns(spark, monkeypatch, held, steps):
    monkeypatch.setattr(quantiles, "_HELD", held)
    monkeypatch.setattr(quantiles, "_STEPS", steps)
    rng = np.random.default_rng(2)
    columns = {
        "distinct": rng.normal(size=3000).tolist(),
        "ties": rng.integers(0, 3, 500).astype(float).tolist(),
        "range": (10.0 ** rng.integers(-300, 300, 400) * rng.choice([-1, 1], 400)).tolist(),
        "one": [4.5],
        "two": [1.0, None, 2.0],
        "spike": [0.0] * 900 + rng.random(100).tolist(),
    }
    for name, values in columns.items():
        df = spark.createDataFrame([(v,) for v in values], "x double")
        known = np.array([v for v in values if v is not None])
        got, n = quantiles.quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0])
        assert n == len(known) and got == pytest.approx(np.quantile(known, [0, 0.25, 0.5, 0.75, 1]).tolist(), rel=1e-12, abs=0), name
    nan = spark.createDataFrame([(v,) for v in (1.0, float("nan"), 3.0, 2.0)], "x double")
    got, n = quantiles.quantiles(nan, "x", [0.0, 2 / 3, 1.0])
    assert got[:2] == [1.0, 3.0] and math.isnan(got[2]) and n == 4
    assert quantiles.quantiles(nan.limit(0), "x", [0.5]) == ([None], 0)


@pytest.mark.parametrize("colliding", [False, True])
def test_duplicates_are_compared_in_full_where_fingerprints_repeat(spark, monkeypatch, colliding):
    if colliding:
        monkeypatch.setattr(src, "fingerprint", lambda df: [F.crc32(F.col("c").cast("binary")) % 3, F.lit(0).cast("long")])
    rows = [("a", None, "x"), (None, "a", "x"), ("a", None, "x"), ("ab", "c", "y"), ("a", "bc", "y"), (None, None, "z"), (None, None, "z"), ("q", "r", "w")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert sorted(map(tuple, src.dedupe_transactions(df).collect()), key=repr) == sorted(set(rows), key=repr)
    row = quality.duplicate_rate(df).first()
    assert (row["total_rows"], row["distinct_rows"]) == (8, 6)
    assert quality.duplicate_rate(df.limit(0)).first()["duplicate_rate"] == 0.0


def test_only_repeated_rows_are_shuffled_whole(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("w"), 500).alias("wide"))
    counts, repeated = src.repeated_rows(df.unionByName(df.where("id < 3")))
    assert counts.columns == ["_h0", "_h1", "n"] and repeated.count() == 6


def test_duplicates_gaps_and_counts(make_tx):
    row = ("1", "2021-03-01 10:00", "A", 1, 1, "c", "X")
    tx = make_tx([row, row, ("2", "2021-03-12 10:00", "A", 1, 1, "c", "X")])
    assert quality.duplicate_rate(tx).first()["duplicate_rate"] == pytest.approx(1 / 3)
    assert src.dedupe_transactions(tx).count() == 2
    assert [r["gap_days"] for r in quality.temporal_gaps(tx).collect()] == [11]
    assert {r["n_rows"]: r["status"] for r in quality.daily_row_counts(tx, 2, 5).collect()} == {2: "warn", 1: "fail", 0: "fail"}
    assert quality.daily_row_counts(tx, 2, 5).count() == 12
    assert quality.freshness(tx, F.lit("2021-03-13 09:00:00")).first()["passes"]


# ------------------------------------------------------------- texts and call log


@pytest.mark.parametrize(
    "text, flags",
    [
        ("", ["output_too_short", "empty_output"]),
        ("x" * 49, ["output_too_short"]),
        ("x" * 50, []),
        ("x" * 600, []),
        ("x" * 601, ["output_too_long"]),
        ("x" * 60 + "." * 6, []),
        ("x" * 60 + ".!" * 3 + "!", ["too_many_sentences"]),
        ("I " + "x" * 60, ["starts_with_i"]),
        ("x" * 60 + " 5%", ["contains_percentages"]),
        ("x" * 60 + " PerCent", ["contains_percentages"]),
        ("\n" * 60, ["empty_output"]),
    ],
)
def test_quality_flags(spark, text, flags):
    row = monitoring.evaluate_texts(spark.createDataFrame([(text,)], "text string")).first()
    assert row["quality_flags"] == flags and row["output_length_chars"] == len(text)


def log(spark, *rows):
    names = CALL_LOG.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CALL_LOG)


def test_call_summaries(spark):
    calls = log(
        spark,
        {"timestamp": "2024-01-01T10:00:00", "prompt_version": "v1", "status": "success", "latency_ms": 100, "total_tokens": 10, "estimated_cost_usd": 0.1, "quality_flags": ["contains_percentages"]},
        {"timestamp": "bad", "prompt_version": "v1", "status": "success", "latency_ms": 201, "total_tokens": 11, "estimated_cost_usd": 0.2},
        {"timestamp": "2024-01-01T10:00:00", "prompt_version": "v2", "status": "error", "estimated_cost_usd": 0.4},
    )
    s = monitoring.call_log_summary(calls).first()
    assert (s["total_calls"], s["successful"], s["failed"], s["success_rate_pct"]) == (3, 2, 1, 66.7)
    assert s["total_cost_usd"] == 0.7 and s["avg_latency_ms"] == 150.0 and s["avg_tokens_per_call"] == 10.0
    assert monitoring.latency_series(calls).count() == 1
    assert monitoring.flag_frequency(calls).first()["pct_of_calls"] == 50.0
    prompts = retrieval.prompt_catalogue(spark, [("v1", "a", ""), ("v2", "b", "")])
    stats = {r["prompt_version"]: (r["calls"], r["pct_violations"]) for r in monitoring.prompt_version_stats(prompts, calls).collect()}
    assert stats == {"v1": (2, 1), "v2": (0, 0)}
    # The stored table trusts its own success column, so the view counts the error as a success.
    view = {r["prompt_version"]: r["successful_calls"] for r in monitoring.monitoring_summary(monitoring.load_calls(calls)).collect()}
    assert view == {"v1": 2, "v2": 1}


def test_load_calls_fills_what_is_absent(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00", "m", "v1", "k", 0.5)], "timestamp string, model string, prompt_version string, kpi_name string, cost_usd double")
    row = monitoring.load_calls(df).first()
    assert (row["estimated_cost_usd"], row["success"], row["quality_flags"], row["anomaly_date"]) == (0.5, True, [], None)


def entries(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NARRATIVE_ENTRY.names) for r in rows], NARRATIVE_ENTRY)


def test_parse_narratives(spark):
    parsed = retrieval.parse_narratives(
        entries(
            spark,
            {"kpi_name": "a", "date": "2021-03-28 00:00:00", "narrative": "t", "retrieved_context": ["x"]},
            {"kpi_name": "b", "anomaly_date": "2021-03-21", "narrative_text": "u", "prompt_version": "v2", "generated_at": "2021-03-22T01:02:03"},
            {"kpi_name": "c", "date": "NaT", "narrative": "t"},
            {"kpi_name": "d", "date": "2021-03-28", "narrative": ""},
            {"kpi_name": "e", "date": "soon", "narrative": "t"},
        ),
        "rag",
        F.lit("2024-01-01").cast("timestamp_ntz"),
    )
    rows = {r["kpi_name"]: r for r in parsed.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["retrieved_context"] == '["x"]' and rows["a"]["prompt_version"] == "unknown"
    assert rows["a"]["generated_at"] == dt.datetime(2024, 1, 1) and rows["b"]["generated_at"] == dt.datetime(2021, 3, 22, 1, 2, 3)


# ---------------------------------------------------------------------- retrieval


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, kpi_name string, embedding array<float>")


def test_similar_topk_small(spark):
    corpus = vectors(
        spark, [("a", "k", [1.0, 0.0]), ("b", "k", [1.0, 0.1]), ("c", "m", [1.0, 0.0]), ("d", "k", [0.0, 1.0]), ("z", "k", [0.0, 0.0])]
    )
    query = corpus.where("id = 'a'")
    anywhere = retrieval.similar_topk(query, corpus, 3).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in anywhere] == [("c", 0.0), ("b", 0.005)]
    same = retrieval.similar_topk(query, corpus, 3, None, same_kpi_only=True).orderBy("rank").collect()
    assert [r["id"] for r in same] == ["b", "d"]


def test_similar_topk_finds_pivots_among_vectors_without_direction(spark):
    without = [[0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0]]
    rows = [(f"z{i}", "k", without[i % 4]) for i in range(400)] + [("a", "k", [1.0, 0.0]), ("b", "k", [1.0, 0.1])]
    corpus = spark.createDataFrame(rows, "id string, kpi_name string, embedding array<double>")
    found = retrieval.similar_topk(corpus.where("id = 'a'"), corpus, 1).collect()
    assert [(r["query_id"], r["id"]) for r in found] == [("a", "b")]


def test_similar_topk_does_not_depend_on_blocks(spark):
    # One KPI holds most rows, so it is cut into many blocks.
    rows = [(f"id{i:03d}", "hot" if i % 10 else "cold", [float((i * 7) % 11 - 5), float((i * 5) % 13 - 6), 1.0]) for i in range(120)]
    corpus = vectors(spark, rows)
    whole = sorted(map(tuple, retrieval.similar_topk(corpus, corpus, 4, None, True, block_rows=1000).collect()))
    cut = sorted(map(tuple, retrieval.similar_topk(corpus, corpus, 4, None, True, block_rows=9).collect()))
    assert whole == cut and len(whole) == 120 * 4


@pytest.mark.parametrize("max_distance,n", [(None, 3), (0.2, 5), (1.0, 40)])
def test_similar_topk_is_exact_and_skips_cells(spark, max_distance, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(6, 8))
    points = np.concatenate([c + 0.05 * rng.normal(size=(25, 8)) for c in centres] + [np.zeros((1, 8))])
    points[3] = points[2]
    rows = [(f"id{i:03d}", f"k{i % 2}", v.tolist()) for i, v in enumerate(points)] + [("none", "k0", None)]
    corpus = vectors(spark, rows)
    visited = []
    got = {}
    for r in retrieval.similar_topk(corpus, corpus, n, max_distance, True, block_rows=7, pivots=6, visited=visited).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    unit = np.array([r[2] for r in rows[:-2]], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i in range(len(unit)):
        far = np.round(1 - unit @ unit[i], 12)
        want = sorted((d, rows[j][0]) for j, d in enumerate(far) if j != i and (j - i) % 2 == 0 and (max_distance is None or d <= max_distance))
        assert got.get(rows[i][0], []) == [x for _, x in want[:n]]
    cells = {tuple(r) for r in visited[0].select("query_id", "grp", "cell").collect()}
    if n < 40:
        assert len(cells) < len(unit) * (1 + 5 / 2)  # of the other cells, more than half are skipped


def test_similar_topk_visits_grow_slower_than_the_corpus(spark):
    rng = np.random.default_rng(4)
    rates = []
    for each in (20, 80):
        # as many clusters as rows in each
        points = np.concatenate([c + 0.02 * rng.normal(size=(each, 8)) for c in rng.normal(size=(each, 8))])
        corpus = vectors(spark, [(f"id{i:05d}", "k", v.tolist()) for i, v in enumerate(points)])
        queries, visited = corpus.where("crc32(cast(id as binary)) % 8 = 0"), []
        got = {}
        for r in retrieval.similar_topk(queries, corpus, 2, None, visited=visited).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        unit = points.astype(np.float32).astype(float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for query, found in got.items():
            far = np.round(1 - unit @ unit[int(query[2:])], 12)
            far[int(query[2:])] = np.inf
            assert found == [f"id{j:05d}" for j in np.lexsort((np.arange(len(far)), far))[:2]]
        index, width, *_ = retrieval._index(corpus.selectExpr("'all' as grp", "id", "cast(embedding as array<double>) as vector"), 8192, None)
        place = retrieval._stored(index, width, 1)
        rows = corpus.selectExpr("'all' as grp", "id", "cast(embedding as array<double>) as vector").mapInArrow(place, "grp string, id string, vector array<double>, cell long, block long")
        sizes = rows.groupBy("grp", "cell").count()
        met = visited[0].join(sizes, ["grp", "cell"]).selectExpr("sum(count) as n").first()["n"]
        rates.append(met / len(got))
        assert 1 <= len(index["all"].pivots) / math.sqrt(len(points)) <= 3
    # sixteen times the rows
    assert rates[1] < 6 * rates[0] and rates[1] < 0.05 * 6400, rates  # sixteen times the rows


def test_similar_topk_ships_a_row_to_few_regions(spark):
    """Without clusters a query visits all cells, of which there are hundreds; it goes to about 64 regions at most, in small batches."""
    points = np.random.default_rng(3).normal(size=(1500, 24))
    corpus = vectors(spark, [(f"id{i:04d}", "k", v.tolist()) for i, v in enumerate(points)]).repartition(1)
    rows = corpus.selectExpr("'all' as grp", "id", "cast(embedding as array<double>) as vector")
    index, width, others, _ = retrieval._index(rows, 5, None)
    shipped = rows.mapInArrow(retrieval._asked(index, width, others, 2, math.pi), "grp string, query_id string, region long, wanted array<double>")
    most = shipped.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("region").alias("regions")).selectExpr("max(n) as n", "max(regions) as regions").first()
    assert most["n"] == most["regions"] <= 65
    assert max(retrieval._asked(index, width, others, 2, math.pi)([rows.toArrow().to_batches()[0]]), key=len).num_rows <= 512 * 65
    got = {}
    for r in retrieval.similar_topk(corpus, corpus, 2, None, block_rows=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    unit = points.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    far = np.round(1 - unit @ unit.T, 12) + np.diag(np.full(len(unit), np.inf))
    assert all(got[f"id{i:04d}"] == [f"id{j:04d}" for j in np.argsort(far[i], kind="stable")[:2]] for i in range(len(unit)))


def test_vectors_of_another_length_count_as_filled_with_zeros(spark):
    corpus = vectors(spark, [("a", "k", [1.0, 0.0]), ("b", "k", [1.0]), ("c", "k", [1.0, 0.0, 1.0]), ("e", "k", []), (None, "k", [0.5, 0.1])])
    got = retrieval.similar_topk(corpus.where("id in ('a', 'c')"), corpus.where("id <> 'c'"), 3, None).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["distance"]) for r in got] == [("a", "b", 0.0), ("c", "a", 0.2929), ("c", "b", 0.2929)]
    assert retrieval.similar_topk(corpus, corpus.limit(0)).collect() == []
    assert retrieval.similar_topk(corpus.limit(0), corpus).collect() == []


def test_many_queries_are_cut_into_parts(spark):
    rng = np.random.default_rng(9)
    corpus = vectors(spark, [(f"id{i}", "k", [1.0, 0.5]) for i in range(50)] + [(f"x{i}", "k", rng.normal(size=2).tolist()) for i in range(30)])
    whole = sorted(map(tuple, retrieval.similar_topk(corpus, corpus, 3, None).collect()))
    assert sorted(map(tuple, retrieval.similar_topk(corpus, corpus, 3, None, block_rows=6, pivots=4).collect())) == whole and len(whole) == 240


def flat(spark, **values):
    base = {"kpi_name": "avg_unit_price", "date": DAY, "anomaly_severity": "low", "total_deviation": -3.0, "total_deviation_pct": -12.34, "status": "analysed"}
    return spark.createDataFrame([tuple({**base, **values}.get(n) for n in ROOT_CAUSES_FLAT.names)], ROOT_CAUSES_FLAT)


def test_document_prompt_and_query_text(spark):
    row = flat(spark, driver_1_dimension="Country", driver_1_segment="UK", driver_1_contribution_pct=55.0)
    doc = retrieval.build_corpus(row).first()
    assert doc["document"] == (
        "KPI: Average Unit Price. Date: March 2021. Severity: low. The metric was 12.3% below expected. Status: analysed. Top drivers: Country = UK."
    )
    assert doc["id"] == "avg_unit_price_2021-03-28" and doc["direction"] == "below"
    prompts = retrieval.prompt_catalogue(spark, [("v1", "", "old"), ("v2", "", "{kpi}|{date}|{severity}|{deviation_pct:.1f}|{direction}|{drivers_text}")])
    filled = retrieval.render_prompts(row, prompts).first()
    assert filled["prompt"] == "Average Unit Price|March 28, 2021|LOW|12.3|below|Country=UK (55.0% of deviation)"
    assert filled["prompt_version"] == "v2"
    none = retrieval.render_prompts(flat(spark), retrieval.prompt_catalogue(spark)).first()["prompt"]
    assert "no specific segment identified" in none


def test_context_and_pending(spark):
    corpus = retrieval.build_corpus(flat(spark))
    empty = retrieval.context_block(corpus, spark.createDataFrame([], "query_id string, rank int, kpi_name string, date string, severity string, document string"))
    assert empty.first()["context"] == "No similar historical anomalies found."
    near = spark.createDataFrame([("avg_unit_price_2021-03-28", i, "k", "2020-12-01", "low", f"d{i}") for i in (2, 1)], "query_id string, rank int, kpi_name string, date string, severity string, document string")
    assert retrieval.context_block(corpus, near).first()["context"].split("\n")[1:] == [
        "1. k anomaly in December 2020 (severity: low): d1", "2. k anomaly in December 2020 (severity: low): d2"
    ]
    stored = spark.createDataFrame([("avg_unit_price_2021-03-28",)], "key string")
    assert retrieval.pending_narratives(flat(spark), stored).count() == 0
    assert retrieval.pending_narratives(flat(spark), stored, force=True).count() == 1


def test_corpus_refresh(spark):
    built = retrieval.build_corpus(flat(spark))
    other = retrieval.build_corpus(flat(spark, kpi_name="order_count"))
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(retrieval.refresh_corpus(other, flat(spark))) == ["order_count_2021-03-28"]
    assert ids(retrieval.refresh_corpus(other.where("false"), flat(spark))) == ids(built)
    assert ids(retrieval.refresh_corpus(other, flat(spark), force=True)) == ids(built)


# -------------------------------------------------------------------- marts, reports


def test_marts_count_per_product(make_tx):
    tx = make_tx([("1", "2021-03-01 10:00", "A", 1, 2, "c", "X"), ("1", "2021-03-01 10:00", "B", 1, 2, "c", "X"), ("C2", "2021-03-01 10:00", "B", -1, 2, "c", "X")])
    stg = marts.stg_transactions(src.raw_table(tx))
    assert marts.mart_weekly_kpis(stg).first()["order_count"] == 2
    exact = marts.mart_weekly_kpis(stg, exact=True).first()
    assert (exact["order_count"], exact["total_revenue"], exact["week_start"]) == (1, 4.0, dt.date(2021, 3, 1))


def test_clusters_alphabetical_and_ordinal(spark):
    df = spark.createDataFrame([(DAY, "a", "critical", 0.5), (DAY, "b", "medium", 0.6)], "anomaly_date date, kpi_name string, severity string, confidence double")
    assert marts.anomaly_clusters(df).first()["max_severity"] == "medium"
    assert marts.anomaly_clusters(df, ordinal=True).first()["max_severity"] == "critical"


def test_trend_arrows(make_series):
    series = make_series({"short": [1, 2, 3], "up": [1, 1, 1, 1, 2, 2, 2, 2], "flat": [4] * 5, "zero": [0, 0, 0, 0, 1, 1, 1, 1]})
    assert {r["kpi_name"]: r["trend"] for r in reports.trend_arrows(series).collect()} == {"short": "", "up": "↑", "flat": "→", "zero": ""}


def test_value_formats(spark):
    from tillscope.functions import text

    cases = [
        ("total_revenue", 9747747.93, "£9.75M"), ("total_revenue", 2229.5, "£2,230"), ("avg_unit_price", 1.875, "£1.88"),
        ("product_return_rate", 0.198, "19.8%"), ("product_return_rate", 1.5, "1.5%"), ("order_count", 25900.0, "25,900"),
        ("units_sold", 5176450.0, "5.2M"), ("items_per_order", 16.45, "16.4"),
    ]
    df = spark.createDataFrame(cases, "k string, v double, want string")
    for r in df.withColumn("got", text.format_kpi_value(F.col("k"), F.col("v"))).collect():
        assert r["got"] == r["want"], r


def test_half_even_matches_python(spark):
    from tillscope.functions.numbers import fixed, half_even

    values = [0.125, 0.375, 2.675, 1.005, 16.45, 45.175, 58.5, 59.5, -0.5, -2.5, -1.005, 1e9 + 0.5, 3752192.565, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    for r in df.select("v", half_even(v, 2).alias("two"), fixed(v, 0).alias("none"), fixed(v, 1, grouped=True).alias("one")).collect():
        assert (r["two"], r["none"], r["one"]) == (round(r["v"], 2), f"{r['v']:.0f}", f"{r['v']:,.1f}")


def test_a_mark_within_a_value_is_not_filled(spark):
    df = spark.createDataFrame([("a {b} c {a}.", "{b}!", None)], "t string, a string, b string")
    filled = retrieval.fill_once(F.col("t"), {"{a}": F.col("a"), "{b}": F.col("b")})
    assert df.select(filled.alias("x")).first()["x"] == "a  c {b}!."


def test_batch_reads_the_rows_three_times(spark, make_tx, tmp_path):
    rows = [(str(i), f"2021-{1 + i // 28:02d}-{1 + i % 28:02d} 10:00", f"p{i % 3}", 1 + (i == 60) * 500, 2, f"c{i % 5}", "X") for i in range(84)]
    seen = spark.sparkContext.accumulator(0)
    src.write_transactions(make_tx(rows), str(tmp_path / "tx"))
    stored = src.read_transactions(spark, str(tmp_path / "tx"))

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    precompute.precompute_all(stored.mapInArrow(counted, stored.schema), str(tmp_path / "cache"))
    # the third pass drops nothing without a baseline, so each reads every row once
    assert seen.value == 3 * 84
