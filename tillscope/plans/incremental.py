"""The batch brought up to date: only weeks whose files changed are read again.

The facts behind the KPIs (sums per week, invoice and customer, per product, per hour) are
stored by week next to the result cache. What a week's facts were made of is marked by the
names of the files it held, which the result cache lists together with the folder that its facts
lie in. A refresh reads the transactions of weeks whose mark is new, writes their facts to a
folder of their own, and publishes the four result tables with the new list in one step; a
failure on the way leaves the cache and the facts it names as they were.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope import catalogue as cat
from tillscope.operators.attribution import flatten_drivers, root_cause_all
from tillscope.operators.detection import detect_all, point_anomalies
from tillscope.operators.kpis import kpi_facts, kpis_of_facts, unpivot_kpis
from tillscope.session import stage
from tillscope.sources.files import read_cache, write_cache
from tillscope.sources.versions import delete, exists, new_version, versions

UNDATED = "undated"
_WEEKS = "kpi_weeks"
_WEEKS_SCHEMA = "week string, mark string, load string, baseline string"


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the weeks whose facts were made anew, those that had no rows any more, the anomalies explained anew."""

    made: list[str]
    gone: list[str]
    explained: int


def week_marks(tx: DataFrame, home_country: str = cat.HOME_COUNTRY) -> dict[str, str]:
    """Per week of a table that ``write_transactions`` made, a digest of its file names.

    Files are never changed in place, so rows that were added, replaced or removed show in the names.
    """
    held = defaultdict(list)
    for file in tx.inputFiles():
        week = re.search(r"/week_end=([^/]+)/", file)
        if week is None:
            raise ValueError(f"{file} is not in the folder of a week; store the rows by write_transactions")
        name = unquote(week[1])
        held[UNDATED if name == "__HIVE_DEFAULT_PARTITION__" else name].append(file.rsplit("/", 1)[1])
    return {w: hashlib.sha256("\n".join([home_country, *sorted(names)]).encode()).hexdigest() for w, names in held.items()}


def _in_weeks(column: str, weeks) -> Column:
    dated = [dt.date.fromisoformat(w) for w in weeks if w != UNDATED]
    return F.col(column).isin(dated) | (F.col(column).isNull() & F.lit(UNDATED in weeks))


def _facts_schema(tx: DataFrame, home_country: str) -> T.StructType:
    return kpi_facts(tx, "W", home_country).schema


def read_facts(spark: SparkSession, path: str, loads: dict[str, str], schema: T.StructType) -> DataFrame:
    """The facts of the weeks in ``loads``, each from the folder of the load that made it; no other folder is listed."""
    if not loads:
        return spark.createDataFrame([], schema)
    both = T.StructType([*schema.fields, T.StructField("load", T.StringType()), T.StructField("week", T.StringType())])
    folders = [f"{path}/facts/load={load}/week={week}" for week, load in sorted(loads.items())]
    return spark.read.schema(both).option("basePath", f"{path}/facts").parquet(*folders).drop("load", "week")


def refresh(tx: DataFrame, path: str, home_country: str = cat.HOME_COUNTRY, baseline=None) -> Refresh:
    """Bring the result cache at ``path`` up to ``tx``, a table stored by week; the first time, make it.

    The tables equal those of ``precompute_all``. Weekly KPIs are computed for the changed weeks
    and the others are taken over. All-time KPIs, with their distinct counts over invoices and
    customers that may lie in several weeks, come from the facts of all weeks, not from the rows.
    Anomalies are found in the whole series. Root causes are taken over where the anomaly is the
    same and neither its week nor the baseline changed; the rest is explained anew, which reads
    the baseline and the weeks concerned, and nothing if there is no rest. Without a baseline
    period every row belongs to the baseline. Undated rows are a week of their own.
    """
    spark = tx.sparkSession
    marks = week_marks(tx, home_country)
    held = {r["week"]: r for r in _listed(spark, path)}
    made = sorted(w for w, mark in marks.items() if w not in held or held[w]["mark"] != mark)
    gone = sorted(set(held) - set(marks))
    told = repr([str(b) for b in baseline or ()])
    same_baseline = bool(held) and all(r["baseline"] == told for r in held.values())
    if same_baseline and not made and not gone:
        return Refresh([], [], 0)

    schema = _facts_schema(tx, home_country)
    load, _ = new_version(path)
    if made:
        facts = kpi_facts(tx.where(_in_weeks("week_end", made)), "W", home_country)
        week = F.coalesce(F.col("date").cast("string"), F.lit(UNDATED))
        facts.withColumn("week", week).hint("rebalance", F.col("week")).write.partitionBy("week").parquet(f"{path}/facts/load={load}")
    loads = {w: load if w in made else held[w]["load"] for w in marks}

    changed = [*made, *gone]
    wide = kpis_of_facts(read_facts(spark, path, {w: load for w in made}, schema), True, home_country)
    if held:
        kept = read_cache(spark, path, "kpi_timeseries").where(~_in_weeks("date", changed))
        wide = wide.unionByName(kept)
    wide = stage(wide, "kpi_timeseries")
    anomalies = stage(detect_all(unpivot_kpis(wide), baseline), "anomalies")

    points = point_anomalies(anomalies)
    untouched = None
    if same_baseline and baseline and not any(_within(w, baseline) for w in changed):
        untouched = points.where(~_in_weeks("date", changed)).intersect(read_cache(spark, path, "anomalies").select(*points.columns))
    causes, explained = _causes(tx, path, points, untouched, baseline)
    rows = [(w, mark, loads[w], told) for w, mark in sorted(marks.items())]
    write_cache(
        path,
        kpi_timeseries=wide,
        kpi_latest=kpis_of_facts(read_facts(spark, path, loads, schema), False, home_country),
        anomalies=anomalies,
        root_causes=causes,
        **{_WEEKS: spark.createDataFrame(rows, _WEEKS_SCHEMA)},
    )
    return Refresh(made, gone, explained)


def _causes(tx: DataFrame, path: str, points: DataFrame, untouched: DataFrame | None, baseline) -> tuple[DataFrame, int]:
    """The flat root causes of all ``points``, and how many were explained anew."""
    if untouched is None:
        return flatten_drivers(root_cause_all(tx, points, baseline)), points.count()
    by = ["kpi_name", "date"]
    same = stage(untouched.select(*by), "untouched")
    old = read_cache(tx.sparkSession, path, "root_causes").join(same, by, "left_semi")
    rest = stage(points.join(same, by, "left_anti").select(*points.columns), "unexplained")
    n = rest.count()
    return (flatten_drivers(root_cause_all(tx, rest, baseline)).unionByName(old), n) if n else (old, 0)


def _within(week: str, baseline) -> bool:
    """True if rows of the week may lie in the baseline."""
    if week == UNDATED:
        return False
    first, last = (dt.date.fromisoformat(str(b)[:10]) for b in baseline)
    end = dt.date.fromisoformat(week)
    return end >= first and end - dt.timedelta(days=6) <= last


def _listed(spark: SparkSession, path: str, version: str | None = None) -> list:
    """The weeks that a version of the cache (the last) was made of; none if there is none or the whole batch made it."""
    listed = versions(spark, path)
    if not listed or not exists(spark, place := f"{path}/{version or listed[-1]}/{_WEEKS}"):
        return []
    return spark.read.schema(_WEEKS_SCHEMA).parquet(place).collect()


def drop_stale(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` versions of the cache, and facts that none of those names; the folders removed.

    Not to be run beside a refresh, whose facts no version names yet.
    """
    listed = versions(spark, path)
    old, kept = listed[: -max(1, keep)], listed[-max(1, keep) :]
    used = {f"facts/load={r['load']}/week={r['week']}" for v in kept for r in _listed(spark, path, v)}
    stale = [*old, *sorted(_stored_facts(spark, path) - used)]
    return [folder for folder in stale if delete(spark, f"{path}/{folder}")]


def _stored_facts(spark: SparkSession, path: str) -> set[str]:
    if not exists(spark, f"{path}/facts"):
        return set()
    files = spark.read.schema("week string").option("recursiveFileLookup", "true").parquet(f"{path}/facts").inputFiles()
    return {re.search(r"facts/load=[^/]+/week=[^/]+(?=/)", file)[0] for file in files}
