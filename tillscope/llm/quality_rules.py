"""Adaptive quality rules: thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.common import SPACES
from tillscope.session import stage

SYMBOLS = "[#*$%&|<>]"
_GAP = r"[\x20\x09-\x0D]+"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Measure:
    """A quantity whose usual range is learned. ``grain``: the least spread, so equal values leave room."""

    name: str
    numerator: str
    denominator: str
    grain: float
    two_sided: bool = False

    def value(self) -> Column:
        return F.coalesce(F.try_divide(F.col(self.numerator).cast("double"), F.col(self.denominator).cast("double")), F.lit(0.0))


MEASURES = [
    Measure("symbol_rate", "n_symbols", "n_words", 0.05),
    Measure("upper_rate", "n_upper", "word_chars", 0.05),
    Measure("repeat_rate", "n_repeat_words", "n_words", 0.1),
    Measure("dup_line_rate", "n_dup_lines", "n_lines", 0.1),
    Measure("word_length", "word_chars", "n_words", 0.5, two_sided=True),
]


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; a null text has no words.

    ``n_repeat_words``: the words that lie in a 3-word window which the text holds twice or
    more, each word once. Windows are compared by a 64-bit hash; only a text that repeats one
    sorts its windows.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"))
    trimmed = F.btrim(F.col("text"), F.lit(SPACES))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = base.select(
        "*",
        F.when(trimmed != "", F.split(trimmed, _GAP)).otherwise(F.array().cast("array<string>")).alias("words"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    hashed = split.select(
        "doc_id", "lang", "source", "n_symbols", "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
            F.lit(1),
            F.greatest(F.size("words") - 2, F.lit(0)),
        ).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.withColumn("pairs", F.when(repeats, pairs)).drop("windows")
    same = lambda p, j: F.coalesce(p["h"] == F.get("pairs", j)["h"], F.lit(False))
    met = F.filter(F.transform("pairs", lambda p, i: F.when(same(p, i - 1) | same(p, i + 1), p["i"])), lambda i: i.isNotNull())
    placed = sorted_.withColumn("at", F.when(F.col("pairs").isNotNull(), F.sort_array(met))).drop("pairs")
    covered = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return placed.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(df: DataFrame, keys: list[str], measures: list[Measure], error: float = 0.01) -> DataFrame:
    """A quantile sketch of every measure in every group: (keys, measure, bucket, n).

    Buckets are logarithmic, their width twice the relative ``error``; zero has its own. Two
    sketches merge by adding the counts of equal buckets, so parts, groups and levels of a
    table can be sketched apart. A sketch has at most some thousand rows, however many values.
    """
    log_step = math.log((1 + error) / (1 - error))
    long = df.select(*keys, F.explode(F.map_from_arrays(F.array(*[F.lit(m.name) for m in measures]), F.array(*[m.value() for m in measures]))).alias("measure", "value"))
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / F.lit(log_step))).otherwise(F.lit(-(1 << 20))).cast("int")
    return long.groupBy(*keys, "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], error: float = 0.01) -> DataFrame:
    """Per group and measure: rows, and the lower and upper quartile within the sketch's error."""
    log_step = math.log((1 + error) / (1 - error))
    group = Window.partitionBy(*keys, "measure")
    run = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketches.withColumn("upto", F.sum("n").over(run)).withColumn("rows", F.sum("n").over(group))
    middle = 2.0 / (1.0 + math.exp(log_step))
    value = F.when(F.col("bucket") == -(1 << 20), 0.0).otherwise(F.exp(F.col("bucket") * F.lit(log_step)) * F.lit(middle))
    at = lambda q: F.min(F.when(F.col("upto") > F.lit(q) * (F.col("rows") - 1), F.struct("bucket", value.alias("v"))))["v"]
    return ranked.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def limits(df: DataFrame, least_rows: int = 100, fence: float = 4.0) -> DataFrame:
    """One row per (lang, source) of ``df`` with the lower and upper limit of every measure.

    The limits lie ``fence`` spreads outside the quartiles of the group; a spread is the
    distance of the quartiles, at least the measure's grain. A group of fewer than
    ``least_rows`` rows takes the merged sketch of its language, or that of all rows.
    """
    own = stage(sketch(df, ["lang", "source"], MEASURES), "sketches")
    by_lang = merged(own, ["lang"])
    whole = quantiles(merged(own, []), [])
    per_lang = quantiles(by_lang, ["lang"])
    per_group = quantiles(own, ["lang", "source"])
    renamed = lambda q, tag: q.select(*[F.col(c).alias(c if c == "measure" else f"{tag}_{c}") for c in q.columns])
    lang_ = renamed(per_lang, "l").withColumnRenamed("measure", "l_measure")
    all_ = renamed(whole, "a").withColumnRenamed("measure", "a_measure")
    joined = per_group.join(lang_, (F.col("measure") == F.col("l_measure")) & F.col("lang").eqNullSafe(F.col("l_lang"))).join(
        all_, F.col("measure") == F.col("a_measure")
    )
    pick = lambda q: F.when(F.col("rows") >= least_rows, F.col(q)).when(F.col("l_rows") >= least_rows, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    picked = joined.select("lang", "source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    made = []
    for m in MEASURES:
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(m.grain))
        mine = F.col("measure") == m.name
        made.append(F.max(F.when(mine, F.col("q3") + fence * spread)).alias(f"{m.name}_high"))
        if m.two_sided:
            made.append(F.max(F.when(mine, F.col("q1") - fence * spread)).alias(f"{m.name}_low"))
    return picked.groupBy("lang", "source").agg(*made)


def apply_rules(docs: DataFrame, least_rows: int = 100, fence: float = 4.0) -> DataFrame:
    """The counts of every document, whether the base rules reject it, and whether it is kept.

    A document that passes the base rules is kept if all its measures lie within the limits of
    its language and source, which are learned from all documents that pass the base rules.
    Null lang or source is a group like any other. One row for each row given.
    """
    counted = stage(counts(docs).withColumn("base_failed", base_failed()), "counts")
    bounds = limits(counted.where("not base_failed"), least_rows, fence)
    bounds = bounds.withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
    met = counted.join(bounds, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    within = ~F.col("base_failed")
    for m in MEASURES:
        within = within & (m.value() <= F.col(f"{m.name}_high"))
        if m.two_sided:
            within = within & (m.value() >= F.col(f"{m.name}_low"))
    return met.select("doc_id", *_COUNTS, "base_failed", F.coalesce(within, F.lit(False)).alias("kept"))
