"""Typed metric specs and how each becomes a Column or a small sub-aggregate.

A KPI is declared as a value such as ``Ratio(Sum("Quantity"), CountDistinct("InvoiceNo"))``.
Simple specs compile to one aggregate Column; ``EntitiesOver``, ``FirstSeen`` and
``TopNSum`` need a second grouping level and compile to a frame.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- predicates

COMPARISONS = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def is_in(column: str, *values) -> Column:
    return F.col(column).isin(*values)


def not_equal(column: str, value) -> Column:
    """True for every row that is not ``value``, null rows included."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def compare(column: str, op: str, value) -> Column:
    return COMPARISONS[op](F.col(column), F.lit(value))


# --------------------------------------------------------------------- specs


def _product(columns) -> Column:
    if not 1 <= len(columns) <= 2:
        raise ValueError(f"a metric takes one column or a product of two, got {columns}")
    return functools.reduce(operator.mul, [F.col(c) for c in columns])


def _only(value: Column, where: Column | None) -> Column:
    return value if where is None else F.when(where, value)


class Simple:
    """A spec that is a single aggregate Column."""

    def column(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True, init=False, eq=False)
class Sum(Simple):
    """``sum(a)`` or ``sum(a * b)``; 0.0 over no rows."""

    columns: tuple
    where: Column | None

    def __init__(self, *columns: str, where: Column | None = None):
        object.__setattr__(self, "columns", columns)
        object.__setattr__(self, "where", where)

    def column(self) -> Column:
        total = F.sum(_only(_product(self.columns), self.where))
        return F.coalesce(total.cast("double"), F.lit(0.0))


@dataclass(frozen=True, init=False, eq=False)
class Avg(Simple):
    """``avg(a)`` or ``avg(a * b)``; null over no rows."""

    columns: tuple
    where: Column | None

    def __init__(self, *columns: str, where: Column | None = None):
        object.__setattr__(self, "columns", columns)
        object.__setattr__(self, "where", where)

    def column(self) -> Column:
        # The exact sum over the count keeps decimals exact up to the one division.
        value = _only(_product(self.columns), self.where)
        return F.try_divide(F.sum(value).cast("double"), F.count(value))


@dataclass(frozen=True, eq=False)
class Count(Simple):
    """Non-null count; with a condition the reference semantics is a distinct count."""

    name: str
    where: Column | None = None

    def column(self) -> Column:
        if self.where is not None:
            return CountDistinct(self.name, self.where).column()
        return F.count(self.name).cast("double")


@dataclass(frozen=True, eq=False)
class CountDistinct(Simple):
    name: str
    where: Column | None = None

    def column(self) -> Column:
        return F.count_distinct(_only(F.col(self.name), self.where)).cast("double")


@dataclass(frozen=True, eq=False)
class Min(Simple):
    name: str

    def column(self) -> Column:
        return F.min(self.name).cast("double")


@dataclass(frozen=True, eq=False)
class Max(Simple):
    name: str

    def column(self) -> Column:
        return F.max(self.name).cast("double")


@dataclass(frozen=True, eq=False)
class EntitiesOver:
    """How many entities have more than ``threshold`` distinct ``counted`` values."""

    entity: str
    counted: str
    threshold: int

    def frame(self, df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return (
            df.where(F.col(self.entity).isNotNull())
            .groupBy(*keys, self.entity)
            .agg(F.count_distinct(self.counted).alias("_n"))
            .groupBy(*keys)
            .agg(F.count_if(F.col("_n") > self.threshold).cast("double").alias(name))
        )


@dataclass(frozen=True, eq=False)
class FirstSeen:
    """How many entities have their first row inside the period.

    Without bounds the period is the range of the rows themselves, so every dated
    entity counts; ``start``/``end`` give a true first-seen count over a history.
    """

    entity: str
    ts: str
    start: object = None
    end: object = None

    def frame(self, df: DataFrame, keys: list[str], name: str) -> DataFrame:
        first = (
            df.where(F.col(self.entity).isNotNull())
            .groupBy(*keys, self.entity)
            .agg(F.min(self.ts).alias("_first"))
        )
        inside = F.col("_first").isNotNull()
        if self.start is not None:
            inside &= F.col("_first") >= F.lit(self.start).cast("timestamp_ntz")
        if self.end is not None:
            inside &= F.col("_first") <= F.lit(self.end).cast("timestamp_ntz")
        return first.groupBy(*keys).agg(F.count_if(inside).cast("double").alias(name))


@dataclass(frozen=True, eq=False)
class TopNSum:
    """Revenue of the ``n`` values of ``by`` with the most revenue.

    The rank filter becomes a group limit before the exchange, so each task ships at
    most ``n`` rows per window.
    """

    by: str
    n: int

    def frame(self, df: DataFrame, keys: list[str], name: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("_v"), F.asc(self.by))
        return (
            df.where(F.col(self.by).isNotNull())
            .groupBy(*keys, self.by)
            .agg(F.sum(F.col("Quantity") * F.col("UnitPrice")).alias("_v"))
            .withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= self.n)
            .groupBy(*keys)
            .agg(F.sum("_v").cast("double").alias(name))
        )


@dataclass(frozen=True, eq=False)
class KpiRef:
    """The value of another KPI declared in the same catalogue."""

    name: str


@dataclass(frozen=True, eq=False)
class Literal:
    value: float


@dataclass(frozen=True, eq=False)
class Ratio:
    """``num / den``, 0.0 when the denominator is zero. A bare column name means its sum."""

    num: object
    den: object

    def parts(self):
        return [Sum(p) if isinstance(p, str) else p for p in (self.num, self.den)]


def guarded_ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num, den))


# ------------------------------------------------------------------ evaluation


def _needed(specs: dict, name: str, seen: tuple = ()) -> list[str]:
    """``name`` after every KPI it refers to."""
    if name not in specs:
        raise KeyError(f"no KPI named {name}")
    if name in seen:
        raise ValueError(f"KPI {name} refers to itself")
    spec, before = specs[name], []
    if isinstance(spec, Ratio):
        for part in spec.parts():
            if isinstance(part, KpiRef):
                before += _needed(specs, part.name, (*seen, name))
    return list(dict.fromkeys([*before, name]))


def evaluate(df: DataFrame, specs: dict, keys: list[str] = (), only: list[str] | None = None) -> DataFrame:
    """Evaluate any set of specs: one row per key combination, one double per spec.

    All simple specs share one aggregate. Each two-level spec adds a sub-aggregate, which
    meets the others in a union followed by a grouping on the keys, so no join is needed.
    """
    keys = list(keys)
    wanted = list(only or specs)
    order = list(dict.fromkeys(n for w in wanted for n in _needed(specs, w)))

    leaves: dict[str, object] = {}
    for name in order:
        spec = specs[name]
        if isinstance(spec, Ratio):
            for side, part in zip(("num", "den"), spec.parts()):
                if not isinstance(part, (KpiRef, Literal)):
                    leaves[f"_{name}_{side}"] = part
        elif not isinstance(spec, Literal):
            leaves[name] = spec

    simple = {n: s.column() for n, s in leaves.items() if isinstance(s, Simple)}
    frames = []
    if simple:
        frames.append(df.groupBy(*keys).agg(*[c.alias(n) for n, c in simple.items()]))
    elif leaves:
        frames.append(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    frames += [s.frame(df, keys, n) for n, s in leaves.items() if not isinstance(s, Simple)]
    base = frames[0]
    if len(frames) > 1:
        for frame in frames[1:]:
            base = base.unionByName(frame, allowMissingColumns=True)
        base = base.groupBy(*keys).agg(*[F.max(n).alias(n) for n in leaves])
    # A week without any named customer has no row in the sub-aggregate: its count is 0.
    base = base.fillna(0.0, subset=[n for n, s in leaves.items() if not isinstance(s, Simple)])

    for name in order:
        spec = specs[name]
        if isinstance(spec, Ratio):
            sides = []
            for side, part in zip(("num", "den"), spec.parts()):
                if isinstance(part, KpiRef):
                    sides.append(F.col(part.name))
                elif isinstance(part, Literal):
                    sides.append(F.lit(float(part.value)))
                else:
                    sides.append(F.col(f"_{name}_{side}"))
            base = base.withColumn(name, guarded_ratio(*sides))
        elif isinstance(spec, Literal):
            base = base.withColumn(name, F.lit(float(spec.value)))
    return base.select(*keys, *wanted)
