"""Exact quantiles of a column of any size by counting passes, without sorting it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank error of a sketch, the steps of its grid, and distinct values that are listed at last.
_ACCURACY, _STEPS, _HELD = 10_000, 1000, 20_000


def _grid(value):
    return F.percentile_approx(value, [i / _STEPS for i in range(_STEPS + 1)], _ACCURACY)


def _narrower(grid: list[float], share: float) -> tuple[float, float]:
    """The part of a grid of quantiles that holds a share, its rank error and a step to either side included."""
    slack = 2 / _ACCURACY + 1 / _STEPS
    low, high = math.floor((share - slack) * _STEPS), math.ceil((share + slack) * _STEPS)
    return grid[max(0, low)], grid[min(_STEPS, high)]


def quantiles(df: DataFrame, column: str, shares: list[float]) -> tuple[list[float | None], int]:
    """Linearly interpolated quantiles of the non-null values, and their number.

    A first pass sketches the column, and the sketch gives each rank a bracket. Every pass after
    it counts exactly what lies under and in each bracket and sketches the inside, so a
    bracket shrinks some hundredfold; when few values are left they are counted one by one.
    Each pass is one aggregate without a shuffle of rows, whatever the values are, and the
    counts show if a sketch erred. NaN is greater than all numbers. None without values.
    """
    v = F.col(column).cast("double")
    number = F.when(~F.isnan(v), v)
    first = df.agg(F.count(v).alias("n"), F.count(number).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high"), _grid(number).alias("grid")).first()
    n, numbers = first["n"], first["numbers"]
    if not n:
        return [None] * len(shares), 0
    ranks = sorted({r for s in shares for r in (math.floor((n - 1) * s), math.ceil((n - 1) * s))})
    found = {r: math.nan for r in ranks if r >= numbers}
    # per rank: the bracket, and the values under it
    open_ = {r: _narrower(first["grid"], r / max(1, numbers - 1)) for r in ranks if r < numbers}
    while open_:
        brackets = sorted(set(open_.values()))
        inside = [(number >= low) & (number <= high) for low, high in brackets]
        counts = [F.count_if(number < low).alias(f"below{i}") for i, (low, _) in enumerate(brackets)]
        counts += [F.count_if(x).alias(f"inside{i}") for i, x in enumerate(inside)]
        grids = [_grid(F.when(x, number)).alias(f"grid{i}") for i, x in enumerate(inside)]
        told = df.agg(*counts, *grids).first()
        few = {}
        for r, bracket in list(open_.items()):
            i = brackets.index(bracket)
            low, high = bracket
            at, size = r - told[f"below{i}"], told[f"inside{i}"]
            if not 0 <= at < size:
                # the sketch erred, which its bounds rule out but for their probability
                open_[r] = (first["low"], high) if at < 0 else (low, first["high"])
            elif low == high:
                found[r] = low
                del open_[r]
            elif size <= _HELD:
                few[r] = (bracket, at)
                del open_[r]
            else:
                narrow = _narrower(told[f"grid{i}"], at / max(1, size - 1))
                if narrow == bracket:
                    half = (low + high) / 2
                    under = df.where((number >= low) & (number <= half)).count()
                    narrow = (low, half) if at < under else (math.nextafter(half, math.inf), high)
                open_[r] = narrow
        if few:
            wanted = F.lit(False)
            for low, high in {b for b, _ in few.values()}:
                wanted = wanted | number.between(low, high)
            listed = sorted((r["v"], r["n"]) for r in df.where(wanted).groupBy(number.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect())
            for r, ((low, high), at) in few.items():
                for value, m in listed:
                    if low <= value <= high:
                        if at < m:
                            found[r] = value
                            break
                        at -= m
    made = []
    for s in shares:
        position = (n - 1) * s
        low, high = found[math.floor(position)], found[math.ceil(position)]
        made.append(low if low == high else low + (high - low) * (position - math.floor(position)))
    return made, n
