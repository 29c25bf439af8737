"""Mann-Kendall and Theil-Sen statistics of one series.

A series has one point per window, so its length is bounded by the calendar, and one task holds
it. Rises, falls and the slopes under a bound are inversions of an order of the points, counted
in n log n; pairs are only listed once a narrow bracket holds the median slope.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The helpers below travel to the workers with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Slopes that are listed at once, and pairs drawn to place the bracket around the median.
_HELD, _DRAWN = 4_000_000, 1_000_000

STATISTICS = (
    "kpi_name string, n int, concordant bigint, discordant bigint, tied bigint, s bigint, "
    "var_s double, z double, p_value double, slope double, mean double, last_date date, last_value double"
)


def _inversion_levels(ranks: np.ndarray):
    """The inversions of a sequence, bit by bit: pairs that agree in the higher bits and come the wrong way round in this one.

    Each level gives the sequence's places in the order of the higher bits, which of them have
    the bit set, where each group of equal higher bits begins, and how many of its members
    ahead of a place have the bit set.
    """
    order = np.arange(len(ranks))
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        high = ranks[order] >> bit
        ones = (high & 1).astype(np.int64)
        group = high >> 1
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        first = np.repeat(begins, np.diff(np.append(begins, len(order))))
        upto = np.cumsum(ones) - ones
        yield order, ones, first, upto - upto[first]
        order = order[np.argsort(high, kind="stable")]


def inversions(ranks: np.ndarray) -> int:
    """Pairs of places whose numbers descend."""
    return sum(int(ahead[ones == 0].sum()) for _, ones, _, ahead in _inversion_levels(ranks))


def _inverted_pairs(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all inversions, the earlier and the later one."""
    earlier, later = [], []
    for order, ones, first, ahead in _inversion_levels(ranks):
        at = np.flatnonzero((ones == 0) & (ahead > 0))
        set_places = np.flatnonzero(ones)
        # of a group's places with the bit set, those ahead of a place without it are the first ones
        start = np.searchsorted(set_places, first[at])
        n = ahead[at]
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        earlier.append(order[set_places[np.repeat(start, n) + run]])
        later.append(order[np.repeat(at, n)])
    return (np.concatenate(earlier), np.concatenate(later)) if earlier else (np.empty(0, np.int64), np.empty(0, np.int64))


def _order_at(values: np.ndarray, bound: float) -> np.ndarray:
    """The points by ``value - bound * place``, equal ones last place first.

    A later point is ahead of an earlier one just if the slope between them is ``bound`` or less.
    """
    places = np.arange(len(values))
    return np.lexsort((-places, values - bound * places))


def _rank(order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _slopes(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (values[j] - values[i]) / (j - i)


def _around(values: np.ndarray, rank: int, drawn: np.ndarray) -> tuple[np.ndarray, int]:
    """Slopes around the one of a rank, ascending, and the rank of the first of them."""
    n = len(values)
    steps = np.diff(values)
    low, high = float(steps.min()), float(steps.max())  # every slope is a mean of steps
    below, upto, halve = 0, n * (n - 1) // 2, False
    while True:
        # what adding up rounds, for slopes between neighbours
        tolerance = 16 * np.finfo(float).eps * (np.abs(values).max() + max(abs(low), abs(high)) * n)
        inside = drawn[np.searchsorted(drawn, low) : np.searchsorted(drawn, high, side="right")]
        if upto - below <= _HELD or high - low <= 4 * tolerance:
            break
        middle = (rank - below) / (upto - below) * (len(inside) - 1)
        spread = 3 * np.sqrt(len(inside)) + 1
        guesses = [middle - spread, middle + spread]
        if halve or not 0 <= guesses[0] < guesses[1] <= len(inside) - 1:
            bounds = [(low + high) / 2]
        else:
            bounds = [float(inside[int(guesses[0])]) - tolerance, float(inside[math.ceil(guesses[1])]) + tolerance]
        before = upto - below
        for bound in bounds:
            if low < bound < high:
                order = _order_at(values, bound)
                under = inversions(_rank(order))
                if under <= rank:
                    low, below = bound, under
                else:
                    high, upto = bound, under
        # drawn pairs that tell no more, or told wrong, leave halving
        halve = upto - below > before / 2
    if upto - below > _HELD:
        # equal but for rounding
        return (inside if len(inside) else np.array([(low + high) / 2])), -1
    # a little to either side, so that rounding cannot push the rank out
    order = _order_at(values, low - tolerance)
    earlier, later = _inverted_pairs(_rank(_order_at(values, high + tolerance))[order])
    i, j = order[earlier], order[later]
    return np.sort(_slopes(values, i[i < j], j[i < j])), inversions(_rank(order))


def median_slope(values: np.ndarray) -> float:
    """Exact median of all pairwise slopes, in n log n.

    Slopes of drawn pairs give a bracket that should hold a middle rank; how many slopes lie
    under its bounds is counted by inversions. It narrows until its slopes can be listed and
    ranked. Where it cannot narrow further, its slopes are equal but for rounding, and the
    middle of those drawn is the median.
    """
    n = len(values)
    total = n * (n - 1) // 2
    ranks = [(total - 1) // 2, total // 2]
    if total <= _HELD:
        i, j = np.triu_indices(n, 1)
        return float(np.partition(_slopes(values, i, j), ranks)[ranks].mean())
    i, j = np.random.default_rng(n).integers(0, n, (2, _DRAWN))
    drawn = np.sort(_slopes(values, np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]))
    slopes, first = _around(values, ranks[0], drawn)
    picked = []
    for rank in ranks:
        if first >= 0 and rank - first >= len(slopes):
            slopes, first = _around(values, rank, drawn)
        picked.append(float(np.median(slopes)) if first < 0 else float(slopes[rank - first]))
    return float(np.mean(picked))


def series_statistics(values: np.ndarray) -> dict:
    n = len(values)
    _, rank, ties = np.unique(values, return_inverse=True, return_counts=True)
    down, up = inversions(rank), inversions(len(ties) - 1 - rank)
    s = up - down
    ties = ties.astype(float)
    var_s = (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18
    z = (s - np.sign(s)) / math.sqrt(var_s) if var_s > 0 else None
    return {
        "n": n,
        "concordant": up,
        "discordant": down,
        "tied": n * (n - 1) // 2 - up - down,
        "s": s,
        "var_s": var_s,
        "z": z,
        "p_value": math.erfc(abs(z) / math.sqrt(2)) if z is not None else None,
        "slope": median_slope(values) if n > 1 else None,
    }


def _one_series(group: pd.DataFrame) -> pd.DataFrame:
    ordered = group.sort_values("date")
    values = ordered["value"].to_numpy(dtype=float)
    row = {
        "kpi_name": ordered["kpi_name"].iloc[0],
        **series_statistics(values),
        "mean": float(values.mean()),
        "last_date": ordered["date"].iloc[-1],
        "last_value": float(values[-1]),
    }
    return pd.DataFrame([row])


def trend_statistics(series: DataFrame) -> DataFrame:
    """One row of trend statistics per KPI of a long series ``(kpi_name, date, value)``."""
    return (
        series.where("value is not null")
        .select("kpi_name", "date", "value")
        .groupBy("kpi_name")
        .applyInPandas(_one_series, STATISTICS)
    )
