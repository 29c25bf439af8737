"""Rounding and printing of doubles the way printf does it.

Spark's ``round`` and ``format_string`` round the shortest decimal form half up, so 16.45
prints as 16.5 although the double lies below the tie. Here a value is rounded by what it
holds exactly, ties to even.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two exact halves


def half_even(value: Column, digits: int) -> Column:
    scale = 10.0**digits
    scaled = value * scale
    high = value * _SPLIT - (value * _SPLIT - value)
    # What the multiplication rounded away; it decides an apparent tie.
    lost = (high * scale - scaled) + (value - high) * scale
    below = F.floor(scaled).cast("double")
    nearest = (
        F.when(scaled - below != 0.5, F.rint(scaled))
        .when(lost > 0, below + 1)
        .when(lost < 0, below)
        .otherwise(F.rint(scaled))
    )
    return nearest / scale


def fixed(value: Column, digits: int, grouped: bool = False) -> Column:
    """The value with a fixed number of decimals, thousands separated if asked."""
    return F.format_string(f"%{',' if grouped else ''}.{digits}f", half_even(value, digits))
