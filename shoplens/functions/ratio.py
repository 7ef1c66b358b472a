"""Percentages and means, rounded to two places in whole numbers.

Counts are integers, so each ratio is rounded by integer division and divided by 100 once at
the end. No binary rounding error can move a value across a tie, and any engine that repeats
the integer steps returns the same double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_div(n: Column, d: Column) -> Column:
    """Integer quotient; 0 when the divisor is 0."""
    return F.coalesce(F.call_function("div", n, F.nullif(d, F.lit(0))), F.lit(0).cast("bigint"))


def cents(amount: Column) -> Column:
    """A two-place decimal amount as a whole number of cents."""
    return (amount * 100).cast("bigint")


def _hundredths(value: Column) -> Column:
    return value.cast("double") / F.lit(100.0)


def percent(n: Column, d: Column) -> Column:
    """``100 n / d`` rounded half to even at two places, 0 for an empty denominator."""
    scaled = n.cast("bigint") * 10000
    d = d.cast("bigint")
    q = whole_div(scaled, d)
    twice_rest = (scaled - q * d) * 2
    up = (twice_rest > d) | ((twice_rest == d) & (q % 2 == 1))
    return F.when(d == 0, F.lit(0.0)).otherwise(_hundredths(q + up.cast("bigint")))


def percent_damped(n: Column, d: Column) -> Column:
    """``100 n / (d + 0.01)`` rounded at two places and capped at 100.

    With both sides times 100 the denominator is ``100 d + 1``: odd, so a tie cannot occur.
    """
    base = d.cast("bigint") * 100 + 1
    value = whole_div(n.cast("bigint") * 2000000 + base, base * 2)
    return F.least(F.lit(100.0), _hundredths(value))


def mean_damped(total: Column, n: Column) -> Column:
    """``total / (n + 0.01)`` rounded at two places, for a two-place decimal total."""
    base = n.cast("bigint") * 100 + 1
    return _hundredths(whole_div(cents(total) * 200 + base, base * 2))
