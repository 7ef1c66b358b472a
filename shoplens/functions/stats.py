"""Statistics of a conversion experiment.

The chi-square itself is column arithmetic. Only its tail and the required sample size need
special functions that Spark lacks; those run as Arrow functions over one row per arm or per
experiment.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

# The Arrow functions travel with their helpers, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the test design.
EFFECT_SIZE = 0.1
ALPHA = 0.05
POWER = 0.8


def pooled_chi_square(c1: Column, n1: Column, c2: Column, n2: Column) -> Column:
    """Pearson chi-square of two conversion counts; null where it is undefined."""
    c1, n1, c2, n2 = (c.cast("double") for c in (c1, n1, c2, n2))
    pooled = F.try_divide(c1 + c2, n1 + n2)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    gap = F.try_divide(c1, n1) - F.try_divide(c2, n2)
    return F.try_divide(gap * gap, spread)


@F.pandas_udf(DoubleType())
def chi_square_confidence(x: pd.Series) -> pd.Series:
    """One minus the tail of a chi-square with one degree of freedom.

    More conversions than visitors can make the statistic negative, which carries no evidence.
    """
    return x.map(lambda v: math.erf(math.sqrt(max(v, 0.0) / 2.0)), na_action="ignore").astype("float64")


def _gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma, by its all-positive series."""
    if x <= 0.0:
        return 0.0
    term = math.exp(a * math.log(x) - x - math.lgamma(a + 1.0))
    total, k = term, a
    while term > total * 1e-17:
        k += 1.0
        term *= x / k
        total += term
    return min(total, 1.0)


def _noncentral_upper(x: float, df: int, shift: float) -> float:
    """Upper tail of a noncentral chi-square as a Poisson mixture of central ones."""
    half = shift / 2.0
    weight, cdf, j = math.exp(-half), 0.0, 0
    if not weight:
        raise ValueError(f"the noncentrality {shift} is too large for a sum from its first term")
    # Beyond the mean of the mixture the weights fall at least geometrically, so the sum ends.
    while j <= half or weight > 1e-17:
        cdf += weight * _gamma_lower(df / 2.0 + j, x / 2.0)
        j += 1
        weight *= half / j
    return 1.0 - cdf


def _bisect(fn, lo: float, hi: float) -> float:
    """Root of an increasing function, widening the upper end until it brackets."""
    while fn(hi) < 0:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if fn(mid) < 0 else (lo, mid)
    return (lo + hi) / 2.0


def sample_size_for_arms(arms: int) -> int:
    """Sessions needed by a goodness-of-fit test over ``arms`` cells, doubled and cut to int."""
    df = arms - 1
    critical = _bisect(lambda x: _gamma_lower(df / 2.0, x / 2.0) - (1.0 - ALPHA), 0.0, 10.0)
    shift = _bisect(lambda s: _noncentral_upper(critical, df, s) - POWER, 0.0, 20.0)
    return int(2.0 * shift / EFFECT_SIZE**2)


@F.pandas_udf(LongType())
def required_sample_size(arms: pd.Series) -> pd.Series:
    """Sessions an experiment with that many arms needs; null below two arms."""
    sizes = {k: sample_size_for_arms(int(k)) for k in arms.dropna().unique() if k >= 2}
    return arms.map(sizes).astype("Int64")
