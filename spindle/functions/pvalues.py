"""Tail probabilities of the test statistics.

The statistics come out of distributed aggregations as a handful of numbers;
only those numbers reach the functions below, in Arrow batches.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors get these functions by value and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
_STEPS = 500
_TOLERANCE = 1e-15
_LARGE = 1e6  # degrees of freedom from which the expansion below is exact to twelve digits


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b) by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )

    def terms():
        yield 1.0
        for m in range(1, _STEPS):
            yield -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    return front / a * _continued_fraction(terms())


def _continued_fraction(terms) -> float:
    """1 / (1 + t1 / (1 + t2 / ...)) from numerators [1, t1, t2, ...]."""
    next(terms)
    c, d, value = 1.0, 0.0, 1.0
    for t in terms:
        d = 1.0 / (1.0 + t * d or _TINY)
        c = 1.0 + t / c or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _TOLERANCE:
            break
    return 1.0 / value


def upper_gamma(a: float, x: float) -> float:
    """Regularised Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(max(-745.0, a * math.log(x) - x - math.lgamma(a)))
    if x < a + 1.0:
        total = term = 1.0 / a
        k = a
        while abs(term) > abs(total) * _TOLERANCE:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for i in range(1, _STEPS):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / (step * d + b or _TINY)
        c = b + step / c or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _TOLERANCE:
            break
    return value * scale if scale > 1e-320 else 0.0


def student_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    if df >= _LARGE:  # the continued fraction would lose digits there
        return upper_gamma(0.5, -(df / 2.0 - 0.25) * math.log1p(-t * t / (df + t * t)))
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def correlation_two_sided(r: float, n: float) -> float | None:
    """Significance of a Pearson r (or of a regression slope) over n points."""
    if n < 3:
        return 1.0 if n == 2 else None
    r = max(-1.0, min(1.0, r))
    if abs(r) == 1.0:
        return 0.0
    return student_two_sided(r * math.sqrt((n - 2) / ((1.0 - r) * (1.0 + r))), n - 2)


def chi_square_upper(x: float, df: float) -> float:
    return upper_gamma(df / 2.0, x / 2.0)


def mann_whitney_two_sided(u1: float, n1: float, n2: float, ties: float) -> tuple[float, str]:
    """Two-sided p: the exact distribution when a sample has at most 8 values
    and nothing ties, else the tie-corrected normal approximation with a
    continuity correction."""
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and ties == 0:
        return min(1.0, 2.0 * _exact_u_upper(int(u), int(min(n1, n2)), int(max(n1, n2)))), "exact"
    n = n1 + n2
    spread = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1))))
    if spread == 0:
        return 1.0, "asymptotic"
    z = (u - n1 * n2 / 2.0 - 0.5) / spread
    return min(1.0, math.erfc(z / math.sqrt(2.0))), "asymptotic"


def _exact_u_upper(u: int, m: int, n: int) -> float:
    """P(U >= u) in whole numbers, for any n.

    U >= u leaves a sum of at most t = m n - u, so the arrangements are the
    partitions of numbers up to t into at most m parts of at most n. Their
    generating function is the product of 1 - q^(n + i) over that of 1 - q^i,
    for i from 1 to m, and over 1 - q. The numerator has 2^m terms; the rest has
    a closed form in each residue of the least common multiple of its periods.
    """
    t = m * n - u
    if t < 0:
        return 0.0
    periods = [1, *range(1, m + 1)]
    common, factors = math.lcm(*periods), len(periods)
    rest = [1]
    for period in periods:  # times 1 + q^period + ... + q^(common - period)
        longer = [0] * (len(rest) + common - period)
        for i in range(len(longer)):
            longer[i] = (
                (rest[i] if i < len(rest) else 0)
                + (longer[i - period] if i >= period else 0)
                - (rest[i - common] if 0 <= i - common < len(rest) else 0)
            )
        rest = longer

    def up_to(total: int) -> int:
        places = range(total % common, min(total, len(rest) - 1) + 1, common)
        return sum(rest[j] * math.comb((total - j) // common + factors - 1, factors - 1) for j in places)

    shifts = {0: 1}  # of the numerator: shift and sign
    for i in range(1, m + 1):
        for shift, sign in list(shifts.items()):
            shifts[shift + n + i] = shifts.get(shift + n + i, 0) - sign
    ways = sum(sign * up_to(t - shift) for shift, sign in shifts.items() if sign and shift <= t)
    return ways / math.comb(m + n, m)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return _rowwise(correlation_two_sided, r, n)


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi_square_upper, x, df)


_P_WITH_METHOD = T.StructType(
    [T.StructField("p_value", T.DoubleType()), T.StructField("method", T.StringType())]
)


@F.pandas_udf(_P_WITH_METHOD)
def mann_whitney_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.DataFrame:
    found = [
        (None, None) if any(pd.isna(v) for v in row) else mann_whitney_two_sided(*map(float, row))
        for row in zip(u1, n1, n2, ties)
    ]
    return pd.DataFrame(found, columns=["p_value", "method"])


def _rowwise(function, *columns: pd.Series) -> pd.Series:
    rows = zip(*columns)
    out = [None if any(pd.isna(v) for v in row) else function(*map(float, row)) for row in rows]
    return pd.Series(out, dtype="float64")
