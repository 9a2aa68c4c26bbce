"""Closed-form statistics as column expressions, and tails of distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """struct(low, high) of the Wilson interval; null for n = 0."""
    p = successes / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    clean = lambda x: F.when(F.abs(x) < 1e-12, 0.0).otherwise(x)
    return F.struct(F.round(F.greatest(F.lit(0.0), clean(mid - half)), 6).alias("low"), F.round(F.least(F.lit(1.0), clean(mid + half)), 6).alias("high"))


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def odds_ratio(a: Column, b: Column, c: Column, d: Column, z: float = Z95) -> Column:
    """struct(ratio, low, high) of a 2x2 table with one half added to each cell."""
    a, b, c, d = (x + 0.5 for x in (a, b, c, d))
    log, se = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.struct(F.exp(log).alias("ratio"), F.exp(log - z * se).alias("low"), F.exp(log + z * se).alias("high"))


def e_value(ratio: Column) -> Column:
    """Least strength of confounding that explains a risk ratio away."""
    r = F.when(ratio < 1, 1 / ratio).otherwise(ratio)
    return r + F.sqrt(r * (r - 1))


def smd_to_ratio(smd: Column) -> Column:
    return F.exp(0.91 * smd)


def normal_tail(x: float) -> float:
    """Upper tail of the standard normal distribution."""
    return 0.5 * math.erfc(x / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution by its series or continued fraction."""
    if x <= 0 or df <= 0:
        return 1.0
    a, x = df / 2, x / 2
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * lead
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h, i = d, 1
    while True:
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return lead * h
        i += 1


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d, m = 1.0, 1.0, 0.0, 0
    while True:
        half = m // 2
        step = 1.0 if m == 0 else half * (b - half) * x / ((a + m - 1) * (a + m)) if m % 2 == 0 else -(a + half) * (a + b + half) * x / ((a + m - 1) * (a + m))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if m and abs(1 - c * d) < 1e-14:
            return lead * (f - 1)
        m += 1


def binomial_upper(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial; the work grows with the root of ``n``."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_share(k, n - k + 1, p)


def sign_test(positive: int, negative: int) -> float:
    """Exact two-sided binomial probability at one half."""
    return min(1.0, 2 * binomial_upper(max(positive, negative), positive + negative, 0.5))


#: The grid of bias factors: 1 to 6 by 0.05.
GAMMAS = [round(1 + 0.05 * i, 2) for i in range(101)]


def rosenbaum(positive: int, negative: int, alpha: float = 0.05) -> float | None:
    """Least bias factor of GAMMAS at which the majority's sign test is no longer below ``alpha``.

    1 where both directions are even, the grid's end where the test survives it all,
    None under three differences other than zero. The tail grows with the factor, so the grid is bisected.
    """
    n, k = positive + negative, max(positive, negative)
    if n < 3:
        return None
    if positive == negative:
        return 1.0
    low, high = 0, len(GAMMAS) - 1
    while low < high:
        mid = (low + high) // 2
        if binomial_upper(k, n, GAMMAS[mid] / (1 + GAMMAS[mid])) >= alpha:
            high = mid
        else:
            low = mid + 1
    return GAMMAS[low]


def chi2_tail_even(x: Column, df: Column) -> Column:
    """Upper tail of the chi-squared distribution for an even number of degrees, in closed form; an odd number is an error."""
    half = F.greatest(x, F.lit(0.0)) / 2
    start = F.struct(F.exp(-half).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.struct((acc["term"] * half / i).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(df / 2, F.lit(1)).cast("int")), start, step, lambda acc: acc["sum"])
    return F.when(df % 2 != 0, F.raise_error(F.lit("an even number of degrees is needed")).cast("double")).when(df > 0, tail).otherwise(1.0)


def e_value_limit(low: Column, high: Column) -> Column:
    """E-value of the interval's end that is nearer to no effect; 1 where the interval holds none (standardised differences)."""
    near = F.when(low > 0, low).otherwise(high)
    return F.when((low <= 0) & (high >= 0), 1.0).otherwise(e_value(smd_to_ratio(near)))


def underpowered(participants: Column, sessions: Column, least_participants: int = 10, least_sessions: int = 4) -> Column:
    """Whether a group is too small for a trend."""
    return (participants < least_participants) | (sessions < least_sessions)
