"""Two-sided p-values of rank correlations, for result tables of one row per pair of scores."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        d = 1.0 + even * d
        c = 1.0 + even / c
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        d = 1.0 + odd * d
        c = 1.0 + odd / c
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def spearman_tail(r: float, n: float) -> float | None:
    """P-value of a rank correlation from Student's t with n - 2 degrees of freedom."""
    if r is None or math.isnan(r) or n < 3:
        return None
    left = (1.0 - r) * (1.0 + r)
    if left <= 0.0:
        return 0.0
    return student_two_sided(r * math.sqrt((n - 2.0) / left), n - 2.0)


def _inversion_tail(n: int, few: int) -> float:
    """Two-sided exact p-value: share of permutations with at most ``few`` inversions, doubled."""
    counts = [1]
    for k in range(2, n + 1):
        grown = [0] * (few + 1)
        for i in range(few + 1):
            grown[i] = sum(counts[i - j] for j in range(min(k, i + 1)) if i - j < len(counts))
        counts = grown
    return min(1.0, 2.0 * sum(counts[: few + 1]) / math.factorial(n))


def kendall_tail(n, excess, x2, x3, x5, y2, y3, y5) -> float | None:
    """P-value of tau-b: exact for small untied samples, else normal with tie corrections."""
    n, excess = int(n), int(excess)
    pairs = n * (n - 1) // 2
    if n < 2 or x2 >= 2 * pairs or y2 >= 2 * pairs:
        return None
    if x2 == 0 and y2 == 0:
        discordant = (pairs - excess) // 2
        few = min(discordant, pairs - discordant)
        if n <= 33 or few <= 1:
            if 4 * few == 2 * pairs:
                return 1.0
            if n <= 171:
                return _inversion_tail(n, few)
            return 0.0
    m = float(n) * (n - 1.0)
    variance = (m * (2.0 * n + 5.0) - x5 - y5) / 18.0 + (x2 * y2) / (2.0 * m)
    if n > 2:
        variance += x3 * y3 / (9.0 * m * (n - 2.0))
    if variance <= 0:
        return None
    return math.erfc(abs(excess) / math.sqrt(variance) / math.sqrt(2.0))


def _rowwise(function: Callable):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(v[0]) else function(*v) for v in zip(*columns)], dtype="float64"
        )

    return run


def spearman_p(r: str, n: str):
    """Column of p-values for rank correlations."""

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return _rowwise(spearman_tail)(r, n)

    return p_value(F.col(r), F.col(n).cast("double"))


def kendall_p(n: str, excess: str, *ties: str):
    """Column of p-values for tau-b from the excess of concordant pairs and the tie sums."""

    @F.pandas_udf("double")
    def p_value(
        n: pd.Series, e: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series,
        d: pd.Series, f: pd.Series, g: pd.Series,
    ) -> pd.Series:
        return _rowwise(kendall_tail)(n, e, a, b, c, d, f, g)

    return p_value(*[F.col(x).cast("double") for x in (n, excess, *ties)])
