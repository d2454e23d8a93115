"""Column expressions on scores, labels and proportions.

All of them are built-in Spark expressions, so they stay inside code generation and are pushed
or pruned by the optimizer as usual.  Undefined rates are NULL.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: factor from a log-likelihood gap to decibel, 10 / ln 10.
DB_FACTOR = 10.0 / math.log(10.0)
# Fixed value: decimals that collapse floating-point noise of stored gaps.
NOISE_DECIMALS = 9
# Clipping range of prior probabilities.
PRIOR_MIN = 1e-14
PRIOR_MAX = 1.0 - 1e-14


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(score: str | Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    c = col(score).cast("double")
    return F.coalesce((~F.isnan(c)) & (F.abs(c) < F.lit(math.inf)), F.lit(False))


def known(score: str | Column) -> Column:
    """True for a number that is neither NULL nor NaN (infinities are kept)."""
    c = col(score).cast("double")
    return c.isNotNull() & ~F.isnan(c)


def flag(c: str | Column) -> Column:
    """Label as 0/1 long, NULL counted as 0."""
    return F.coalesce(col(c).cast("boolean").cast("long"), F.lit(0).cast("long"))


def accept(c: str | Column, is_boolean: bool) -> Column:
    """Accept decision of a boolean column, or of a number above one half."""
    return col(c) if is_boolean else col(c) > 0.5


def signed(score: str | Column, error: str | Column) -> Column:
    """Score with its sign flipped where the trial is an error."""
    return F.when(col(error), -col(score)).otherwise(col(score))


def to_db(score: str | Column) -> Column:
    return col(score) * F.lit(DB_FACTOR)


def half_even(score: str | Column, digits: int | None) -> Column:
    """Round as NumPy does: scale, round half to even, scale back; no rounding if ``digits`` is None.

    The rule works on the binary number, so 0.575 becomes 0.57.  NaN, infinities and numbers too
    large to scale stay as they are.
    """
    c = col(score)
    if digits is None:
        return c
    scale = F.lit(10.0**digits)
    scaled = c.cast("double") * scale
    return F.when(finite(c) & finite(scaled), F.rint(scaled) / scale).otherwise(c.cast("double"))


def half_away(score: str | Column, digits: int | None) -> Column:
    """Scale, round half away from zero, scale back: the rule of the value frequencies."""
    c = col(score)
    if digits is None:
        return c
    scale = F.lit(10.0**digits)
    scaled = c.cast("double") * scale
    return F.when(finite(c) & finite(scaled), F.round(scaled) / scale).otherwise(c.cast("double"))


def denoise(score: str | Column, digits: int | None = None) -> Column:
    """Collapse floating-point noise, then round to ``digits`` when given."""
    return half_even(half_even(score, NOISE_DECIMALS), digits)


def width_floor(score: str | Column, width: float | int) -> Column:
    """Lower edge of the fixed-width bin a value falls into."""
    if width <= 0:
        raise ValueError("width must be positive")
    return F.floor(col(score) / F.lit(float(width))) * F.lit(float(width))


def ratio(k: str | Column, n: str | Column) -> Column:
    """k / n as double, NULL when n is zero."""
    return F.try_divide(col(k).cast("double"), col(n).cast("double"))


def z_value(alpha: float) -> float:
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie strictly between 0 and 1")
    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def _wilson(k: str | Column, n: str | Column, alpha: float, sign: int) -> Column:
    z = F.lit(z_value(alpha))
    z2 = z * z
    n_ = col(n).cast("double")
    p = F.try_divide(col(k).cast("double"), n_)
    centre = p + F.try_divide(z2, n_ * 2.0)
    half = z * F.sqrt(F.try_divide(p * (1.0 - p), n_) + F.try_divide(z2, n_ * n_ * 4.0))
    denominator = F.try_divide(z2, n_) + 1.0
    return F.try_divide(centre + half if sign > 0 else centre - half, denominator)


def wilson_low(k: str | Column, n: str | Column, alpha: float = 0.05) -> Column:
    """Lower bound of the Wilson score interval of k successes in n trials (NULL for n = 0)."""
    return _wilson(k, n, alpha, -1)


def wilson_high(k: str | Column, n: str | Column, alpha: float = 0.05) -> Column:
    """Upper bound of the Wilson score interval of k successes in n trials (NULL for n = 0)."""
    return _wilson(k, n, alpha, +1)


def pair_relation(a: str | Column, b: str | Column, tol: float = 1e-9) -> Column:
    """Relation of ``b`` to the exact value ``a``: exact / overestimate / underestimate."""
    a_, b_ = col(a), col(b)
    return (
        F.when(F.abs(b_ - a_) <= F.lit(tol), F.lit("exact"))
        .when(b_ > a_ + F.lit(tol), F.lit("overestimate"))
        .otherwise(F.lit("underestimate"))
    )


def same_within(a: str | Column, b: str | Column, tol: float = 1e-9) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(tol)


def override_flag(score: str | Column, threshold: float = 0.0, inclusive: bool = True) -> Column:
    """Override event of a linearised score: at or below (or strictly below) a threshold."""
    c = col(score)
    below = c <= F.lit(float(threshold)) if inclusive else c < F.lit(float(threshold))
    return F.coalesce(below & ~F.isnan(c), F.lit(False))


def override_second(
    score: str | Column, error: str | Column, alt_error: str | Column, threshold: float
) -> tuple[Column, Column]:
    """Score and label after adopting the alternative decision strictly below ``threshold``."""
    if threshold >= 0:
        raise ValueError("threshold must be negative")
    s = col(score)
    below = (s < F.lit(float(threshold))) & ~F.isnan(s)
    return (
        F.when(below, -s).otherwise(s),
        F.when(below, col(alt_error)).otherwise(col(error)),
    )


def clip_prior(p: str | Column) -> Column:
    return F.greatest(F.least(col(p), F.lit(PRIOR_MAX)), F.lit(PRIOR_MIN))


def prior_weight(p: str | Column) -> Column:
    """Log-likelihood ratio ln((1-p)/p) of a clipped prior."""
    c = clip_prior(p)
    return F.log((F.lit(1.0) - c) / c)


def outcome(y0: str | Column, y_star: str | Column) -> Column:
    """Transition category of a trial whose decision was changed."""
    before, after = col(y0), col(y_star)
    return (
        F.when(before & ~after, F.lit("fixed"))
        .when(~before & after, F.lit("broken"))
        .when(before & after, F.lit("both_wrong"))
        .otherwise(F.lit("both_correct"))
    )


def sign_group(score: str | Column) -> Column:
    """``pos`` for values above zero, ``neg`` for the rest."""
    return F.when(col(score) > 0, F.lit("pos")).otherwise(F.lit("neg"))


def symmetric_difference(a: str | Column, b: str | Column) -> Column:
    """Set XOR of two id arrays, sorted."""
    a_, b_ = col(a), col(b)
    return F.array_sort(F.array_union(F.array_except(a_, b_), F.array_except(b_, a_)))


def xor_of_components(components: str | Column) -> Column:
    """Ids occurring in an odd number of component arrays, sorted."""
    sets = F.transform(col(components), F.array_distinct)
    flat = F.flatten(sets)
    return F.array_sort(
        F.filter(
            F.array_distinct(flat),
            lambda d: F.size(F.filter(flat, lambda e: e == d)) % 2 == 1,
        )
    )


def label_of(code: str | Column, labels: dict) -> Column:
    """Text of a code, NULL for an unknown one."""
    entries = [F.lit(part) for pair in labels.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), col(code))
