"""Error rates and post-selection curves.

A curve row holds ``abort_rate``, ``post_ler`` with its Wilson interval ``ci_low``/``ci_high``,
``accepted``, ``errors``, and the overall ``n_total`` and ``original_ler``.  Undefined rates are
NULL.  Trials whose score is NaN are never accepted but stay in the denominator; trials whose score
or label is NULL are left out.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.functions.exprs import (
    col,
    flag,
    half_even,
    known,
    override_second,
    ratio,
    wilson_high,
    wilson_low,
)
from trialsift.functions.registry import check_direction, check_rates, whole_number
from trialsift.plans.ranges import (
    BUCKET,
    NestedSets,
    attach,
    cumulative,
    join_groups,
    order_statistics,
    sketch_bounds,
    summed,
    with_ranges,
)
from trialsift.session import settle


def error_rate(
    df: DataFrame, error: str, by: Sequence[str] = (), per_round: int | None = None
) -> DataFrame:
    """Errors, trials and error rate per group; the rate of no trials is 0."""
    rounds = whole_number(per_round, "per_round", 1)
    rate = F.coalesce(ratio("n_err", "n_total"), F.lit(0.0))
    return (
        df.groupBy(*by)
        .agg(F.coalesce(F.sum(flag(error)), F.lit(0)).alias("n_err"), F.count("*").alias("n_total"))
        .withColumn("ler", rate / F.lit(float(rounds)) if rounds else rate)
    )


def postselect_at(
    df: DataFrame,
    score: str,
    error: str,
    threshold: float,
    direction: str = "high",
    by: Sequence[str] = (),
    inclusive: bool = True,
    per_round: int | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """The operating point of one fixed threshold, in one aggregation."""
    check_direction(direction)
    rounds = whole_number(per_round, "per_round", 1)
    s, t = col(score).cast("double"), F.lit(float(threshold))
    if direction == "high":
        kept = (s >= t) if inclusive else (s > t)
    else:
        kept = (s <= t) if inclusive else (s < t)
    kept = (kept & known(score)).cast("long")
    rows = df.where(col(score).isNotNull() & col(error).isNotNull())
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.coalesce(F.sum(flag(error)), F.lit(0)).alias("err_total"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(kept * flag(error)), F.lit(0)).alias("errors"),
    )
    point = sums.select(*by, *_curve_columns("accepted", "errors", "n_total", "err_total", alpha))
    if rounds:
        for name in ("post_ler", "ci_low", "ci_high", "original_ler"):
            point = point.withColumn(name, F.col(name) / F.lit(float(rounds)))
    return point.withColumn("reduction_rate", ratio("post_ler", "original_ler"))


def zero_point(
    df: DataFrame, score: str, error: str, direction: str = "high", by: Sequence[str] = (),
    alpha: float = 0.05,
) -> DataFrame:
    """Operating point at score zero: strictly above for ``high``, at or below for ``low``.

    ``shown_ler`` is NULL where no error is left, since such a point is not displayed.
    """
    point = postselect_at(
        df, score, error, 0.0, direction, by, inclusive=direction != "high", alpha=alpha
    )
    return point.withColumn("shown_ler", F.when(F.col("errors") > 0, F.col("post_ler")))


def _curve_columns(accepted, errors, n_total, err_total, alpha: float) -> list[Column]:
    a, e, n = col(accepted), col(errors), col(n_total)
    return [
        (F.lit(1.0) - ratio(a, n)).alias("abort_rate"),
        ratio(e, a).alias("post_ler"),
        wilson_low(e, a, alpha).alias("ci_low"),
        wilson_high(e, a, alpha).alias("ci_high"),
        a.alias("accepted"),
        e.alias("errors"),
        n.alias("n_total"),
        ratio(col(err_total), n).alias("original_ler"),
    ]


def _scored(df: DataFrame, score: str, error: str, by: Sequence[str], digits: int | None):
    rows = df.where(col(score).isNotNull() & col(error).isNotNull())
    value = half_even(col(score).cast("double"), digits)
    return rows.select(*by, value.alias("threshold"), flag(error).alias("err"))


def postselect_unique(
    df: DataFrame,
    score: str,
    error: str,
    direction: str = "high",
    by: Sequence[str] = (),
    alpha: float = 0.05,
    digits: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One curve point per distinct score used as threshold."""
    check_direction(direction)
    rows = _scored(df, score, error, by, digits)
    table = cumulative(
        rows, "threshold", {"err": "err"}, by,
        descending=direction == "high", buckets=buckets, nan_last=True,
    ).where(F.col("threshold").isNotNull())
    return table.select(
        *by,
        "threshold",
        *_curve_columns(
            F.col("n_before") + F.col("n"),
            F.col("err_before") + F.col("err"),
            "n_total",
            "err_total",
            alpha,
        ),
    )


def abort_grid(num_points: int, scale: str = "linear") -> list[float]:
    """Target abort rates: evenly spaced from 0, or 0 followed by log-spaced rates."""
    if scale == "linear":
        return [i / num_points for i in range(num_points)]
    if scale != "log":
        raise ValueError(f"scale must be 'linear' or 'log', got {scale!r}")
    lo, hi, n = -3.0, math.log10(0.9999), num_points - 1
    return [0.0] + [10.0 ** (lo + (hi - lo) * i / max(n - 1, 1)) for i in range(n)]


def postselect_quantiles(
    df: DataFrame,
    score: str,
    error: str,
    direction: str = "high",
    by: Sequence[str] = (),
    num_points: int = 50,
    scale: str = "linear",
    alpha: float = 0.05,
    digits: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Curve over a grid of target abort rates; all ties at a threshold are kept.

    Its cost does not depend on the number of grid points: the thresholds are exact order
    statistics, and the counts on both sides of each come with them.
    """
    check_direction(direction)
    grid = abort_grid(num_points, scale)
    rows = _scored(df, score, error, by, digits)
    probabilities = grid if direction == "high" else [1.0 - r for r in grid]
    ordered = known("threshold").cast("long")
    sums = {"err": "err", "ok": ordered, "ok_err": ordered * F.col("err")}
    table = order_statistics(
        rows, "threshold", probabilities, sums, by, buckets=buckets, nan_last=True
    )
    if direction == "high":
        accepted = F.col("ok_total") - F.col("n_below")
        errors = F.col("ok_err_total") - F.col("err_below")
    else:
        accepted, errors = F.col("n_upto"), F.col("err_upto")
    return table.select(
        *by,
        "slot",
        F.element_at(F.array(*[F.lit(r) for r in grid]), F.col("slot") + 1).alias("target"),
        F.col("value").alias("threshold"),
        *_curve_columns(accepted, errors, "n_total", "err_total", alpha),
    )


def postselect_sweep(
    df: DataFrame,
    accept: str,
    error: str,
    param: str,
    by: Sequence[str] = (),
    alpha: float = 0.05,
) -> DataFrame:
    """One curve point per value of a sweep parameter, for a boolean accept flag."""
    kept = flag(accept)
    sums = df.groupBy(*by, param).agg(
        F.count("*").alias("n_total"),
        F.sum(flag(error)).alias("err_total"),
        F.sum(kept).alias("accepted"),
        F.sum(kept * flag(error)).alias("errors"),
    )
    return sums.select(
        *by, param, *_curve_columns("accepted", "errors", "n_total", "err_total", alpha)
    )


def postselect_separate(
    df: DataFrame,
    score: str,
    error: str,
    stat: str,
    direction: str = "high",
    mode: str = "continuous",
    by: Sequence[str] = (),
    num_points: int = 50,
    scale: str = "linear",
    alpha: float = 0.05,
    digits: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Curve that always aborts trials with a NaN ``stat`` (not converged) first.

    Abort rates refer to all trials.  ``baseline_ler`` is the rate at the least score kept among
    the converged ones, NULL when every trial converged.
    """
    if mode not in ("continuous", "unique"):
        raise ValueError("mode must be 'continuous' or 'unique'")
    lost = F.isnan(col(stat).cast("double"))
    rows = df.where(col(score).isNotNull() & col(error).isNotNull()).select(
        *by,
        F.when(~lost, col(score).cast("double")).otherwise(F.lit(math.nan)).alias("score"),
        col(error).alias("error"),
        F.coalesce(lost, F.lit(False)).alias("lost"),
    )
    rows, _ = settle(rows, buckets)
    if mode == "unique":
        curve = postselect_unique(
            rows, "score", "error", direction, by, alpha, digits, buckets
        )
    else:
        curve = postselect_quantiles(
            rows, "score", "error", direction, by, num_points, scale, alpha, digits, buckets
        )
    value = half_even(F.col("score"), digits)
    least = (
        rows.where(known("score"))
        .groupBy(*by, value.alias("__v"))
        .agg(F.count("*").alias("__n"), F.sum(flag("error")).alias("__k"))
        .groupBy(*by)
        .agg(
            F.sum("__n").alias("__n"),
            F.sum("__k").alias("__k"),
            F.min(F.struct("__v", "__n", "__k")).alias("__first"),
        )
    )
    base = ratio("__k", "__n") if direction == "high" else ratio("__first.__k", "__first.__n")
    lost_any = rows.groupBy(*by).agg(F.max("lost").alias("__lost"))
    least = attach(least.select(*by, base.alias("__base")), lost_any, by)
    least = least.select(*by, F.when(F.col("__lost"), F.col("__base")).alias("baseline_ler"))
    return attach(curve, least, by)


def with_reduction(curve: DataFrame, hide_zero: bool = True) -> DataFrame:
    """Divide rates by the original rate; NULL where no error is left if ``hide_zero``."""
    shown = F.col("errors") > 0 if hide_zero else F.lit(True)
    out = curve
    for name in ("post_ler", "ci_low", "ci_high"):
        relative = F.when(F.col("original_ler") > 0, F.col(name) / F.col("original_ler"))
        out = out.withColumn(f"{name}_reduction", F.when(shown, relative))
    return out


def read_at(curve: DataFrame, targets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The curve point nearest to each target abort rate (the lower one on a tie)."""
    point = F.struct("abort_rate", "post_ler", "ci_low", "ci_high", "accepted", "errors")
    nearest = [
        F.struct(
            F.lit(float(t)).alias("target"),
            F.min_by(
                point, F.struct(F.abs(F.col("abort_rate") - F.lit(float(t))), F.col("abort_rate"))
            ).alias("p"),
        )
        for t in targets
    ]
    found = curve.groupBy(*by).agg(F.array(*nearest).alias("points"))
    return found.select(*by, F.explode("points").alias("x")).select(*by, "x.target", "x.p.*")


def interpolate(
    points: DataFrame,
    at: DataFrame,
    x: str,
    ys: Sequence[str],
    at_x: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Linear interpolation of ``ys`` over ``x`` at ``at[at_x]``, clamped at both ends.

    Points and rows are laid on one axis and cut into value ranges; inside a range a window carries the
    last and the next point to every row, and at its ends they come from a table of one row per
    range.  So a curve may have any number of points.
    """
    by, row = list(by), [c for c in at.columns if c not in by]
    point = F.struct(F.col(x).cast("double").alias("x"), *[F.col(y).alias(f"y{i}") for i, y in enumerate(ys)])
    curve = points.where(F.col(x).isNotNull()).select(
        *by, F.col(x).cast("double").alias("__x"), F.lit(0).alias("__side"), point.alias("__point")
    )
    asked = at.select(
        *by, F.col(at_x).cast("double").alias("__x"), F.lit(1).alias("__side"), F.struct(*row).alias("__row")
    )
    axis, buckets = settle(curve.unionByName(asked, allowMissingColumns=True))
    bounds = sketch_bounds(axis, {"x": "__x"}, buckets)["x"]
    axis = with_ranges(axis, {BUCKET: ("__x", bounds)})
    axis = axis.withColumn(BUCKET, F.when(F.col("__x").isNull(), -1).otherwise(F.coalesce(BUCKET, F.lit(0))))
    group = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(BUCKET)
    ends = axis.groupBy(*by, BUCKET).agg(F.min("__point").alias("lo"), F.max("__point").alias("hi"))
    ends = ends.select(
        *by,
        BUCKET,
        F.last("hi", True).over(group.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("lo", True).over(group.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    # A point at the place of a row comes before the row.
    inside = Window.partitionBy(*by, BUCKET).orderBy("__x", "__side")
    local = axis.select(
        "*",
        F.last("__point", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("__last"),
        F.first("__point", True).over(inside.rowsBetween(1, Window.unboundedFollowing)).alias("__next"),
    ).where(F.col("__side") == 1)
    joined = join_groups(local, ends if by else F.broadcast(ends), [*by, BUCKET])
    joined = joined.select(
        *by,
        *[F.col("__row")[c].alias(c) for c in row],
        F.col("__x"),
        F.coalesce("__last", "__before").alias("__a"),
        F.coalesce("__next", "__after").alias("__b"),
    ).where(F.col("__a").isNotNull() | F.col("__b").isNotNull())
    a, b, here = F.col("__a"), F.col("__b"), F.col("__x")
    values = []
    for i, y in enumerate(ys):
        slope = F.try_divide(b[f"y{i}"] - a[f"y{i}"], b["x"] - a["x"])
        between = slope * (here - a["x"]) + a[f"y{i}"]
        value = F.when(a.isNull(), b[f"y{i}"]).when(b.isNull() | (a["x"] == here), a[f"y{i}"])
        values.append(value.otherwise(between).alias(f"{y}_at"))
    return joined.select(*at.columns, *values)


def relative_improvement(
    base: DataFrame, other: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """log10 of (relative rate of the base curve / relative rate of the other curve).

    Both inputs are curves.  The base curve is one curve for all groups of ``other`` and is
    interpolated at the other curve's abort rates.  The bounds are conservative: each pairs the
    low end of one interval with the high end of the other.
    """
    rho = {"rho": "post_ler", "rho_low": "ci_low", "rho_high": "ci_high"}

    def relative(curve: DataFrame, suffix: str, keys: Sequence[str]) -> DataFrame:
        usable = curve.where((F.col("original_ler") > 0) & F.col("post_ler").isNotNull())
        return usable.select(
            *keys,
            "abort_rate",
            *[(F.col(c) / F.col("original_ler")).alias(f"{n}{suffix}") for n, c in rho.items()],
        )

    b = relative(base, "_base", [])
    m = relative(other, "", by)
    joined = interpolate(b, m, "abort_rate", [f"{n}_base" for n in rho], "abort_rate")

    def log_ratio(numerator: str, denominator: str) -> Column:
        q = F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator))
        return F.when(q > 0, F.log10(q))

    return joined.select(
        *by,
        "abort_rate",
        log_ratio("rho_base_at", "rho").alias("log_eta"),
        log_ratio("rho_low_base_at", "rho_high").alias("log_eta_low"),
        log_ratio("rho_high_base_at", "rho_low").alias("log_eta_high"),
    ).where(F.col("log_eta").isNotNull())


def with_second_solution(
    df: DataFrame, score: str, error: str, alt_error: str, threshold: float
) -> DataFrame:
    """Adopt the alternative decision where the score is strictly below a negative threshold."""
    value, label = override_second(score, error, alt_error, threshold)
    kept = df.where(col(score).isNotNull() & col(error).isNotNull() & col(alt_error).isNotNull())
    return kept.withColumns({score: value, error: label})


def sums_at_thresholds(
    df: DataFrame,
    x: str,
    thresholds: Sequence[float],
    sums: Mapping[str, Column | str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Row count and sums over ``x <= t`` for every given threshold, in one aggregation.

    Rows are counted per gap between thresholds; the running totals are taken over that short
    list.  ``n_all`` and ``<sum>_all`` refer to all rows with a known ``x``.
    """
    ts = sorted({float(t) for t in thresholds})
    if not ts:
        raise ValueError("thresholds must not be empty")
    rows = with_ranges(df.where(known(x)), {"__t": (x, ts)})
    # Number of thresholds strictly below the value: a row counts from the next one on.
    first = F.col("__t") - col(x).cast("double").isin(ts).cast("int")
    measures = ["n", *sums]
    cells = rows.groupBy(*by, first.alias("i")).agg(
        F.count("*").alias("n"), *[F.sum(col(c)).alias(name) for name, c in sums.items()]
    )
    listed = cells.groupBy(*by).agg(
        F.collect_list(F.struct("i", *measures)).alias("cells"),
        *[F.sum(m).alias(f"{m}_all") for m in measures],
    )
    literal = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.lit(i).alias("i")) for i, t in enumerate(ts)]
    )
    points = listed.withColumn("p", F.explode(literal))
    upto = F.filter("cells", lambda c: c["i"] <= F.col("p.i"))
    return points.select(
        *by,
        F.col("p.threshold").alias("threshold"),
        *[summed(upto, m).alias(m) for m in measures],
        *[f"{m}_all" for m in measures],
    )


def threshold_curve(
    df: DataFrame,
    score: str,
    error: str,
    subset: str,
    baseline: str,
    thresholds: Sequence[float] | None = None,
    by: Sequence[str] = (),
    digits: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Error rate among subset rows with ``score <= t``, for given or all distinct thresholds.

    ``baseline_rate`` is the rate of the ``baseline`` label over the whole subset.
    """
    rows = df.where(col(subset)).select(
        *by,
        half_even(col(score).cast("double"), digits).alias("threshold"),
        flag(error).alias("err"),
        flag(baseline).alias("base"),
    )
    if thresholds is None:
        table = cumulative(
            rows, "threshold", {"err": "err", "base": "base"}, by, buckets=buckets, nan_last=True
        ).where(F.col("threshold").isNotNull())
        table = table.select(
            *by,
            "threshold",
            (F.col("n_before") + F.col("n")).alias("n"),
            F.col("n_total").alias("n_subset"),
            (F.col("err_before") + F.col("err")).alias("n_err"),
            F.col("base_total").alias("base"),
        )
    else:
        table = sums_at_thresholds(
            rows, "threshold", thresholds, {"err": "err", "base": "base"}, by
        ).select(
            *by,
            "threshold",
            "n",
            F.col("n_all").alias("n_subset"),
            F.col("err").alias("n_err"),
            F.col("base_all").alias("base"),
        )
    return table.select(
        *by,
        "threshold",
        "n",
        "n_subset",
        ratio("n", "n_subset").alias("fraction"),
        "n_err",
        ratio("n_err", "n").alias("conditional_rate"),
        ratio("base", "n_subset").alias("baseline_rate"),
    )


def postselect_ranked(
    df: DataFrame,
    scores: Mapping[str, str],
    abort_rates: Sequence[float],
    order: Sequence[str],
    alpha: float = 0.05,
    buckets: int | None = None,
) -> DataFrame:
    """Rank-based curves of several scores (score column -> label column) at exact sizes.

    Each rate keeps ``round_half_even((1 - r) * n)`` trials.  Per score only the trials at the
    cut positions are located; then one scan compares every trial with these literal cuts.
    """
    rates = check_rates(abort_rates)
    columns = dict.fromkeys([*scores, *scores.values(), *order])
    df, buckets = settle(df.select(*columns), buckets)
    n_total = df.count()
    sets = NestedSets(rates, n_total)
    named = {f"__level{i}": score for i, score in enumerate(scores)}
    levels = sets.with_levels(df, named, order, buckets)
    entries = [
        F.struct(
            F.lit(score).alias("score"),
            F.lit(scores[score]).alias("error_source"),
            F.col(name).alias("level"),
            flag(scores[score]).alias("err"),
        )
        for name, score in named.items()
    ]
    cells = (
        levels.select(F.explode(F.array(*entries)).alias("__e"))
        .select("__e.*")
        .groupBy("score", "error_source", "level")
        .agg(F.sum("err").alias("err"))
    )
    table = sets.totals(cells, ["err"], ["score", "error_source"])
    return table.select(
        "score",
        "error_source",
        "abort_rate",
        ratio("kept", F.lit(n_total)).alias("acceptance_rate"),
        F.col("kept").alias("n_accepted"),
        F.col("err").alias("n_error"),
        ratio("err", "kept").alias("post_ler"),
        wilson_low("err", "kept", alpha).alias("ci_low"),
        wilson_high("err", "kept", alpha).alias("ci_high"),
    )


def negative_rate(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of trials with a score below zero."""
    below = (col(score) < 0) & ~F.isnan(col(score).cast("double"))
    return (
        df.groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.coalesce(below, F.lit(False)).cast("long")), F.lit(0)).alias("n_neg"),
        )
        .withColumn("rate", ratio("n_neg", "n"))
    )


def default_rates(r_minus: float, num_points: int = 30, max_multiple: float = 2.0) -> list[float]:
    """Even grid of rejection rates past ``r_minus`` that contains ``r_minus`` itself."""
    top = max(min(0.95, r_minus * max_multiple) if r_minus > 0 else 0.5, 1e-3)
    steps = max(num_points - 1, 1)
    grid = [top if i == steps else i * (top / steps) for i in range(num_points)] + [r_minus]
    return sorted({min(max(r, 0.0), 0.999999) for r in grid})


def decompose(
    df: DataFrame,
    anchored: str,
    reselected: str,
    y0: str,
    y_star: str,
    order: Sequence[str],
    abort_rates: Sequence[float] | None = None,
    num_points: int = 30,
    max_multiple: float = 2.0,
    alpha: float = 0.05,
    buckets: int | None = None,
) -> DataFrame:
    """Split the gap between two post-selection curves into a decision and a ranking part."""
    columns = dict.fromkeys([anchored, reselected, y0, y_star, *order])
    df, buckets = settle(df.select(*columns), buckets)
    head = negative_rate(df, anchored).first()
    n_total, r_minus = head["n"], head["rate"] or 0.0
    if abort_rates is None:
        rates = default_rates(r_minus, num_points, max_multiple)
    else:
        rates = sorted({min(max(float(r), 0.0), 0.999999) for r in abort_rates})
    sets = NestedSets(rates, n_total)
    levels = sets.with_levels(
        df, {"__anchored": anchored, "__reselected": reselected}, order, buckets
    )
    before, after = flag(y0), flag(y_star)
    views = F.array(
        F.struct(
            F.col("__anchored").alias("level"),
            before.alias("y0_anc"),
            F.lit(0).cast("long").alias("y0_fg"),
            F.lit(0).cast("long").alias("ys_fg"),
        ),
        F.struct(
            F.col("__reselected").alias("level"),
            F.lit(0).cast("long").alias("y0_anc"),
            before.alias("y0_fg"),
            after.alias("ys_fg"),
        ),
    )
    measures = ["y0_anc", "y0_fg", "ys_fg"]
    cells = (
        levels.select(F.explode(views).alias("v"))
        .select("v.*")
        .groupBy("level")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    t = sets.totals(cells, measures)
    left = F.lit(1.0) - F.col("abort_rate")

    def share(m: str) -> Column:
        return ratio(m, F.lit(n_total))

    t = t.select(
        "abort_rate",
        F.lit(r_minus).alias("r_minus"),
        F.col("kept").alias("n_accepted"),
        ratio("y0_anc", "kept").alias("l_anc"),
        wilson_low("y0_anc", "kept", alpha).alias("l_anc_low"),
        wilson_high("y0_anc", "kept", alpha).alias("l_anc_high"),
        ratio("ys_fg", "kept").alias("l_fg"),
        wilson_low("ys_fg", "kept", alpha).alias("l_fg_low"),
        wilson_high("ys_fg", "kept", alpha).alias("l_fg_high"),
        ((share("ys_fg") - share("y0_fg")) / left).alias("d_decision"),
        ((share("y0_fg") - share("y0_anc")) / left).alias("d_ranking"),
    )
    return t.withColumns(
        {
            "d_total": F.col("d_decision") + F.col("d_ranking"),
            "d_total_relative": F.when(F.col("l_anc") > 0, F.col("l_fg") / F.col("l_anc")),
        }
    )
