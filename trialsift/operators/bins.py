"""Binned and per-value rates, histograms, fits and transition tables.

Uniform bins follow the digitising rule of explicit edges ``lo + i * (hi - lo) / n``: a value
belongs to the last edge not above it, the right end belongs to the last bin, and values outside
the range are clamped into the end bins (``histogram2d`` drops them instead).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.functions.exprs import (
    accept,
    col,
    denoise,
    finite,
    flag,
    half_even,
    known,
    outcome,
    override_flag,
    ratio,
    sign_group,
    signed,
    to_db,
    width_floor,
    wilson_high,
    wilson_low,
)
from trialsift.plans.ranges import attach, cumulative, with_ranges
from trialsift.session import settle


def _edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i == bins, hi).otherwise(lo + i.cast("double") * step)


def with_uniform_bin(
    df: DataFrame, name: str, x: Column, lo: Column, hi: Column, bins: int
) -> DataFrame:
    """Add the zero-based bin, possibly outside ``0 .. bins - 1`` for values outside the range.

    The division can be off by one at an edge, so the guess is corrected against the edges.  The
    guess is a column of its own: it is used several times.
    """
    step = (hi - lo) / F.lit(float(bins))
    guess = (
        F.when(x >= hi, F.lit(bins))
        .when(x < lo, F.lit(-1))
        .otherwise(F.floor(F.try_divide(x - lo, step)).cast("int"))
    )
    g = F.col("__guess")
    fixed = (
        F.when((g == -1) | (g == bins), g)
        .when(x < _edge(g, lo, hi, bins), g - 1)
        .when((g < bins) & (x >= _edge(g + 1, lo, hi, bins)), g + 1)
        .otherwise(g)
    )
    return df.withColumn("__guess", guess).withColumn(name, fixed).drop("__guess")


def _clamp(i: Column, bins: int) -> Column:
    return F.greatest(F.least(i, F.lit(bins - 1)), F.lit(0))


def binned_sums(
    df: DataFrame,
    x: str,
    sums: Mapping[str, Column | str],
    bins: int | Sequence[float],
    by: Sequence[str] = (),
    x_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Sums per bin with every bin present: ``bin``, ``bin_low``, ``bin_high``, ``bin_center``.

    NULL and NaN values of ``x`` are left out.  The range of uniform bins is per group.
    """
    by, names = list(by), list(sums)
    rows = df.where(known(x)).select(
        *by,
        col(x).cast("double").alias("__x"),
        *[col(c).alias(name) for name, c in sums.items()],
    )
    if isinstance(bins, int):
        n = bins
        if x_range is None:
            rows, _ = settle(rows)
            span = rows.groupBy(*by).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
            rows = attach(rows, span, by)
        else:
            rows = rows.select(
                "*", F.lit(float(x_range[0])).alias("__lo"), F.lit(float(x_range[1])).alias("__hi")
            )
        lo, hi = F.col("__lo"), F.col("__hi")
        rows = with_uniform_bin(rows, "bin", F.col("__x"), lo, hi, n)
        rows = rows.withColumn("bin", _clamp(F.col("bin"), n))
        extent = [F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi")]
    else:
        edges = [float(e) for e in bins]
        n = len(edges) - 1
        rows = with_ranges(rows, {"__b": ("__x", edges)})
        rows = rows.withColumn("bin", _clamp(F.col("__b") - 1, n))
        extent = []
    cells = rows.groupBy(*by, "bin").agg(*[F.sum(s).alias(s) for s in names], *extent)
    listed = cells.groupBy(*by).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("bin"), F.struct(*names)))
        ).alias("__cells"),
        *extent,
    )
    filled = listed.where(F.size("__cells") > 0).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    if isinstance(bins, int):
        lo, hi = F.col("__lo"), F.col("__hi")
        low, high = _edge(F.col("bin"), lo, hi, n), _edge(F.col("bin") + 1, lo, hi, n)
    else:
        table = F.array(*[F.lit(e) for e in edges])
        low = F.element_at(table, F.col("bin") + 1)
        high = F.element_at(table, F.col("bin") + 2)
    here = F.try_element_at("__cells", F.col("bin"))
    return filled.select(
        *by,
        "bin",
        low.alias("bin_low"),
        high.alias("bin_high"),
        (F.lit(0.5) * (low + high)).alias("bin_center"),
        *[F.coalesce(here[s], F.lit(0)).alias(s) for s in names],
    )


def _rates(table: DataFrame, lead: Sequence[str], k: str, n: str, alpha: float) -> DataFrame:
    return table.select(
        *lead,
        F.col(k).alias("count"),
        F.col(n).alias("total"),
        ratio(k, n).alias("rate"),
        wilson_low(k, n, alpha).alias("ci_low"),
        wilson_high(k, n, alpha).alias("ci_high"),
    )


def bin_rate(
    df: DataFrame,
    x: str,
    success: str,
    bins: int | Sequence[float],
    by: Sequence[str] = (),
    x_range: tuple[float, float] | None = None,
    n_total: int | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Success rate per equal-width (or given) bin, optionally over a fixed denominator."""
    table = binned_sums(df, x, {"k": flag(success), "n": F.lit(1).cast("long")}, bins, by, x_range)
    if n_total is not None:
        table = table.withColumn("n", F.lit(int(n_total)).cast("long"))
    return _rates(table, [*by, "bin", "bin_low", "bin_high", "bin_center"], "k", "n", alpha)


def value_rate(
    df: DataFrame, x: str, success: str, by: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Success rate per distinct value."""
    table = (
        df.where(known(x))
        .groupBy(*by, col(x).alias("value"))
        .agg(F.sum(flag(success)).alias("k"), F.count("*").alias("n"))
    )
    return _rates(table, [*by, "value"], "k", "n", alpha)


def histogram(
    df: DataFrame,
    x: str,
    bins: int | Sequence[float] | None = None,
    by: Sequence[str] = (),
    x_range: tuple[float, float] | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Counts per bin with density, its interval, and the interval scaled to counts.

    Without ``bins``: counts per distinct value.
    """
    if bins is None:
        return df.where(known(x)).groupBy(*by, col(x).alias("value")).agg(F.count("*").alias("count"))
    one = F.lit(1).cast("long")
    table = binned_sums(df, x, {"k": one}, bins, by, x_range)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    table = table.withColumn("n", F.sum("k").over(group))
    out = _rates(table, [*by, "bin", "bin_low", "bin_high", "bin_center"], "k", "n", alpha)
    return out.withColumns(
        {
            "count_low": F.col("ci_low") * F.col("total"),
            "count_high": F.col("ci_high") * F.col("total"),
        }
    )


def prepared_score(
    score: str,
    error: str | None = None,
    negative: bool = False,
    db: bool = False,
    digits: int | None = None,
) -> Column:
    """Score after the optional sign flip on errors, decibel conversion and rounding."""
    value = col(score).cast("double")
    if negative:
        if error is None:
            raise ValueError("negative scores need an error column")
        value = signed(value, error)
    if db:
        value = to_db(value)
    return half_even(value, digits)


def score_distribution(
    df: DataFrame,
    scores: Sequence[str],
    error: str,
    bins: int | None = None,
    by: Sequence[str] = (),
    separate_error: bool = False,
    negative: bool = False,
    db: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Distributions of several scores side by side, optionally split by the label."""
    keys = [*by, *([error] if separate_error and error not in by else [])]
    entries = F.array(
        *[
            F.struct(
                F.lit(s).alias("metric"),
                prepared_score(s, error, negative, db, digits).alias("x"),
            )
            for s in scores
        ]
    )
    usable = df.where(col(error).isNotNull()) if negative else df
    long = usable.select(*keys, F.explode(entries).alias("__e")).select(*keys, "__e.metric", "__e.x")
    return histogram(long, "x", bins, ["metric", *keys])


def sentinel_counts(
    df: DataFrame, score: str, error: str, by: Sequence[str] = ()
) -> DataFrame:
    """Trials whose score is +inf, split by label, and their error rate."""
    top = (col(score).cast("double") == F.lit(float("inf"))).cast("long")
    err = flag(error)
    rows = df.where(col(score).isNotNull() & col(error).isNotNull())
    return (
        rows.groupBy(*by)
        .agg(
            F.coalesce(F.sum(top), F.lit(0)).alias("n_inf"),
            F.coalesce(F.sum(top * err), F.lit(0)).alias("n_inf_error"),
            F.coalesce(F.sum(top * (1 - err)), F.lit(0)).alias("n_inf_ok"),
        )
        .withColumn("inf_error_rate", ratio("n_inf_error", "n_inf"))
    )


def unique_values(
    df: DataFrame, score: str, error: str | None = None, negative: bool = False,
    db: bool = False, digits: int | None = None,
) -> DataFrame:
    """Distinct values after the optional conversions, sorted."""
    usable = df.where(col(error).isNotNull()) if negative else df
    value = prepared_score(score, error, negative, db, digits)
    return usable.select(value.alias("value")).where(known("value")).distinct().orderBy("value")


def accept_rate(
    df: DataFrame, accepted: str, by: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Accept rate of a boolean flag (or of a number above one half) per group; 0 for no rows."""
    boolean = dict(df.dtypes)[accepted] == "boolean"
    table = df.groupBy(*by).agg(
        F.coalesce(F.sum(flag(accept(accepted, boolean))), F.lit(0)).alias("k"),
        F.count("*").alias("n"),
    )
    return _rates(table, list(by), "k", "n", alpha).fillna(0.0, ["rate", "ci_low", "ci_high"])


def conditional_rate(
    df: DataFrame,
    score: str,
    error: str,
    bins: int | None = None,
    by: Sequence[str] = (),
    sign_split: bool = False,
    db: bool = False,
    digits: int | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Error rate conditioned on the score, by bin or value, optionally split by its sign."""
    rows = df.where(known(score) & col(error).isNotNull()).select(
        *by,
        *([sign_group(score).alias("sign_group")] if sign_split else []),
        prepared_score(score, db=db, digits=digits).alias("x"),
        flag(error).cast("boolean").alias("err"),
    )
    keys = [*by, *(["sign_group"] if sign_split else [])]
    if bins is None:
        return value_rate(rows, "x", "err", keys, alpha)
    return bin_rate(rows, "x", "err", bins, keys, alpha=alpha)


def logit_points(rates: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Log-odds ``ln((1 - p) / p)`` and its interval for points strictly between 0 and 1."""
    usable = rates.where((F.col("rate") > 0) & (F.col("rate") < 1))

    def logit(p: str) -> Column:
        return F.log((F.lit(1.0) - F.col(p)) / F.col(p))

    inside = (F.col("ci_low") > 0) & (F.col("ci_high") < 1)
    return usable.select(
        *by,
        F.col(x).alias("g"),
        logit("rate").alias("z"),
        F.when(inside, logit("ci_high")).alias("z_low"),
        F.when(inside, logit("ci_low")).alias("z_high"),
    )


def logit_fit(
    rates: DataFrame, x: str = "bin_center", by: Sequence[str] = (), extend: float = 1.5
) -> DataFrame:
    """Least-squares line ``z = slope * g + intercept`` per group (two points at least).

    ``g_low``/``g_high`` is the range of the fit line, extended away from zero by ``extend``.
    """
    points = logit_points(rates, x, by)
    fit = points.groupBy(*by).agg(
        F.count("*").alias("n_points"),
        F.regr_slope("z", "g").alias("slope"),
        F.regr_intercept("z", "g").alias("intercept"),
        F.min("g").alias("g_min"),
        F.max("g").alias("g_max"),
    )
    left = F.col("g_max") <= 0
    factor = F.lit(float(extend))
    return fit.where(F.col("n_points") >= 2).select(
        *by,
        "n_points",
        "slope",
        "intercept",
        F.when(left, F.col("g_min") * factor).otherwise(F.col("g_min")).alias("g_low"),
        F.when(left, F.col("g_max")).otherwise(F.col("g_max") * factor).alias("g_high"),
    )


def fit_line(fit: DataFrame, points: int = 300, by: Sequence[str] = ()) -> DataFrame:
    """Points on each fit line and its logistic curve ``1 / (1 + exp(z))``."""
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    width = (F.col("g_high") - F.col("g_low")) / F.lit(float(max(points - 1, 1)))
    line = fit.withColumn("i", F.explode(steps)).withColumn(
        "g", F.col("g_low") + F.col("i").cast("double") * width
    )
    z = F.col("slope") * F.col("g") + F.col("intercept")
    return line.select(*by, "g", z.alias("z"), (F.lit(1.0) / (F.lit(1.0) + F.exp(z))).alias("rate"))


def histogram2d(
    df: DataFrame,
    x: str,
    y: str,
    error: str,
    bins: tuple[int, int] = (60, 60),
    x_range: tuple[float, float] | None = None,
    y_range: tuple[float, float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Non-empty cells of a 2-D histogram with error counts; values outside a range are dropped.

    Only pairs of finite values count.  A degenerate range is widened by one half on each side.
    """
    nx, ny = bins
    rows = df.where(finite(x) & finite(y)).select(
        *by,
        col(x).cast("double").alias("__x"),
        col(y).cast("double").alias("__y"),
        flag(error).alias("err"),
    )
    if x_range is None or y_range is None:
        rows, _ = settle(rows)
        span = rows.groupBy(*by).agg(
            F.min("__x").alias("__xl"), F.max("__x").alias("__xh"),
            F.min("__y").alias("__yl"), F.max("__y").alias("__yh"),
        )
        rows = attach(rows, span, by)
    if x_range is not None:
        rows = rows.withColumns({"__xl": F.lit(float(x_range[0])), "__xh": F.lit(float(x_range[1]))})
    if y_range is not None:
        rows = rows.withColumns({"__yl": F.lit(float(y_range[0])), "__yh": F.lit(float(y_range[1]))})
    for a in "xy":
        lo, hi = F.col(f"__{a}l"), F.col(f"__{a}h")
        flat = lo == hi
        rows = rows.withColumns(
            {
                f"__{a}l": F.when(flat, lo - 0.5).otherwise(lo),
                f"__{a}h": F.when(flat, hi + 0.5).otherwise(hi),
            }
        )
    inside = F.col("__x").between(F.col("__xl"), F.col("__xh")) & F.col("__y").between(
        F.col("__yl"), F.col("__yh")
    )
    rows = rows.where(inside)
    rows = with_uniform_bin(rows, "__bx", F.col("__x"), F.col("__xl"), F.col("__xh"), nx)
    rows = with_uniform_bin(rows, "__by", F.col("__y"), F.col("__yl"), F.col("__yh"), ny)
    bx, by_ = F.least("__bx", F.lit(nx - 1)), F.least("__by", F.lit(ny - 1))
    cells = (
        rows.groupBy(*by, bx.alias("bin_x"), by_.alias("bin_y"))
        .agg(
            F.count("*").alias("n"),
            F.sum("err").alias("n_err"),
            *[F.max(f"__{a}{e}").alias(f"__{a}{e}") for a in "xy" for e in "lh"],
        )
    )
    xl, xh, yl, yh = (F.col(c) for c in ("__xl", "__xh", "__yl", "__yh"))
    return cells.select(
        *by,
        "bin_x",
        "bin_y",
        _edge(F.col("bin_x"), xl, xh, nx).alias("x_low"),
        _edge(F.col("bin_x") + 1, xl, xh, nx).alias("x_high"),
        _edge(F.col("bin_y"), yl, yh, ny).alias("y_low"),
        _edge(F.col("bin_y") + 1, yl, yh, ny).alias("y_high"),
        "n",
        "n_err",
        F.log10("n").alias("log10_n"),
        ratio("n_err", "n").alias("error_rate"),
    )


# Order of the transition categories.
TRANSITIONS = ("fixed", "broken", "both_wrong", "both_correct")


def transitions(
    df: DataFrame,
    score: str,
    anchored: str,
    y0: str,
    y_star: str,
    bins: int | Sequence[float] = 10,
    scale: str = "gap_value",
    x_range: tuple[float, float] | None = None,
    by: Sequence[str] = (),
    alpha: float = 0.05,
    buckets: int | None = None,
) -> DataFrame:
    """Shares of the four decision changes among trials with ``anchored < 0``, per score bin.

    ``abort_rate`` scale: the bin axis is the share of all trials with a score not above theirs.
    """
    if scale not in ("gap_value", "abort_rate"):
        raise ValueError("scale must be 'gap_value' or 'abort_rate'")
    anc = col(anchored).cast("double")
    chosen = F.coalesce((anc < 0) & ~F.isnan(anc), F.lit(False))
    change = outcome(y0, y_star)
    sums = {c: (chosen & (change == c)).cast("long") for c in TRANSITIONS}
    if scale == "abort_rate":
        # Trials without a score stay in the denominator, with the largest rate of all.
        scored = df.withColumn(score, F.coalesce(col(score).cast("double"), F.lit(float("nan"))))
        table = cumulative(scored, score, sums, by, buckets=buckets, nan_last=True)
        rank = (F.col("n_before") + F.col("n")) / F.col("n_total")
        rows = table.withColumn("__axis", rank)
    else:
        rows = (
            df.where(known(score) & chosen)
            .groupBy(*by, col(score).alias("__axis"))
            .agg(*[F.sum(c).alias(name) for name, c in sums.items()])
        )
    members = sum((F.col(c) for c in TRANSITIONS), F.lit(0).cast("long"))
    rows = rows.withColumn("n_bin", members).where(F.col("n_bin") > 0)
    table = binned_sums(
        rows, "__axis", {**{c: c for c in TRANSITIONS}, "n_bin": "n_bin"}, bins, by, x_range
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(c).alias("count")) for c in TRANSITIONS]
    )
    long = table.withColumn("c", F.explode(pairs))
    return long.select(
        *by,
        "bin",
        "bin_low",
        "bin_high",
        "bin_center",
        F.col("c.category").alias("category"),
        F.col("c.count").alias("count"),
        "n_bin",
        ratio("c.count", "n_bin").alias("fraction"),
        wilson_low("c.count", "n_bin", alpha).alias("ci_low"),
        wilson_high("c.count", "n_bin", alpha).alias("ci_high"),
    )


def case_counts(
    df: DataFrame,
    case: str,
    cases: Sequence[int] = (-1, 0, 1, 2, 3),
    by: Sequence[str] = (),
) -> DataFrame:
    """Count and share per case label, every listed case present; shares refer to all rows."""
    counted = df.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.sum(flag(col(case).cast("int") == c)).alias(f"__c{i}") for i, c in enumerate(cases)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(int(c)).alias("case"), F.col(f"__c{i}").alias("n"))
            for i, c in enumerate(cases)
        ]
    )
    return counted.select(*by, "total", F.explode(entries).alias("__e")).select(
        *by,
        "__e.case",
        F.coalesce("__e.n", F.lit(0)).alias("n"),
        "total",
        F.coalesce(ratio("__e.n", "total"), F.lit(0.0)).alias("fraction"),
    )


def case_by_gap(
    df: DataFrame, gap: str, case: str, digits: int = 0, normalize: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts of the cases per rounded gap, one column per case.

    ``normalize`` divides the stacked cases 0-3 by their sum; case -1 is always a count.
    """
    rows = df.where(known(gap) & col(case).isNotNull())
    table = rows.groupBy(*by, half_even(col(gap).cast("double"), digits).alias("gap_bin")).agg(
        F.sum(flag(col(case) == -1)).alias("case_neg1"),
        *[F.sum(flag(col(case) == c)).alias(f"case_{c}") for c in range(4)],
    )
    if not normalize:
        return table
    stacked = sum((F.col(f"case_{c}") for c in range(4)), F.lit(0).cast("long"))
    share = {f"case_{c}": F.coalesce(ratio(f"case_{c}", "__all"), F.lit(0.0)) for c in range(4)}
    return table.withColumn("__all", stacked).withColumns(share).drop("__all")


def split_histogram(
    df: DataFrame,
    split: str,
    case: str,
    x: str,
    error: str | None = None,
    cases: Sequence[int] = (0, 1, 2, 3),
    threshold: float = 0.0,
    include_threshold: bool = True,
    width: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Normalised histograms of ``x``: rows above the split threshold, and the rest by case.

    ``error`` flips the sign of ``x`` on errors.
    """
    value = signed(x, error) if error else col(x)
    value = denoise(value.cast("double"), digits)
    if width is not None:
        value = width_floor(value, width)
    low = override_flag(split, threshold, include_threshold)
    group = F.when(~low, F.lit("above")).when(
        col(case).isin(list(cases)), F.concat(F.lit("case "), col(case).cast("string"))
    )
    rows = df.where(known(split) & known(x) & col(case).isNotNull()).select(
        group.alias("series"), value.alias("x")
    )
    counts = rows.where(F.col("series").isNotNull()).groupBy("series", "x").agg(
        F.count("*").alias("n")
    )
    # At most one series per listed case and one more: totals come from a short table.
    totals = counts.groupBy("series").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "series").select(
        "series", "x", "n", ratio("n", "total").alias("fraction")
    )


def override_probability(
    df: DataFrame,
    split: str,
    gaps: Sequence[str],
    threshold: float = 0.0,
    inclusive: bool = True,
    error: str | None = None,
    bins: int | None = None,
    digits: int | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """P(split score at or below the threshold | gap), for one or several gap definitions."""
    event = override_flag(split, threshold, inclusive)
    entries = F.array(
        *[
            F.struct(
                F.lit(g).alias("gap"),
                denoise((signed(g, error) if error else col(g)).cast("double"), digits).alias("x"),
            )
            for g in gaps
        ]
    )
    usable = df.where(known(split)).select(event.alias("event"), F.explode(entries).alias("__e"))
    rows = usable.select("event", "__e.gap", "__e.x")
    if bins is None:
        return value_rate(rows, "x", "event", ["gap"], alpha)
    return bin_rate(rows, "x", "event", bins, ["gap"], alpha=alpha)


def outcome_series(
    df: DataFrame, score: str, error: str, alt_error: str, bins: int | None = None,
    documented: bool = False,
) -> DataFrame:
    """Three series by label and alternative label: ``error``, ``no_error``, ``stage2_correct``.

    Trials whose alternative is right form ``stage2_correct`` and leave both ordinary series; with
    ``documented`` they leave only the error series.
    """
    err, alt = col(error), col(alt_error)
    ordinary = F.when(err, F.lit("error")).otherwise(F.lit("no_error"))
    if documented:
        series = F.when(err & ~alt, F.lit("stage2_correct")).otherwise(ordinary)
    else:
        series = F.when(~alt, F.lit("stage2_correct")).otherwise(ordinary)
    rows = df.where(err.isNotNull() & alt.isNotNull()).withColumn("series", series)
    return histogram(rows, score, bins, ["series"])
