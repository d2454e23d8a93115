"""Descriptive statistics, frequencies and rank correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift.functions.exprs import col, finite, flag, half_away, known, ratio
from trialsift.functions.registry import stage_values, stat_columns
from trialsift.functions.tails import kendall_p, spearman_p
from trialsift.operators import dominance
from trialsift.plans.ranges import (
    attach,
    cumulative,
    hot_values,
    join_groups,
    order_statistics,
    sketch_bounds,
)
from trialsift.session import cut_lineage, settle



def unpivot(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], name: str, value: str = "value"
) -> DataFrame:
    """Long form: one row per input row and column, all values as double."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias(name), col(c).cast("double").alias(value))
            for c in columns
        ]
    )
    return df.select(*by, F.explode(entries).alias("__e")).select(*by, "__e.*")


def describe(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    method: str = "nearest",
    buckets: int | None = None,
) -> DataFrame:
    """Count (with NULLs), mean, sample standard deviation, extremes and exact quantiles."""
    columns = list(columns) if columns is not None else stage_values(df.columns)
    if not columns:
        raise ValueError("no columns to describe")
    long = unpivot(df, columns, by, "column")
    keys = [*by, "column"]
    moments = long.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max(F.when(known("value"), F.col("value"))).alias("max"),
    )
    marks = _quantile_columns(long, keys, quantiles, method, buckets)
    return join_groups(moments, marks, keys, "left").select(
        *keys, "count", "mean", "std", "min", *[c for c in marks.columns if c not in keys], "max"
    )


def quantile_name(q: float) -> str:
    return f"q{int(round(q * 100)):02d}"


def _quantile_columns(long, keys, quantiles, method, buckets) -> DataFrame:
    points = order_statistics(long, "value", quantiles, by=keys, method=method, buckets=buckets)
    return points.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("slot") == i, F.col("value"))).alias(quantile_name(q))
            for i, q in enumerate(quantiles)
        ]
    )


def summarize_stats(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = ("experiment",),
    buckets: int | None = None,
) -> DataFrame:
    """Rows, NULLs, finite count (infinities included), moments and quartiles per column."""
    columns = list(columns) if columns is not None else stat_columns(df.schema, by)
    if not columns:
        raise ValueError("no stat columns")
    long = unpivot(df, columns, by, "stat_column")
    keys = [*by, "stat_column"]
    ok = known("value")
    base = long.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.sum(F.col("value").isNull().cast("long")).alias("null_count"),
        F.sum(ok.cast("long")).alias("finite_count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max(F.when(ok, F.col("value"))).alias("max"),
    )
    # The median interpolates, the quartiles take the nearest value: both from one pass.
    points = order_statistics(
        long, "value", [0.5], by=keys, method="linear", buckets=buckets
    ).select(*keys, F.col("value").alias("median"))
    quartiles = _quantile_columns(long, keys, [0.25, 0.75], "nearest", buckets)
    joined = join_groups(join_groups(base, quartiles, keys, "left"), points, keys, "left")
    return joined.select(
        *keys, "rows", "null_count", "finite_count", "mean", "std", "min", "q25", "median", "q75",
        "max",
    )


def value_frequency(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    digits: int | None = None,
    finite_only: bool = True,
) -> DataFrame:
    """How often each value of each column occurs, optionally rounded."""
    if not columns:
        raise ValueError("columns must not be empty")
    long = unpivot(df, columns, by, "stat_column")
    if finite_only:
        long = long.where(finite("value"))
    value = half_away("value", digits)
    return long.groupBy(*by, "stat_column", value.alias("value")).agg(
        F.count("*").alias("frequency")
    )


def finite_values(df: DataFrame, column: str) -> DataFrame:
    """Finite values of one column."""
    return df.where(finite(column)).select(col(column).cast("double").alias("value"))


def index_frequency(
    df: DataFrame,
    array_column: str,
    n_indices: int,
    error: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """How often each index occurs in a set-valued column, as count and share of the rows.

    Every index below ``n_indices`` is present; shares divide by the rows of the group, at least 1.
    """
    keys = [*by, *([error] if error else [])]
    rows = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    hits = (
        df.select(*keys, F.explode(array_column).alias("idx"))
        .where((F.col("idx") >= 0) & (F.col("idx") < n_indices))
        .groupBy(*keys, F.col("idx").cast("int").alias("idx"))
        .agg(F.count("*").alias("count"))
    )
    grid = rows.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n_indices - 1))))
    joined = join_groups(grid, hits, [*keys, "idx"], "left")
    return joined.select(
        *keys,
        "idx",
        F.coalesce("count", F.lit(0)).alias("count"),
        "n_rows",
        ratio(F.coalesce("count", F.lit(0)), F.greatest("n_rows", F.lit(1))).alias("fraction"),
    )


# ---- rank correlations -----------------------------------------------------------------------


def _lookup(rows: DataFrame, table: DataFrame, key: str, hot: Sequence[float]) -> DataFrame:
    """Join a table with one row per value onto rows that may repeat a value very often.

    Rows of the hot values meet a broadcast of just those values; the rest is a shuffle join.
    """
    if not hot:
        return rows.join(table, key)
    frequent = F.col(key).cast("double").isin(list(hot))
    few = F.broadcast(table.where(frequent))
    common = rows.where(frequent).join(few, key)
    return rows.where(~frequent).join(table.where(~frequent), key).unionByName(common)


def average_ranks(
    pairs: DataFrame, x: str, weight: str, buckets: int | None = None,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Average rank of every distinct value (ties share the mean of their positions)."""
    table = cumulative(pairs, x, weight=weight, buckets=buckets, bounds=bounds)
    middle = F.col("n_before").cast("double") + (F.col("n") + 1).cast("double") / 2.0
    return table.select(x, middle.alias(f"rank_{x}"))


def _distinct_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Finite pairs with their number of occurrences; a negative zero counts as zero."""
    zero = F.lit(0.0)
    return (
        df.where(finite(x) & finite(y))
        .groupBy((col(x).cast("double") + zero).alias("x"), (col(y).cast("double") + zero).alias("y"))
        .agg(F.count("*").alias("w"))
    )


def _spearman(pairs: DataFrame, buckets: int | None) -> DataFrame:
    """One row: number of finite pairs and the rank correlation, from distinct pairs."""
    pairs, buckets = settle(pairs, buckets)
    bounds = sketch_bounds(pairs, {"x": "x", "y": "y"}, buckets)
    ranked = pairs
    for c in ("x", "y"):
        table = average_ranks(pairs, c, "w", bounds=bounds[c])
        ranked = _lookup(ranked, table, c, hot_values(bounds[c]))
    sums = ranked.agg(*_rank_sums("rank_x", "rank_y", F.col("w"), "r"))
    return sums.select(F.col("r_n").alias("n"), _rho("r").alias("rho"))


def spearman(df: DataFrame, x: str, y: str, buckets: int | None = None) -> DataFrame:
    """One row: number of pairs finite in both scores, and their rank correlation."""
    return _spearman(_distinct_pairs(df, x, y), buckets)


def _rank_sums(x: str, y: str, weight: Column, name: str) -> list[Column]:
    """Exact integer sums over twice the ranks, so that the order of rows does not matter."""
    rx, ry = ((F.col(c) * 2).cast("decimal(20,0)") for c in (x, y))
    w, wide = weight.cast("decimal(20,0)"), "decimal(38,0)"
    wx, wy = (w * rx).cast(wide), (w * ry).cast(wide)
    parts = {"sx": wx, "sy": wy, "sxy": (wx * ry).cast(wide), "sxx": (wx * rx).cast(wide), "syy": (wy * ry).cast(wide)}
    return [
        F.sum(weight).alias(f"{name}_n"),
        *[F.sum(c).cast("double").alias(f"{name}_{part}") for part, c in parts.items()],
    ]


def _rho(name: str) -> Column:
    n, sx, sy, sxy, sxx, syy = (F.col(f"{name}_{p}").cast("double") for p in ("n", "sx", "sy", "sxy", "sxx", "syy"))
    cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy))


def _all_spearman(df: DataFrame, scores: Sequence[str], buckets: int | None) -> DataFrame:
    """One row with ``<i>_<j>_*`` sums of all pairs of scores that are finite in every trial.

    Each score is ranked once; all pairs come from one aggregation.
    """
    zero = F.lit(0.0)
    rows = df.select(*[(col(c).cast("double") + zero).alias(f"__v{i}") for i, c in enumerate(scores)])
    names = [f"__v{i}" for i in range(len(scores))]
    bounds = sketch_bounds(rows, {n: n for n in names}, buckets)
    ranked = rows
    for n in names:
        table = average_ranks(rows.withColumn("w", F.lit(1)), n, "w", bounds=bounds[n])
        ranked = _lookup(ranked, table, n, hot_values(bounds[n]))
    sums = []
    for i in range(len(scores)):
        for j in range(i + 1, len(scores)):
            sums += _rank_sums(f"rank___v{i}", f"rank___v{j}", F.lit(1), f"p{i}_{j}")
    return ranked.agg(*sums)


def _settled_scores(df: DataFrame, scores: Sequence[str], buckets: int | None):
    """The score columns alone, written once if they come out of a costly plan."""
    settled, _ = settle(df.select(*dict.fromkeys(scores)), buckets)
    return settled, buckets


def spearman_matrix(
    df: DataFrame,
    scores: Sequence[str],
    negate: Sequence[str] = (),
    labels: Mapping[str, str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Rank correlation of every ordered pair of scores, over pairwise finite trials (3 at least)."""
    labels, negated = dict(labels or {}), set(negate)
    df, buckets = _settled_scores(df, scores, buckets)

    def label(c: str) -> str:
        return ("-" if c in negated else "") + labels.get(c, c)

    out = df.sparkSession.createDataFrame(
        [(label(c), label(c), 1.0) for c in scores], "left string, right string, rho double"
    )
    places = [(i, j) for i in range(len(scores)) for j in range(i + 1, len(scores))]
    if not places:
        return out

    def both(i: int, j: int, n: Column, rho: Column) -> Column:
        a, b = scores[i], scores[j]
        sign = -1.0 if (a in negated) != (b in negated) else 1.0
        value = F.when(n >= 3, F.lit(sign) * rho).alias("rho")
        return F.array(
            F.struct(F.lit(label(a)).alias("left"), F.lit(label(b)).alias("right"), value),
            F.struct(F.lit(label(b)).alias("left"), F.lit(label(a)).alias("right"), value),
        )

    # Pairwise finite trials are all trials unless some score has gaps.
    gaps = df.agg(*[F.max((~finite(c)).cast("int")).alias(f"g{i}") for i, c in enumerate(scores)]).first()
    if not any(gaps):
        sums = _all_spearman(df, scores, buckets)
        cells = F.concat(*[both(i, j, F.col(f"p{i}_{j}_n"), _rho(f"p{i}_{j}")) for i, j in places])
        return out.unionByName(sums.select(F.explode(cells).alias("e")).select("e.*"))
    for i, j in places:
        row = _spearman(_distinct_pairs(df, scores[i], scores[j]), buckets)
        cells = row.select(F.explode(both(i, j, F.col("n"), F.col("rho"))).alias("e"))
        out = out.unionByName(cells.select("e.*"))
    return out


def _tie_terms(pairs: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Sums over tie groups of t(t-1), t(t-1)(t-2) and t(t-1)(2t+5), as one row of exact whole numbers."""
    wide = "decimal(38,0)"
    t = pairs.groupBy(*keys).agg(F.sum("w").alias("t"))
    size = F.col("t").cast("decimal(18,0)")
    two = (size * (size - 1)).cast(wide)

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c.cast(wide)), F.lit(0)).cast(wide).alias(f"{prefix}{name}")

    return t.agg(total(two, "2"), total(two * (size - 2), "3"), total(two * (size * 2 + 5), "5"))


def kendall(df: DataFrame, x: str, y: str, max_rows: int = dominance.MAX_ROWS) -> DataFrame:
    """Kendall's tau-b with its tie terms, as one row: ``n, excess, tau`` and the variance parts.

    Distinct pairs are cut into pieces of at most ``max_rows``, whatever their number.  Counts are exact whole numbers.
    """
    return _kendall(cut_lineage(_distinct_pairs(df, x, y), free=True), max_rows)


def kendall_and_spearman(
    df: DataFrame, x: str, y: str, max_rows: int = dominance.MAX_ROWS, buckets: int | None = None
) -> DataFrame:
    """The row of :func:`kendall` with Spearman's correlation as ``rho``; distinct pairs are formed once."""
    pairs = cut_lineage(_distinct_pairs(df, x, y), free=True)
    return attach(_kendall(pairs, max_rows), _spearman(pairs, buckets).select("rho"), [])


def _kendall(pairs: DataFrame, max_rows: int) -> DataFrame:
    row = pairs.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"))
    for table in (
        dominance.excess(pairs, max_rows),
        _tie_terms(pairs, ["x"], "x"),
        _tie_terms(pairs, ["y"], "y"),
        _tie_terms(pairs, ["x", "y"], "xy"),
    ):
        row = attach(row, table, [])
    n = F.col("n").cast("double")
    all2 = n * (n - 1.0)
    scale = F.sqrt(all2 - F.col("x2")) * F.sqrt(all2 - F.col("y2"))
    tau = F.when(scale > 0, F.lit(2.0) * F.col("excess").cast("double") / scale)
    return row.withColumn("tau", F.greatest(F.least(tau, F.lit(1.0)), F.lit(-1.0)))


def rank_correlations(
    df: DataFrame, pairs: Sequence[tuple[str, str]], buckets: int | None = None
) -> DataFrame:
    """Spearman and Kendall correlation with two-sided p-values for pairs of scores."""
    df, buckets = _settled_scores(df, [c for pair in pairs for c in pair], buckets)
    out = None
    for left, right in pairs:
        row = kendall_and_spearman(df, left, right, buckets=buckets).withColumnRenamed("rho", "spearman_r").select(
            F.lit(left).alias("left_score"),
            F.lit(right).alias("right_score"),
            "n",
            "spearman_r",
            spearman_p("spearman_r", "n").alias("spearman_p"),
            F.col("tau").alias("kendall_tau"),
            kendall_p("n", "excess", "x2", "x3", "x5", "y2", "y3", "y5").alias("kendall_p"),
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("at least one pair is needed")
    return out
