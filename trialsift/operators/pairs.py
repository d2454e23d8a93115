"""Joins of several scorers' trial tables, and how two scores agree or differ."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.functions.exprs import (
    col,
    finite,
    flag,
    half_even,
    known,
    pair_relation,
    ratio,
    same_within,
    signed,
    wilson_high,
    wilson_low,
)
from trialsift.plans.ranges import attach, neighbours
from trialsift.session import settle

# Parameters that identify a trial besides its id, used where both sides have them.
TRIAL_KEYS = ("batch", "code", "d", "p", "rounds", "noisemodel", "xyz")


def shared_keys(left: DataFrame, right: DataFrame, id_column: str = "shot_id") -> list[str]:
    """Id column and every trial parameter present on both sides."""
    both = set(left.columns) & set(right.columns)
    return [id_column, *[k for k in TRIAL_KEYS if k in both]]


def checked_unique(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """The same rows; the query fails if the keys repeat, since a join on them would multiply rows.

    The count uses the partitioning by key that the join needs anyway.
    """
    message = f"{side} rows repeat for keys {list(keys)}; pass allow_fanout=True"
    times = F.count("*").over(Window.partitionBy(*keys))
    counted = df.withColumn("__times", times)
    single = F.when(F.col("__times") > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
    return counted.where(single).drop("__times")


def join_scores(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] | None = None,
    error: str = "is_logical_error",
    allow_fanout: bool = False,
) -> DataFrame:
    """Inner join of two trial tables; their label columns get the suffixes ``_x`` and ``_y``."""
    keys = list(keys) if keys is not None else shared_keys(left, right)
    if not allow_fanout:
        left, right = checked_unique(left, keys, "left"), checked_unique(right, keys, "right")
    lhs = left.withColumnRenamed(error, f"{error}_x")
    rhs = right.withColumnRenamed(error, f"{error}_y")
    extra = [c for c in rhs.columns if c not in keys and c not in lhs.columns]
    return lhs.join(rhs.select(*keys, *extra), keys)


def join_many(dfs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of many trial tables on the same keys; the shuffle on the keys is shared."""
    return reduce(lambda a, b: a.join(b, list(keys)), dfs)


def rerank(
    df: DataFrame,
    ranking: DataFrame,
    score: str,
    ranking_score: str,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Replace a score by another table's score of the same trial; labels stay.

    Trials that the other table lacks are left out, so the result may be empty.
    """
    keys = list(keys) if keys is not None else shared_keys(df, ranking)
    other = ranking.select(*keys, col(ranking_score).alias("__ranking"))
    joined = df.drop(score).join(other, keys).withColumnRenamed("__ranking", score)
    return joined.select(*df.columns)


def case_scatter(
    gap: DataFrame,
    other: DataFrame,
    case: str,
    cases: Sequence[int] | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Pairs of a case-labelled score with another score, optionally for some cases only."""
    keys = list(keys) if keys is not None else shared_keys(gap, other)
    rows = gap if cases is None else gap.where(col(case).isin(list(cases)))
    extra = [c for c in other.columns if c not in keys and c not in rows.columns]
    return rows.join(other.select(*keys, *extra), keys)


def concordance(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Concordance correlation of finite pairs (population moments), one aggregation."""
    pairs = df.where(finite(x) & finite(y)).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.covar_pop(x, y).alias("cov"),
        F.var_pop(x).alias("vx"),
        F.var_pop(y).alias("vy"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
    )
    shift = F.col("mx") - F.col("my")
    spread = F.col("vx") + F.col("vy") + shift * shift
    value = F.when((F.col("n") >= 2) & (spread > 0), F.lit(2.0) * F.col("cov") / spread)
    return pairs.select(*by, "n", value.alias("ccc"))


def over_under(df: DataFrame, a: str, b: str, error: str, by: Sequence[str] = ()) -> DataFrame:
    """Shares of ``|b|`` above, below and equal to ``|a|``: overall, errors, non-errors.

    The three overlapping subsets come out of one aggregation.
    """
    va, vb = F.abs(col(a).cast("double")), F.abs(col(b).cast("double"))
    usable = ~F.isnan(va) & ~F.isnan(vb)
    over, under = (vb > va) & usable, (vb < va) & usable
    err = F.coalesce(col(error), F.lit(False))
    subsets = {"overall": F.lit(True), "logical_error": err, "non_logical_error": ~err}
    rows = df.where(col(a).isNotNull() & col(b).isNotNull())

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))

    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("subset"),
                count(inside).alias("n"),
                count(inside & over).alias("n_over"),
                count(inside & under).alias("n_under"),
            )
            for name, inside in subsets.items()
        ]
    )
    long = rows.groupBy(*by).agg(entries.alias("__e")).select(*by, F.explode("__e").alias("__e"))
    long = long.select(*by, "__e.*")
    return long.select(
        *by,
        "subset",
        "n",
        ratio("n_over", "n").alias("p_overconfident"),
        ratio("n_under", "n").alias("p_underconfident"),
        ratio(F.col("n") - F.col("n_over") - F.col("n_under"), "n").alias("p_equal"),
    )


# ---- exact / forced pairs with two stages ----------------------------------------------------


def with_pair_columns(
    df: DataFrame,
    exact: str = "logical_gap",
    forced: str = "forced_gap_ml",
    exact_error: str = "logical_is_logical_error",
    forced_error: str = "forced_is_logical_error",
    exact_stage1: str = "logical_stage1_weight",
    forced_stage1: str = "forced_stage1_weight",
    tol: float = 1e-9,
    digits: int | None = None,
) -> DataFrame:
    """Difference, relation, signed and rounded values of an exact/forced score pair."""
    e, f = col(exact), col(forced)
    return df.withColumns(
        {
            "gap_diff": f - e,
            "stage1_weight_same": same_within(exact_stage1, forced_stage1, tol),
            "logical_gap_signed": signed(exact, exact_error),
            "forced_gap_signed": signed(forced, forced_error),
            "gap_relation": pair_relation(exact, forced, tol),
            "logical_gap_value": half_even(e, digits),
            "forced_gap_value": half_even(f, digits),
        }
    )


def stage1_case(df: DataFrame, case: str = "same") -> DataFrame:
    """Keep pairs whose stage-1 weights are the same, different (``diff``), or all of them."""
    if case == "all":
        return df
    if case == "same":
        return df.where(F.col("stage1_weight_same"))
    if case in ("different", "diff"):
        return df.where(~F.col("stage1_weight_same"))
    raise ValueError("case must be 'all', 'same', 'different' or 'diff'")


def with_override(
    df: DataFrame, stage1: str = "forced_stage1_weight", stage2: str = "forced_stage2_weight"
) -> DataFrame:
    """Override flag (stage 2 strictly lighter) and the anchored gap stage 2 - stage 1."""
    return df.withColumns(
        {"forced_override": col(stage2) < col(stage1), "anchored_gap": col(stage2) - col(stage1)}
    )


def with_indicators(df: DataFrame) -> DataFrame:
    """Before/after labels and the two gaps of a reselected decision."""
    return df.withColumns(
        {
            "y0": F.col("forced_stage1_obs_flip"),
            "y_star": F.col("forced_is_logical_error"),
            "delta_fg": F.col("forced_gap_ml"),
            "delta_anc": F.col("forced_stage2_weight") - F.col("forced_stage1_weight"),
        }
    )


def _difference_stats() -> list[Column]:
    d, relation = F.col("gap_diff"), F.col("gap_relation")

    def share(name: str) -> Column:
        return ratio(F.sum((relation == name).cast("long")), F.count(relation))

    return [
        F.count("*").alias("n"),
        F.avg(d).alias("me"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        share("overestimate").alias("p_overestimate"),
        share("underestimate").alias("p_underestimate"),
        share("exact").alias("p_exact"),
    ]


def gap_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, absolute and squared difference and the three relations, per group.

    Needs the columns of :func:`with_pair_columns`.
    """
    return df.groupBy(*by).agg(*_difference_stats())


# Names of the overlapping override groups.
OVERRIDE_CASES = ("all", "override", "no_override")


def by_overlapping_case(
    df: DataFrame,
    flag_column: str,
    aggregates: Sequence[Column],
    by: Sequence[str] = (),
    cases: Sequence[str] = OVERRIDE_CASES,
) -> DataFrame:
    """Aggregate every row under ``all`` and under its own case.

    Rows are doubled in memory only; the partial aggregation runs before any shuffle.
    """
    if not cases or any(c not in OVERRIDE_CASES for c in cases):
        raise ValueError(f"cases must be taken from {OVERRIDE_CASES}")
    own = F.when(col(flag_column), F.lit("override")).when(
        ~col(flag_column), F.lit("no_override")
    )
    tagged = df.withColumn("override_case", F.explode(F.array(F.lit("all"), own)))
    tagged = tagged.where(F.col("override_case").isin(list(cases)))
    return tagged.groupBy("override_case", *by).agg(*aggregates)


def gap_stats_by_override(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return by_overlapping_case(df, "forced_override", _difference_stats(), by)


def flip_rates_by_override(
    df: DataFrame,
    stage1: str = "forced_stage1_obs_flip",
    stage2: str = "forced_stage2_obs_flip",
    by: Sequence[str] = (),
) -> DataFrame:
    """Stage-1 and stage-2 flip rates under all, override and no override."""

    def rate(c: str) -> Column:
        return ratio(F.sum(flag(c)), F.count(col(c)))

    return by_overlapping_case(
        df,
        "forced_override",
        [
            F.count("*").alias("n"),
            rate(stage1).alias("stage1_obs_flip_rate"),
            rate(stage2).alias("stage2_min_obs_flip_rate"),
        ],
        by,
    )


def distribution(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Count per value and its share within the group."""
    return _shares(df, list(by), x, "fraction")


def conditional_distribution(
    df: DataFrame, x: str, y: str, by: Sequence[str] = ()
) -> DataFrame:
    """P(y | x): count per pair and its share among rows of the same ``x``."""
    return _shares(df, [*by, x], y, "conditional_probability")


def _shares(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Shares by joining group totals, so that one group is never gathered in a single window.

    The counts serve twice, so they are written once if they may be large.
    """
    counts, _ = settle(df.groupBy(*keys, value).agg(F.count("*").alias("n")))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    joined = attach(counts, totals, keys)
    return joined.select(*keys, value, "n", ratio("n", "__total").alias(name))


def stage1_distribution(
    df: DataFrame, cases: Sequence[str] = ("all",), by: Sequence[str] = ()
) -> DataFrame:
    """Distribution of the exact gap for one or several stage-1 cases, which may overlap."""
    display = {"different": "diff"}
    own = F.when(F.col("stage1_weight_same"), F.lit("same")).when(
        ~F.col("stage1_weight_same"), F.lit("diff")
    )
    wanted = [display.get(c, c) for c in cases]
    tagged = df.withColumn("stage1_weight_case", F.explode(F.array(F.lit("all"), own)))
    tagged = tagged.where(F.col("stage1_weight_case").isin(wanted))
    return distribution(tagged, "logical_gap_value", ["stage1_weight_case", *by])


def density_matrix(cond: DataFrame, x: str, y: str, values: Sequence[float]) -> DataFrame:
    """Conditional distribution with one column per listed ``y`` value, absent pairs as 0."""
    return (
        cond.groupBy(x).pivot(y, list(values)).agg(F.first("conditional_probability")).fillna(0.0)
    )


def value_edges(
    df: DataFrame, value: str, by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Cell edges of sorted distinct values: midpoints, extrapolated at both ends."""
    distinct = neighbours(df, value, by, buckets)
    before, after = F.col("previous"), F.col("next")
    v = F.col(value)
    lower = F.when(before.isNotNull(), (before + v) / 2.0)
    upper = F.when(after.isNotNull(), (v + after) / 2.0)
    return distinct.select(
        *by,
        value,
        F.coalesce(lower, v - (upper - v), v - 0.5).alias("edge_low"),
        F.coalesce(upper, v + (v - lower), v + 0.5).alias("edge_high"),
    )


def net_effect(
    df: DataFrame, anchored: str, y0: str, y_star: str, by: Sequence[str] = ()
) -> DataFrame:
    """Error rates before and after reselection among trials with a negative anchored gap."""
    anc = col(anchored).cast("double")
    chosen = (F.coalesce((anc < 0) & ~F.isnan(anc), F.lit(False))).cast("long")
    sums = df.groupBy(*by).agg(
        F.coalesce(F.sum(chosen), F.lit(0)).alias("n_a"),
        F.sum(chosen * flag(y0)).alias("k0"),
        F.sum(chosen * flag(y_star)).alias("k1"),
    )
    p0, p1 = ratio("k0", "n_a"), ratio("k1", "n_a")
    return sums.select(
        *by,
        "n_a",
        p0.alias("p_y0_given_a"),
        p1.alias("p_ystar_given_a"),
        (p1 - p0).alias("net_decision_effect"),
    )


def conditional_block(
    df: DataFrame, w0: str, w2: str, y0: str, y2: str, by: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Counts and rates around a negative anchored gap, each with a Wilson interval.

    Trials with NULL or NaN in a needed column are excluded and counted.  ``consistency_ok`` checks
    the law of total probability.
    """
    usable = known(w0) & known(w2) & col(y0).isNotNull() & col(y2).isNotNull()
    gap = F.when(usable, col(w2) - col(w0))
    neg, zero, pos = gap < 0, gap == 0, gap >= 0
    first, second = col(y0).cast("boolean"), col(y2).cast("boolean")

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(usable & c, F.lit(False)).cast("long")), F.lit(0))

    t = df.groupBy(*by).agg(
        F.count("*").alias("n_loaded"),
        count(F.lit(True)).alias("n_total"),
        count(neg).alias("n_neg"),
        count(zero).alias("n_zero"),
        count(pos).alias("n_pos"),
        count(first).alias("n_y0"),
        count(first & neg).alias("n_y0_neg"),
        count(first & pos).alias("n_y0_pos"),
        count(second & neg).alias("n_y2_neg"),
    )
    rates = {
        "q": ("n_neg", "n_total"),
        "eps": ("n_y0", "n_total"),
        "eps_minus": ("n_y0_neg", "n_neg"),
        "eps_plus": ("n_y0_pos", "n_pos"),
        "concentration": ("n_y0_neg", "n_y0"),
        "p_y2_given_neg": ("n_y2_neg", "n_neg"),
    }
    columns: list[Column] = []
    for name, (k, n) in rates.items():
        columns += [
            ratio(k, n).alias(name),
            wilson_low(k, n, alpha).alias(f"{name}_ci_low"),
            wilson_high(k, n, alpha).alias(f"{name}_ci_high"),
        ]
    out = t.select(
        *by,
        "n_loaded",
        (F.col("n_loaded") - F.col("n_total")).alias("n_excluded"),
        "n_total",
        "n_neg",
        "n_zero",
        "n_pos",
        *columns,
    )
    lhs = F.col("q") * F.col("eps_minus") + (F.lit(1.0) - F.col("q")) * F.col("eps_plus")
    return out.withColumns(
        {
            "consistency_lhs": lhs,
            "consistency_rhs": F.col("eps"),
            "consistency_ok": F.coalesce(
                F.abs(lhs - F.col("eps")) <= F.lit(1e-9) + F.lit(1e-9) * F.abs(F.col("eps")),
                F.lit(False),
            ),
        }
    )
