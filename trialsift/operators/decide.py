"""From candidate solutions of a trial to its decision, gap and diagnostics.

A candidate table holds, per trial (``keys``): ``stage`` (0 baseline, 1 forced, 2 reweighted),
``obs_idx``, ``weight``, ``logical`` (class as array of booleans), ``converged`` and optionally
``stat``.  The best candidate and its best rival of another class come from per-class minima, which
are aggregated before any shuffle; the two best classes per trial are kept by a rank filter that
Spark applies on both sides of the shuffle.  Gaps keep NaN and infinities as sentinels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.functions.exprs import clip_prior, col, prior_weight
from trialsift.plans.ranges import attach
from trialsift.session import settle_table

INF, NAN = float("inf"), float("nan")


def _none() -> Column:
    return F.array().cast("array<int>")


def flip_indices(a: str | Column, b: str | Column) -> Column:
    """Indices at which two class arrays differ."""
    b_ = col(b)
    marked = F.transform(col(a), lambda x, i: F.when(x != F.get(b_, i), i))
    return F.filter(marked, lambda i: i.isNotNull()).cast("array<int>")


def _sentinel(unconverged: str | None, negative: float) -> Column:
    if unconverged not in (None, "positive", "negative"):
        raise ValueError("unconverged must be 'positive', 'negative' or None")
    return F.lit(INF if unconverged == "positive" else negative)


def _baseline(cands: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    fields = ["weight", "logical", "converged", *(["stat"] if "stat" in cands.columns else [])]
    base = F.max(F.when(F.col("stage") == 0, F.struct(*fields)))
    forced = (F.col("stage") == 1) & F.col("converged")
    return cands.groupBy(*keys).agg(
        base.alias("base"), F.sum(forced.cast("long")).alias("n_forced_converged"), *extra
    )


def _with_winner(cands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with the winner of their trial: lightest converged, then earlier stage and index.

    A trial has few candidates.  The aggregation that follows uses the partitioning of this window,
    so a decision takes one exchange and no join.
    """
    order = F.struct("weight", "stage", "obs_idx", "logical")
    winner = F.min(F.when(F.col("converged"), order)).over(Window.partitionBy(*keys))
    return cands.withColumn("__win", winner)


def _two_classes() -> list[Column]:
    """Winner and the lightest converged weight of another class, over :func:`_with_winner`."""
    win = F.max("__win")
    rival = F.col("converged") & (F.col("logical") != F.col("__win.logical"))
    return [
        win["weight"].alias("win_weight"),
        win["logical"].alias("win_logical"),
        F.min(F.when(rival, F.col("weight"))).alias("rival_weight"),
    ]


def reselect_gap(
    cands: DataFrame,
    keys: Sequence[str] = ("shot_id",),
    unconverged: str | None = None,
    rival_missing: float = NAN,
    convergence_aware: bool = True,
) -> DataFrame:
    """Decision by the lightest converged candidate; gap to the lightest one of another class.

    Baseline not converged: gap 0, forced error.  No converged alternative: +inf for ``positive``,
    else 0 (only if ``convergence_aware``).  No candidate of another class: ``rival_missing``.
    """
    keys = list(keys)
    t = _baseline(_with_winner(cands, keys), keys, *_two_classes())
    ok = F.col("base.converged")
    alone = F.lit(convergence_aware) & (F.col("n_forced_converged") == 0)
    gap = (
        F.when(~ok, F.lit(0.0))
        .when(alone, _sentinel(unconverged, 0.0))
        .when(F.col("rival_weight").isNull(), F.lit(float(rival_missing)))
        .otherwise(F.col("rival_weight") - F.col("win_weight"))
    )
    predicted = F.when(ok, F.col("win_logical")).otherwise(F.col("base.logical"))
    return t.select(
        *keys,
        gap.alias("gap"),
        predicted.alias("logical"),
        (~ok).alias("forced_error"),
        F.when(ok, flip_indices("base.logical", "win_logical")).otherwise(_none()).alias("flips"),
        F.col("base.weight").alias("base_weight"),
        F.col("base.logical").alias("base_logical"),
        "n_forced_converged",
    )


def fixed_gap(cands: DataFrame, keys: Sequence[str] = ("shot_id",)) -> DataFrame:
    """The reselecting gap under its fixed convention: +inf without a converged rival."""
    return reselect_gap(cands, keys, "positive", rival_missing=INF)


def anchored_gap(
    cands: DataFrame,
    keys: Sequence[str] = ("shot_id",),
    unconverged: str | None = None,
    convergence_aware: bool = True,
) -> DataFrame:
    """Lightest converged forced candidate minus the baseline; the baseline's decision stays.

    Baseline not converged: -inf, forced error.  No converged alternative: +inf for ``positive``,
    else -inf; NaN for a solver without a notion of convergence.
    """
    keys = list(keys)
    nothing = _sentinel(unconverged, -INF) if convergence_aware else F.lit(NAN)
    eligible = (F.col("stage") == 1) & F.col("converged") & (F.col("weight") < F.lit(INF))
    best = F.min(F.when(eligible, F.struct("weight", "obs_idx", "logical"))).alias("best")
    t = _baseline(cands, keys, best)
    ok, found = F.col("base.converged"), F.col("best").isNotNull()
    gap = (
        F.when(~ok, F.lit(-INF))
        .when(~found, nothing)
        .otherwise(F.col("best.weight") - F.col("base.weight"))
    )
    flips = F.when(ok & found, flip_indices("base.logical", "best.logical")).otherwise(_none())
    return t.select(
        *keys,
        gap.alias("gap"),
        F.col("base.logical").alias("logical"),
        (~ok).alias("forced_error"),
        flips.alias("flips"),
        F.col("base.weight").alias("base_weight"),
        F.when(ok, F.col("best.weight")).alias("forced_weight"),
        F.when(ok, F.col("best.logical")).alias("forced_logical"),
        "n_forced_converged",
    )


def reweighted_gap(
    cands: DataFrame,
    keys: Sequence[str] = ("shot_id",),
    unconverged: str | None = None,
    convergence_aware: bool = True,
) -> DataFrame:
    """Anchored gap with one more, unconstrained candidate from reweighted priors (stage 2).

    In the baseline's class and lighter, it replaces the baseline's weight; in another class it
    joins the alternatives.
    """
    keys = list(keys)
    nothing = _sentinel(unconverged, -INF) if convergence_aware else F.lit(NAN)
    eligible = (F.col("stage") == 1) & F.col("converged")
    best = F.min(F.when(eligible, F.struct("weight", "obs_idx", "logical"))).alias("best")
    extra = F.max(
        F.when(F.col("stage") == 2, F.struct("weight", "logical", "converged"))
    ).alias("extra")
    t = _baseline(cands, keys, best, extra)
    ok, have = F.col("base.converged"), F.col("best").isNotNull()
    usable = F.coalesce(F.col("extra.converged"), F.lit(False))
    same = usable & (F.col("extra.logical") == F.col("base.logical"))
    other = usable & ~same
    w1, wr = F.col("base.weight"), F.col("extra.weight")
    constrained = F.coalesce(F.col("best.weight"), F.lit(INF))
    reference = F.when(same & (wr < w1), wr).otherwise(w1)
    second = F.when(other, F.least(constrained, wr)).otherwise(constrained)
    gap = (
        F.when(~ok, F.lit(-INF))
        .when(~have & ~other, nothing)
        .otherwise(second - reference)
    )
    flips = (
        F.when(ok & have, flip_indices("base.logical", "best.logical"))
        .when(ok & other, flip_indices("base.logical", "extra.logical"))
        .otherwise(_none())
    )
    return t.select(
        *keys,
        gap.alias("gap"),
        F.col("base.logical").alias("logical"),
        (~ok).alias("forced_error"),
        flips.alias("flips"),
    )


def agreement_accept(
    rounds: DataFrame, criterion: str, keys: Sequence[str] = ("shot_id",)
) -> DataFrame:
    """Accept a trial whose repeated decodes agree with round 0.

    ``PEC`` compares corrections (sets of items), ``LEC`` classes.  An empty first correction is
    accepted; a first round that did not converge is rejected and forced to be an error.  All
    rounds agree exactly when the least and the greatest value coincide: one aggregation.
    """
    if criterion not in ("PEC", "LEC"):
        raise ValueError("criterion must be 'PEC' or 'LEC'")
    keys = list(keys)
    value = F.array_sort("correction") if criterion == "PEC" else F.col("logical")
    t = rounds.groupBy(*keys).agg(
        F.max(
            F.when(
                F.col("round") == 0,
                F.struct("converged", F.size("correction").alias("size"), "logical"),
            )
        ).alias("first"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )
    ok = F.col("first.converged")
    accepted = ok & ((F.col("first.size") == 0) | (F.col("least") == F.col("most")))
    return t.select(
        *keys,
        accepted.alias("accept"),
        (~ok).alias("forced_error"),
        F.col("first.logical").alias("logical"),
    )


def reweight_priors(
    items: DataFrame,
    b: float,
    kind: str = "Ratio",
    keys: Sequence[str] = ("shot_id",),
    prior: str = "prior",
) -> DataFrame:
    """New prior of every chosen item: ``p^b``, or ``p * exp(-(ln p / sum ln p) * b)``, clipped."""
    p = col(prior)
    if kind == "Ratio":
        return items.withColumn("new_prior", clip_prior(F.pow(p, F.lit(float(b)))))
    if kind != "Gap":
        raise ValueError("kind must be 'Ratio' or 'Gap'")
    keys = list(keys)
    totals = items.groupBy(*keys).agg(F.sum(F.log(p)).alias("__total"))
    checked = F.when(
        F.col("__total") == 0, F.raise_error(F.lit("ln p of the correction is zero")).cast("double")
    ).otherwise(F.col("__total"))
    scaled = p * F.exp(-(F.log(p) / checked) * F.lit(float(b)))
    return (
        items.join(totals, keys).withColumn("new_prior", clip_prior(scaled)).drop("__total")
    )


def solution_weights(
    items: DataFrame, priors: DataFrame, keys: Sequence[str] = ("shot_id",), item: str = "error_id"
) -> DataFrame:
    """Sum of ln((1-p)/p) over the chosen items of each solution."""
    table = settle_table(priors.select(item, prior_weight("prior").alias("__w")))
    joined = items.select(*keys, item).join(table, item)
    return joined.groupBy(*keys).agg(F.sum("__w").alias("weight"))


def logical_class(
    items: DataFrame,
    obs_edges: DataFrame,
    n_observables: int,
    keys: Sequence[str] = ("shot_id",),
    item: str = "error_id",
) -> DataFrame:
    """Parity per observable of the chosen items, as an array of booleans.

    Counts are taken per solution and observable first, so a solution's list has at most one entry
    per observable.
    """
    keys = list(keys)
    counts = (
        items.select(*keys, item)
        .join(settle_table(obs_edges.select(item, "observable_id")), item, "left")
        .groupBy(*keys, "observable_id")
        .agg((F.count("*") % 2).alias("parity"))
    )
    odd = counts.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("parity") == 1, F.col("observable_id").cast("int"))).alias("odd")
    )
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(n_observables - 1)), lambda i: F.array_contains("odd", i)
    )
    return odd.select(*keys, bits.alias("logical"))


def label_errors(predicted: str | Column, truth: str | Column, override=None) -> Column:
    """True where any predicted class bit differs from the truth, or where overridden."""
    wrong = F.coalesce(col(predicted) != col(truth), F.lit(False))
    return wrong if override is None else wrong | F.coalesce(col(override), F.lit(False))


def case_label(
    cands: DataFrame, truth: DataFrame, keys: Sequence[str] = ("shot_id",)
) -> DataFrame:
    """Failure case of a reselected decision; ``truth`` has one row per trial.

    -1 baseline right and kept; 0 no right solution; 1 rescued; 2 a right alternative was missed;
    3 baseline right but overridden.  All alternatives count as such, converged or not; a baseline
    that did not converge stays -1.
    """
    keys = list(keys)
    decided = reselect_gap(cands, keys).join(truth.select(*keys, "truth"), keys)
    # A trial has a right alternative if its truth is among its alternatives' classes.
    right = (
        truth.select(*keys, F.col("truth").alias("logical"))
        .join(cands.where(F.col("stage") >= 1).select(*keys, "logical"), [*keys, "logical"], "left_semi")
        .select(*keys, F.lit(True).alias("alt_right"))
    )
    t = decided.join(right, keys, "left")
    base_wrong = F.col("base_logical") != F.col("truth")
    final_wrong = F.col("logical") != F.col("truth")
    case = (
        F.when(F.col("forced_error"), F.lit(-1))
        .when(base_wrong & F.col("alt_right").isNull(), F.lit(0))
        .when(base_wrong & ~final_wrong, F.lit(1))
        .when(base_wrong, F.lit(2))
        .when(F.col("base_logical") != F.col("logical"), F.lit(3))
        .otherwise(F.lit(-1))
    )
    return t.select(*keys, case.cast("byte").alias("case"))


def case_from_summary(before: str | Column, after: str | Column) -> Column:
    """Case rebuilt from the labels before and after reselection: ``-1``, ``1``, ``3``, ``0+2``."""
    b, a = col(before), col(after)
    return (
        F.when(~b & ~a, F.lit("-1"))
        .when(b & ~a, F.lit("1"))
        .when(~b & a, F.lit("3"))
        .when(b & a, F.lit("0+2"))
    )


def candidate_summary(
    cands: DataFrame, truth: DataFrame | None = None, keys: Sequence[str] = ("shot_id",)
) -> DataFrame:
    """Baseline, best and second-best forced candidate, and the spread of their statistic.

    Missing weights are NULL, missing flips false.  Mean, population deviation and maximum are over
    the known statistics of all forced candidates.  Nothing is reported beyond the baseline where
    it did not converge.
    """
    keys = list(keys)
    forced = F.col("stage") == 1
    known_stat = forced & F.col("stat").isNotNull() & ~F.isnan("stat")
    stat = F.when(known_stat, F.col("stat"))
    t = _baseline(
        cands,
        keys,
        F.avg(stat).alias("mean_stat"),
        F.stddev_pop(stat).alias("std_stat"),
        F.max(stat).alias("max_stat"),
    )
    place = Window.partitionBy(*keys).orderBy("weight", "obs_idx")
    two = (
        cands.where(forced & F.col("converged"))
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= 2)
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("place") == i, F.struct("weight", "logical", "stat"))).alias(name)
                for i, name in ((1, "best"), (2, "second"))
            ]
        )
    )
    t = t.join(two, keys, "left")
    if truth is not None:
        t = t.join(truth.select(*keys, "truth"), keys, "left")
    ok = F.col("base.converged")

    def flip(c: str) -> Column:
        if truth is None:
            return F.lit(False)
        return F.coalesce(F.col(f"{c}.logical") != F.col("truth"), F.lit(False))

    def given(c: str) -> Column:
        return F.when(ok, F.col(c))

    return t.select(
        *keys,
        F.col("base.weight").alias("stage1_weight"),
        flip("base").alias("stage1_obs_flip"),
        given("best.weight").alias("stage2_weight"),
        (ok & flip("best")).alias("stage2_obs_flip"),
        given("second.weight").alias("stage2_2ndbest_weight"),
        (ok & flip("second")).alias("stage2_2ndbest_obs_flip"),
        F.col("base.stat").alias("baseline_stat"),
        given("best.stat").alias("forced_stat"),
        given("second.stat").alias("forced_2nd_best_stat"),
        given("mean_stat").alias("forced_mean_stat"),
        given("std_stat").alias("forced_std_stat"),
        given("max_stat").alias("forced_max_stat"),
        "n_forced_converged",
    )


def cluster_norm(
    clusters: DataFrame,
    weights: DataFrame,
    alpha: float = 2.0,
    keys: Sequence[str] = ("shot_id",),
) -> DataFrame:
    """Concentration of cluster weights: alpha-norm of the cluster sums over the total weight.

    ``clusters``: keys, ``cluster_id``, ``bits``, ``active``, ``absorbed_by`` (-1 if not absorbed).
    ``weights``: ``error_id``, ``weight``.  Trials without a final cluster get 0; ``alpha`` may be
    infinite (largest cluster).
    """
    keys = list(keys)
    ok = ~F.isnan("weight") & (F.abs("weight") < F.lit(INF))
    total = weights.where(ok).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("__total"))
    final = F.col("active") & (F.coalesce("absorbed_by", F.lit(-1)) == -1)
    bits = clusters.where(final).select(*keys, "cluster_id", F.explode("bits").alias("error_id"))
    sums = (
        bits.join(settle_table(weights), "error_id")
        .groupBy(*keys, "cluster_id")
        .agg(F.sum("weight").alias("s"))
        .where(~F.isnan("s") & (F.abs("s") < F.lit(INF)))
    )
    if math.isinf(alpha):
        norm = F.max("s")
    else:
        norm = F.pow(F.sum(F.pow("s", F.lit(float(alpha)))), F.lit(1.0 / alpha))
    per_trial = sums.groupBy(*keys).agg(norm.alias("norm"))
    trials = clusters.select(*keys).distinct().join(per_trial, keys, "left")
    value = F.when(F.col("__total") == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.col("norm") / F.col("__total"), F.lit(0.0))
    )
    return attach(trials, total, []).select(*keys, value.alias("q"))


def best_of_ensemble(
    cands: DataFrame, keys: Sequence[str] = ("shot_id",), member: str = "member"
) -> DataFrame:
    """Lightest candidate per trial, the first member on ties."""
    rest = [c for c in cands.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("weight", member))
    return cands.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def mean_unit_vector(
    vectors: DataFrame, vector: str, by: Sequence[str] = ()
) -> DataFrame:
    """Mean of the L2-normalised vectors per group, one row per component.

    A zero vector adds nothing but counts in the divisor.  Components are averaged without
    gathering a group's vectors in one place.
    """
    v = F.transform(col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    unit = F.transform(v, lambda x: F.when(F.col("__norm") > 0, x / F.col("__norm")).otherwise(0.0))
    rows = vectors.select(*by, vector, norm.alias("__norm")).select(*by, unit.alias("u"))
    return (
        rows.select(*by, F.posexplode("u").alias("idx", "x"))
        .groupBy(*by, "idx")
        .agg((F.sum("x") / F.count("*")).alias("mean"))
    )


def check_consistency(df: DataFrame, strict: bool = True) -> DataFrame:
    """Compare a baseline run with a forced run of the same class.

    Needs ``baseline_converged``, ``forced_converged``, ``baseline_logical``, ``forced_logical``.
    Either run not converged: ``forced_error``.  Both converged but different classes is a
    violation: an error when the row is read if ``strict``, else a flag.
    """
    both = F.col("baseline_converged") & F.col("forced_converged")
    bad = both & (F.col("baseline_logical") != F.col("forced_logical"))
    out = df.withColumn("forced_error", ~both)
    if not strict:
        return out.withColumn("violation", bad)
    message = F.concat(
        F.lit("forced class differs from baseline class: "),
        F.to_json(F.struct("baseline_logical", "forced_logical")),
    )
    return out.withColumn(
        "forced_error",
        F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.col("forced_error")),
    )
