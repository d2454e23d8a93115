"""Accepted sets of two scores at matched abort rates, and rejected sets at matched thresholds.

Accepted sets are nested over the rates, so each trial carries one small level per score.  The
comparison of all rates is then a single aggregation over pairs of levels; no row-level join or
sort of the whole table takes place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift.functions.exprs import col, flag, half_even, known, ratio
from trialsift.functions.registry import SET_LABELS, check_rates
from trialsift.operators.curves import sums_at_thresholds
from trialsift.plans.ranges import NestedSets, attach, cumulative
from trialsift.session import settle


def with_ranking_scores(
    df: DataFrame,
    penalty: float = 1.0,
    exact: str = "logical_gap",
    forced: str = "forced_gap_ml",
    stage1: str = "forced_stage1_weight",
    stage2: str = "forced_stage2_weight",
) -> DataFrame:
    """The five ranking scores of a two-stage pair, the margin and the stage flags."""
    anchored = col(stage2) - col(stage1)
    amount = F.greatest(col(stage1) - col(stage2), F.lit(0.0))
    out = df.withColumns(
        {
            "score_exact_gap": col(exact),
            "score_forced_gap": col(forced),
            "score_anchored_gap": anchored,
            "score_forced_gap_override_penalty": col(forced) - F.lit(float(penalty)) * amount,
            "score_hybrid_min_forced_anchor": F.least(col(forced), anchored),
            "forced_override": amount > 0,
            "margin": col(forced) - col(exact),
            "anchored_gap": anchored,
        }
    )
    if "stage1_weight_same" in df.columns:
        out = out.withColumn("stage1_weight_different", ~F.col("stage1_weight_same"))
    return out


def accepted_overlap(
    df: DataFrame,
    exact: str,
    comparison: str,
    abort_rates: Sequence[float],
    order: Sequence[str],
    buckets: int | None = None,
) -> DataFrame:
    """Agreement of the two accepted sets at every abort rate."""
    rates = check_rates(abort_rates)
    df, buckets = settle(df.select(*dict.fromkeys([exact, comparison, *order])), buckets)
    n_total = df.count()
    sets = NestedSets(rates, n_total)
    levels = sets.with_levels(df, {"__le": exact, "__lc": comparison}, order, buckets)
    # Both sets of a rate have the same size, so the size of the intersection says it all.
    cells = levels.groupBy(F.least("__le", "__lc").alias("level")).agg(F.count("*").alias("both"))
    t = sets.totals(cells, ["both"])
    n, kept, both = F.lit(n_total).cast("long"), F.col("kept"), F.col("both")
    only = kept - both
    union = kept + only
    return t.select(
        "abort_rate",
        F.lit(exact).alias("exact_score"),
        F.lit(comparison).alias("comparison_score"),
        n.alias("n_total"),
        kept.alias("n_accepted"),
        both.alias("both_accept"),
        only.alias("exact_only"),
        only.alias("forced_only"),
        (n - union).alias("both_reject"),
        ratio(only, n).alias("forced_only_fraction"),
        ratio(only, n).alias("exact_only_fraction"),
        ratio(only * 2, n).alias("symmetric_difference_fraction"),
        F.coalesce(ratio(only * 2, union), F.lit(0.0)).alias("jaccard_distance"),
        ratio(only, kept).alias("forced_only_among_forced_accepted"),
        ratio(only, kept).alias("exact_only_among_exact_accepted"),
    )


def _comparison_only(
    df: DataFrame,
    exact: str,
    comparison: str,
    abort_rates: Sequence[float],
    order: Sequence[str],
    keys: Sequence[str],
    measures: Mapping[str, Column],
    buckets: int | None,
) -> tuple[NestedSets, DataFrame]:
    """Sums over rows accepted by the comparison score only, per rate and ``keys``.

    Rows are aggregated by their pair of levels first; only that table is spread over the rates.
    """
    rates = check_rates(abort_rates)
    rows = df.select(
        *dict.fromkeys([exact, comparison, *order, *keys]),
        *[c.alias(m) for m, c in measures.items()],
    )
    rows, buckets = settle(rows, buckets)
    sets = NestedSets(rates, rows.count())
    pairs = sets.with_levels(rows, {"__le": exact, "__lc": comparison}, order, buckets)
    grouped = (
        pairs.where(F.col("__lc") > F.col("__le"))
        .groupBy(*keys, "__le", "__lc")
        .agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in measures])
    )
    points = F.filter(
        sets.points(), lambda p: (p["need"] > F.col("__le")) & (p["need"] <= F.col("__lc"))
    )
    spread = grouped.withColumn("__p", F.explode(points)).withColumn(
        "abort_rate", F.col("__p.rate")
    )
    return sets, spread


def false_safe(
    df: DataFrame,
    exact: str,
    comparison: str,
    abort_rates: Sequence[float],
    order: Sequence[str],
    group_by: Sequence[str],
    error: str,
    means: Mapping[str, str],
    buckets: int | None = None,
) -> DataFrame:
    """Trials accepted by the comparison score only, grouped by flags.

    ``means`` maps output names to the columns averaged in each group.
    """
    measures = {"n_err": flag(error), "n_lab": col(error).isNotNull().cast("long")}
    for name, c in means.items():
        measures[f"__s_{name}"] = col(c).cast("double")
        measures[f"__n_{name}"] = col(c).isNotNull().cast("long")
    _, spread = _comparison_only(
        df, exact, comparison, abort_rates, order, list(group_by), measures, buckets
    )
    groups = spread.groupBy("abort_rate", *group_by).agg(
        F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures]
    )
    # One row per requested rate.
    totals = F.broadcast(groups.groupBy("abort_rate").agg(F.sum("n").alias("n_forced_only")))
    return groups.join(totals, "abort_rate").select(
        "abort_rate",
        *group_by,
        "n",
        ratio("n_err", "n_lab").alias("logical_error_rate"),
        *[ratio(f"__s_{m}", f"__n_{m}").alias(m) for m in means],
        ratio("n", "n_forced_only").alias("fraction_within_forced_only"),
        "n_forced_only",
    )


def false_safe_indicators(
    df: DataFrame,
    exact: str,
    comparison: str,
    abort_rates: Sequence[float],
    order: Sequence[str],
    indicators: Mapping[str, str],
    buckets: int | None = None,
) -> DataFrame:
    """Share of each indicator among trials accepted by the comparison score only."""
    measures = {f"__i{i}": flag(c) for i, c in enumerate(indicators.values())}
    sets, spread = _comparison_only(
        df, exact, comparison, abort_rates, order, [], measures, buckets
    )
    sums = spread.groupBy("abort_rate").agg(
        F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures]
    )
    # Rates at which no trial qualifies are kept with a NULL share.
    rates = df.sparkSession.createDataFrame([(r,) for r, _ in sets.rates], "abort_rate double")
    filled = rates.join(F.broadcast(sums), "abort_rate", "left")
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("indicator"), F.col(f"__i{i}").alias("k"))
            for i, name in enumerate(indicators)
        ]
    )
    long = filled.select("abort_rate", "n", F.explode(entries).alias("__e"))
    return long.select(
        "abort_rate",
        "__e.indicator",
        ratio("__e.k", "n").alias("fraction"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_forced_only"),
    )


def _rejections(
    df: DataFrame,
    exact: str,
    forced: str,
    thresholds: Sequence[float] | None,
    categories: Mapping[str, Column],
    error: str | None,
    buckets: int | None,
) -> DataFrame:
    """Per threshold: rows with exact <= t, forced <= t, and both, in all and per category.

    Each row enters at three positions of one axis: its exact value, its forced value, and the
    larger of them, from which on both reject it.
    """
    events = F.array(
        *[
            F.struct(v.cast("double").alias("v"), F.lit(name).alias("kind"))
            for name, v in {
                "exact": col(exact),
                "forced": col(forced),
                "both": F.when(known(exact) & known(forced), F.greatest(col(exact), col(forced))),
            }.items()
        ]
    )
    cats = {"all": F.lit(True), **categories}
    marks = [F.coalesce(c, F.lit(False)).cast("long").alias(f"c_{name}") for name, c in cats.items()]
    err = flag(error).alias("err") if error else F.lit(0).cast("long").alias("err")
    rows = df.select(*marks, err, F.explode(events).alias("__e")).select("*", "__e.v", "__e.kind")
    sums: dict[str, Column] = {}
    for kind in ("exact", "forced", "both"):
        here = (F.col("kind") == kind).cast("long")
        for name in cats:
            sums[f"{kind}_{name}"] = here * F.col(f"c_{name}")
            if name != "all":
                sums[f"{kind}_{name}_err"] = here * F.col(f"c_{name}") * F.col("err")
    if thresholds is not None:
        return sums_at_thresholds(rows, "v", thresholds, sums)
    table = cumulative(rows, "v", sums, buckets=buckets).where(F.col("exact_all") > 0)
    return table.select(
        F.col("v").alias("threshold"),
        *[(F.col(f"{s}_before") + F.col(s)).alias(s) for s in sums],
    )


def _set_counts(name: str) -> dict[str, Column]:
    both = F.col(f"both_{name}")
    return {
        "both_rejected": both,
        "overconfident": F.col(f"exact_{name}") - both,
        "underconfident": F.col(f"forced_{name}") - both,
    }


def threshold_sets(
    df: DataFrame,
    exact: str,
    forced: str,
    thresholds: Sequence[float] | None = None,
    digits: int | None = None,
    error: str | None = None,
    error_filter: bool | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Sets rejected by both scores or by one of them at every threshold of the exact score."""
    rows = df.where(col(error) == F.lit(error_filter)) if error_filter is not None else df
    rows = rows.withColumns({exact: half_even(exact, digits), forced: half_even(forced, digits)})
    t = _rejections(rows, exact, forced, thresholds, {}, None, buckets)
    total = rows.agg(F.count("*").alias("n_total"))
    t = attach(t, total, [])
    entries = F.array(
        *[
            F.struct(
                F.lit(s).alias("set_name"), F.lit(SET_LABELS[s]).alias("set_label"), c.alias("n")
            )
            for s, c in _set_counts("all").items()
        ]
    )
    long = t.select(
        "threshold", "n_total", "forced_all", "exact_all", F.explode(entries).alias("__e")
    )
    return long.select(
        "threshold",
        "__e.set_name",
        "__e.set_label",
        "__e.n",
        "n_total",
        F.col("forced_all").alias("forced_reject_total"),
        F.col("exact_all").alias("logical_reject_total"),
        F.lit(error_filter).cast("boolean").alias("error_filter"),
        ratio("__e.n", "forced_all").alias("fraction_of_forced_reject"),
        ratio("__e.n", "n_total").alias("fraction_of_all"),
    )


def stage_categories(same: str, override: str) -> dict[str, Column]:
    """The three stage/override categories."""
    s, o = col(same), col(override)
    return {
        "stage1_same_weight": s,
        "stage1_different_weight_override": ~s & o,
        "stage1_different_weight_no_override": ~s & ~o,
    }


def threshold_set_cases(
    df: DataFrame,
    exact: str,
    forced: str,
    categories: Mapping[str, Column],
    error: str,
    thresholds: Sequence[float] | None = None,
    digits: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """The rejected sets crossed with categories, with the error rate of each part."""
    rows = df.withColumns({exact: half_even(exact, digits), forced: half_even(forced, digits)})
    t = _rejections(rows, exact, forced, thresholds, categories, error, buckets)
    entries = []
    for name in categories:
        counts, errors, totals = _set_counts(name), _set_counts(f"{name}_err"), _set_counts("all")
        for s in SET_LABELS:
            entries.append(
                F.struct(
                    F.lit(s).alias("set_name"),
                    F.lit(name).alias("category"),
                    counts[s].alias("n"),
                    totals[s].alias("n_set"),
                    errors[s].alias("n_err"),
                )
            )
    long = t.select("threshold", F.explode(F.array(*entries)).alias("__e"))
    return long.select(
        "threshold",
        "__e.set_name",
        "__e.category",
        "__e.n",
        "__e.n_set",
        ratio("__e.n", "__e.n_set").alias("fraction_within_set"),
        ratio("__e.n_err", "__e.n").alias("error_rate"),
    )
