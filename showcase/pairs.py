"""Pair agreement, overlapping groups, accepted and rejected sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from showcase.bins import rounded
from showcase.common import DERIVED, PAIRS, SHOTS, div, num, pairs, plain, shots, table, wilson
from showcase.curves import KEPT, RANK_IN, RATES, rates_cte
from trialsift.operators import pairs as P
from trialsift.operators import ranking as R

QUERIES: dict[str, tuple] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (lambda spark, sf, run=run: plain(run(spark, sf)), sql)


def derived(s, d):
    return P.with_override(P.with_pair_columns(pairs(s, d)))


D = f"WITH {PAIRS}, {DERIVED}"

add(
    "pair_columns",
    lambda s, d: derived(s, d).select(
        "shot_id", "gap_diff", "stage1_weight_same", "logical_gap_signed", "forced_gap_signed",
        "gap_relation", "forced_override", "anchored_gap",
    ),
    D + """ SELECT shot_id, gap_diff, stage1_weight_same, logical_gap_signed, forced_gap_signed,
      gap_relation, forced_override, anchored_gap FROM derived""",
)
add(
    "stage1_different_pairs",
    lambda s, d: P.stage1_case(derived(s, d), "diff").select("shot_id", "gap_diff"),
    D + " SELECT shot_id, gap_diff FROM derived WHERE NOT stage1_weight_same",
)


def _scores(s, d):
    p = pairs(s, d)
    a = p.select("shot_id", "batch", "logical_gap", F.col("logical_is_logical_error").alias("is_logical_error"))
    b = p.select("shot_id", "batch", "forced_gap_ml", F.col("forced_is_logical_error").alias("is_logical_error"))
    return a, b


add(
    "join_scores",
    lambda s, d: P.join_scores(*_scores(s, d)),
    f"""WITH {PAIRS} SELECT shot_id, batch, logical_gap, forced_gap_ml,
      logical_is_logical_error AS is_logical_error_x, forced_is_logical_error AS is_logical_error_y
      FROM pairs""",
)
add(
    "join_many_scores",
    lambda s, d: P.join_many(
        [
            *[x.drop("is_logical_error") for x in _scores(s, d)],
            pairs(s, d).select("shot_id", "batch", "forced_stage1_weight"),
        ],
        ["shot_id", "batch"],
    ),
    f"WITH {PAIRS} SELECT shot_id, batch, logical_gap, forced_gap_ml, forced_stage1_weight FROM pairs",
)
add(
    "rerank_by_exact_gap",
    lambda s, d: P.rerank(_scores(s, d)[1], _scores(s, d)[0], "forced_gap_ml", "logical_gap"),
    f"""WITH {PAIRS} SELECT shot_id, batch, logical_gap AS forced_gap_ml,
      forced_is_logical_error AS is_logical_error FROM pairs""",
)
add(
    "case_scatter",
    lambda s, d: P.case_scatter(
        pairs(s, d).select("shot_id", "batch", "forced_gap_ml", "case_label"),
        pairs(s, d).select("shot_id", "batch", "logical_gap"),
        "case_label", [0, 2, 3],
    ),
    f"""WITH {PAIRS} SELECT shot_id, batch, forced_gap_ml, case_label, logical_gap FROM pairs
      WHERE case_label IN (0, 2, 3)""",
)
add(
    "concordance",
    lambda s, d: rounded(
        P.concordance(pairs(s, d), "logical_gap", "forced_gap_ml", ["logical_decoder"]), 9
    ),
    f"""WITH {PAIRS}, m AS (SELECT logical_decoder, count(*) AS n,
        covar_pop(logical_gap, forced_gap_ml) AS c, var_pop(logical_gap) AS vx,
        var_pop(forced_gap_ml) AS vy, avg(logical_gap) - avg(forced_gap_ml) AS dm FROM pairs GROUP BY 1)
      SELECT logical_decoder, n, round(2 * c / (vx + vy + dm * dm), 9) AS ccc FROM m""",
)
add(
    "over_under_confidence",
    lambda s, d: P.over_under(pairs(s, d), "logical_gap", "forced_gap_ml", "logical_is_logical_error"),
    f"""WITH {PAIRS}, u AS (SELECT 'overall' AS subset, * FROM pairs UNION ALL
        SELECT CASE WHEN logical_is_logical_error THEN 'logical_error' ELSE 'non_logical_error' END, *
        FROM pairs), c AS (SELECT subset, count(*) AS n,
        sum((abs(forced_gap_ml) > abs(logical_gap))::INT) AS o,
        sum((abs(forced_gap_ml) < abs(logical_gap))::INT) AS w FROM u GROUP BY 1)
      SELECT subset, n, {div('o', 'n')} AS p_overconfident, {div('w', 'n')} AS p_underconfident,
        {div('n - o - w', 'n')} AS p_equal FROM c""",
)
STATS = f"""count(*) AS n, round(avg(gap_diff), 9) AS me, round(avg(abs(gap_diff)), 9) AS mae,
  round(sqrt(avg(gap_diff * gap_diff)), 9) AS rmse,
  {div("sum((gap_relation = 'overestimate')::INT)", 'count(*)')} AS p_overestimate,
  {div("sum((gap_relation = 'underestimate')::INT)", 'count(*)')} AS p_underestimate,
  {div("sum((gap_relation = 'exact')::INT)", 'count(*)')} AS p_exact"""
ROUND3 = ("me", "mae", "rmse")
add(
    "gap_stats_by_decoder",
    lambda s, d: rounded(
        P.gap_stats(derived(s, d), ["logical_decoder", "forced_decoder"]), 9, *ROUND3
    ),
    D + f" SELECT logical_decoder, forced_decoder, {STATS} FROM derived GROUP BY 1, 2",
)
add(
    "gap_stats_by_exact_value",
    lambda s, d: rounded(
        P.gap_stats(P.stage1_case(derived(s, d)), ["logical_decoder", "logical_gap_value"]), 9, *ROUND3
    ),
    D + f""" SELECT logical_decoder, logical_gap AS logical_gap_value, {STATS} FROM derived
      WHERE stage1_weight_same GROUP BY 1, 2""",
)
CASED = D + """, u AS (SELECT 'all' AS override_case, * FROM derived UNION ALL SELECT
    CASE WHEN forced_override THEN 'override' ELSE 'no_override' END, * FROM derived)"""
add(
    "gap_stats_by_override",
    lambda s, d: rounded(P.gap_stats_by_override(derived(s, d), ["logical_decoder"]), 9, *ROUND3),
    CASED + f" SELECT override_case, logical_decoder, {STATS} FROM u GROUP BY 1, 2",
)
add(
    "flip_rates_by_override",
    lambda s, d: P.flip_rates_by_override(derived(s, d), by=["logical_decoder"]),
    CASED + f""" SELECT override_case, logical_decoder, count(*) AS n,
      {div('sum(forced_stage1_obs_flip::INT)', 'count(*)')} AS stage1_obs_flip_rate,
      {div('sum(forced_stage2_obs_flip::INT)', 'count(*)')} AS stage2_min_obs_flip_rate
      FROM u GROUP BY 1, 2""",
)
add(
    "stage1_gap_distribution",
    lambda s, d: P.stage1_distribution(derived(s, d), ["all", "same", "different"], ["logical_decoder"]),
    D + f""", u AS (SELECT 'all' AS stage1_weight_case, * FROM derived UNION ALL SELECT
        CASE WHEN stage1_weight_same THEN 'same' ELSE 'diff' END, * FROM derived),
      c AS (SELECT stage1_weight_case, logical_decoder, logical_gap AS logical_gap_value,
        count(*) AS n FROM u GROUP BY ALL)
      SELECT *, {div('n', 'sum(n) OVER (PARTITION BY stage1_weight_case, logical_decoder)')} AS fraction
      FROM c""",
)
add(
    "conditional_gap_distribution",
    lambda s, d: P.conditional_distribution(
        derived(s, d), "logical_gap_signed", "forced_gap_signed", ["logical_decoder"]
    ),
    D + f""", c AS (SELECT logical_decoder, logical_gap_signed, forced_gap_signed, count(*) AS n
        FROM derived GROUP BY ALL)
      SELECT *, {div('n', 'sum(n) OVER (PARTITION BY logical_decoder, logical_gap_signed)')}
        AS conditional_probability FROM c""",
)
add(
    "conditional_matrix",
    lambda s, d: P.density_matrix(
        P.conditional_distribution(derived(s, d), "logical_gap", "case_label"),
        "logical_gap", "case_label", [-1, 0, 1, 2, 3],
    ).withColumnsRenamed({"-1": "c_neg1", "0": "c_0", "1": "c_1", "2": "c_2", "3": "c_3"}),
    D + f""" SELECT logical_gap, {', '.join(f"{div(f'sum((case_label = {c})::INT)', 'count(*)')} AS c_{n}" for c, n in ((-1, 'neg1'), (0, '0'), (1, '1'), (2, '2'), (3, '3')))}
      FROM derived GROUP BY 1""",
)
add(
    "value_edges",
    lambda s, d: P.value_edges(pairs(s, d), "forced_stage1_weight", ["logical_decoder"]),
    f"""WITH {PAIRS}, v AS (SELECT DISTINCT logical_decoder, forced_stage1_weight AS v FROM pairs),
      e AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM v
        WINDOW w AS (PARTITION BY logical_decoder ORDER BY v)),
      m AS (SELECT *, CASE WHEN a IS NOT NULL THEN (a + v) / 2e0 END AS lo,
        CASE WHEN b IS NOT NULL THEN (v + b) / 2e0 END AS hi FROM e)
      SELECT logical_decoder, v AS forced_stage1_weight,
        coalesce(lo, v - (hi - v), v - 0.5e0) AS edge_low, coalesce(hi, v + (v - lo), v + 0.5e0) AS edge_high
      FROM m""",
)
add(
    "net_decision_effect",
    lambda s, d: P.net_effect(
        derived(s, d), "anchored_gap", "forced_stage1_obs_flip", "forced_is_logical_error",
        ["logical_decoder"],
    ),
    D + f""", c AS (SELECT logical_decoder, count(*) AS n, sum(forced_stage1_obs_flip::INT) AS a,
        sum(forced_is_logical_error::INT) AS b FROM derived WHERE anchored_gap < 0 GROUP BY 1)
      SELECT logical_decoder, n AS n_a, {div('a', 'n')} AS p_y0_given_a, {div('b', 'n')} AS p_ystar_given_a,
        {div('b', 'n')} - {div('a', 'n')} AS net_decision_effect FROM c""",
)
BLOCK = {
    "q": ("nn", "n"), "eps": ("y", "n"), "eps_minus": ("yn", "nn"), "eps_plus": ("yp", "np"),
    "concentration": ("yn", "y"), "p_y2_given_neg": ("y2", "nn"),
}
add(
    "conditional_block",
    lambda s, d: rounded(
        P.conditional_block(
            derived(s, d).withColumn(
                "w2", F.when(F.col("shot_id") % 13 != 0, F.col("forced_stage2_weight"))
            ),
            "forced_stage1_weight", "w2", "forced_stage1_obs_flip", "forced_stage2_obs_flip",
            ["logical_decoder"],
        ), 12, "consistency_lhs",
    ),
    D + f""", u AS (SELECT *, shot_id % 13 <> 0 AS ok FROM derived),
      c AS (SELECT logical_decoder, count(*) AS n_loaded, sum(ok::INT) AS n,
        sum((ok AND anchored_gap < 0)::INT) AS nn, sum((ok AND anchored_gap = 0)::INT) AS nz,
        sum((ok AND anchored_gap >= 0)::INT) AS np, sum((ok AND forced_stage1_obs_flip)::INT) AS y,
        sum((ok AND forced_stage1_obs_flip AND anchored_gap < 0)::INT) AS yn,
        sum((ok AND forced_stage1_obs_flip AND anchored_gap >= 0)::INT) AS yp,
        sum((ok AND forced_stage2_obs_flip AND anchored_gap < 0)::INT) AS y2 FROM u GROUP BY 1)
      SELECT logical_decoder, n_loaded, CAST(n_loaded - n AS BIGINT) AS n_excluded, CAST(n AS BIGINT) AS n_total,
        CAST(nn AS BIGINT) AS n_neg, CAST(nz AS BIGINT) AS n_zero, CAST(np AS BIGINT) AS n_pos,
        {', '.join(f'{div(k, n)} AS {name}, {wilson(k, n, False)} AS {name}_ci_low, {wilson(k, n, True)} AS {name}_ci_high' for name, (k, n) in BLOCK.items())},
        round({div('nn', 'n')} * {div('yn', 'nn')} + (1e0 - {div('nn', 'n')}) * {div('yp', 'np')}, 12) AS consistency_lhs,
        {div('y', 'n')} AS consistency_rhs, true AS consistency_ok FROM c""",
)
SCORES = D + """, sc AS (SELECT shot_id, logical_gap AS score_exact_gap, forced_gap_ml AS score_forced_gap,
    anchored_gap AS score_anchored_gap,
    forced_gap_ml - 0.5e0 * greatest(forced_stage1_weight - forced_stage2_weight, 0)
      AS score_forced_gap_override_penalty,
    least(forced_gap_ml, anchored_gap) AS score_hybrid_min_forced_anchor,
    forced_gap_ml - logical_gap AS margin, NOT stage1_weight_same AS stage1_weight_different FROM derived)"""
add(
    "ranking_scores",
    lambda s, d: R.with_ranking_scores(derived(s, d), 0.5).select(
        "shot_id", "score_exact_gap", "score_forced_gap", "score_anchored_gap",
        "score_forced_gap_override_penalty", "score_hybrid_min_forced_anchor", "margin",
        "stage1_weight_different",
    ),
    SCORES + " SELECT * FROM sc",
)
ORDER = ["batch", "shot_id"]
add(
    "accepted_overlap",
    lambda s, d: R.accepted_overlap(pairs(s, d), "logical_gap", "forced_gap_ml", RATES, ORDER),
    f"""WITH {RANK_IN}, {rates_cte(RATES)}, {KEPT},
      c AS (SELECT abort_rate, k.n, kept, sum((r_exact <= kept AND r_forced <= kept)::INT) AS b,
        sum((r_exact <= kept AND r_forced > kept)::INT) AS x,
        sum((r_exact > kept AND r_forced <= kept)::INT) AS f FROM r, k GROUP BY ALL)
      SELECT abort_rate, 'logical_gap' AS exact_score, 'forced_gap_ml' AS comparison_score,
        n AS n_total, kept AS n_accepted, CAST(b AS BIGINT) AS both_accept,
        CAST(x AS BIGINT) AS exact_only, CAST(f AS BIGINT) AS forced_only,
        CAST(n - b - x - f AS BIGINT) AS both_reject, {div('f', 'n')} AS forced_only_fraction,
        {div('x', 'n')} AS exact_only_fraction, {div('x + f', 'n')} AS symmetric_difference_fraction,
        coalesce({div('x + f', 'b + x + f')}, 0) AS jaccard_distance,
        {div('f', 'kept')} AS forced_only_among_forced_accepted,
        {div('x', 'kept')} AS exact_only_among_exact_accepted FROM c""",
)
add(
    "accept_rank",
    lambda s, d: __import__("trialsift.plans.ranges", fromlist=["x"]).accept_rank(
        shots(s, d).withColumn("score", F.floor("score").cast("double")), "score", ["batch", "shot_id"], buckets=64
    ).select("shot_id", "rank"),
    f"""WITH {SHOTS} SELECT shot_id, row_number() OVER (ORDER BY floor(score) DESC, batch, shot_id) AS rank
      FROM shots""",
)
FLAGS = ["stage1_weight_same", "forced_override", "forced_stage1_obs_flip"]
FALSE_SAFE = f"""{RANK_IN.replace(PAIRS, PAIRS + ', ' + DERIVED)}, {rates_cte(RATES)}, {KEPT},
  fs AS (SELECT abort_rate, derived.*, forced_gap_ml - logical_gap AS margin FROM k, r JOIN derived USING (shot_id)
    WHERE r_exact > kept AND r_forced <= kept)"""


def _ranked(s, d):
    return R.with_ranking_scores(derived(s, d))


add(
    "false_safe_decomposition",
    lambda s, d: R.false_safe(
        _ranked(s, d), "score_exact_gap", "score_forced_gap", RATES, ORDER, FLAGS,
        "forced_is_logical_error",
        {"mean_exact_gap": "logical_gap", "mean_forced_gap": "forced_gap_ml",
         "mean_margin": "margin", "mean_anchored_gap": "anchored_gap"},
    ),
    f"""WITH {FALSE_SAFE}, g AS (SELECT abort_rate, {', '.join(FLAGS)}, count(*) AS n,
        {div('sum(forced_is_logical_error::INT)', 'count(*)')} AS logical_error_rate,
        sum(logical_gap) / count(*) AS mean_exact_gap, sum(forced_gap_ml) / count(*) AS mean_forced_gap,
        sum(margin) / count(*) AS mean_margin, sum(anchored_gap) / count(*) AS mean_anchored_gap
        FROM fs GROUP BY ALL)
      SELECT *, {div('n', 'sum(n) OVER (PARTITION BY abort_rate)')} AS fraction_within_forced_only,
        CAST(sum(n) OVER (PARTITION BY abort_rate) AS BIGINT) AS n_forced_only FROM g""",
)
IND = {
    "stage-1 weight different": "stage1_weight_different",
    "override": "forced_override",
    "stage1 logical error": "forced_stage1_obs_flip",
    "stage2 logical error": "forced_stage2_obs_flip",
    "stage2 second-best logical error": "forced_stage2_2ndbest_obs_flip",
}
add(
    "false_safe_indicators",
    lambda s, d: R.false_safe_indicators(
        _ranked(s, d), "score_exact_gap", "score_forced_gap", RATES, ORDER, IND
    ),
    f"""WITH {FALSE_SAFE}, z AS (SELECT *, NOT stage1_weight_same AS stage1_weight_different FROM fs),
      u AS ({' UNION ALL '.join(f"SELECT abort_rate, '{n}' AS indicator, {c} AS f FROM z" for n, c in IND.items())}),
      c AS (SELECT abort_rate, indicator, count(*) AS n, sum(f::INT) AS k FROM u GROUP BY ALL),
      i(indicator) AS (VALUES {', '.join(f"('{n}')" for n in IND)})
      SELECT rates.abort_rate, i.indicator, {div('k', 'n')} AS fraction,
        coalesce(n, 0) AS n_forced_only FROM rates CROSS JOIN i LEFT JOIN c USING (abort_rate, indicator)""",
)


def sets_sql(thresholds: str, where: str = "true", flag: str = "CAST(NULL AS BOOLEAN)") -> str:
    return D + f""", x AS (SELECT * FROM derived WHERE {where}), tot AS (SELECT count(*) AS nt FROM x),
      t AS ({thresholds}), c AS (SELECT threshold,
        sum((logical_gap <= threshold AND forced_gap_ml <= threshold)::INT) AS b,
        sum((logical_gap <= threshold AND forced_gap_ml > threshold)::INT) AS o,
        sum((logical_gap > threshold AND forced_gap_ml <= threshold)::INT) AS u FROM x, t GROUP BY 1),
      l AS (SELECT threshold, 'both_rejected' AS set_name, 'Both rejected' AS set_label, b AS n, b, o, u FROM c
        UNION ALL SELECT threshold, 'overconfident', 'Overconfident', o, b, o, u FROM c
        UNION ALL SELECT threshold, 'underconfident', 'Underconfident', u, b, o, u FROM c)
      SELECT threshold, set_name, set_label, CAST(n AS BIGINT) AS n, nt AS n_total,
        CAST(b + u AS BIGINT) AS forced_reject_total, CAST(b + o AS BIGINT) AS logical_reject_total,
        {flag} AS error_filter, {div('n', 'b + u')} AS fraction_of_forced_reject,
        {div('n', 'nt')} AS fraction_of_all FROM l, tot"""


add(
    "threshold_sets",
    lambda s, d: R.threshold_sets(
        derived(s, d), "logical_gap", "forced_gap_ml", error="forced_is_logical_error", error_filter=True
    ),
    sets_sql("SELECT DISTINCT logical_gap AS threshold FROM x", "forced_is_logical_error", "true"),
)
TS = [-2.0, 0.0, 5.0, 12.5, 29.0]
add(
    "threshold_sets_given",
    lambda s, d: R.threshold_sets(derived(s, d), "logical_gap", "forced_gap_ml", TS),
    sets_sql(f"SELECT unnest([{', '.join(num(t) for t in TS)}]) AS threshold"),
)
add(
    "threshold_set_cases",
    lambda s, d: R.threshold_set_cases(
        derived(s, d), "logical_gap", "forced_gap_ml",
        R.stage_categories("stage1_weight_same", "forced_override"), "forced_is_logical_error",
    ),
    D + f""", t AS (SELECT DISTINCT logical_gap AS threshold FROM derived),
      m AS (SELECT threshold, CASE WHEN logical_gap <= threshold AND forced_gap_ml <= threshold THEN 'both_rejected'
          WHEN logical_gap <= threshold THEN 'overconfident'
          WHEN forced_gap_ml <= threshold THEN 'underconfident' END AS set_name,
        CASE WHEN stage1_weight_same THEN 'stage1_same_weight' WHEN forced_override
          THEN 'stage1_different_weight_override' ELSE 'stage1_different_weight_no_override' END AS category,
        forced_is_logical_error AS e FROM derived, t),
      c AS (SELECT threshold, set_name, category, count(*) AS n, sum(e::INT) AS k FROM m GROUP BY ALL),
      grid AS (SELECT threshold, set_name, category FROM t,
        (SELECT unnest(['both_rejected', 'overconfident', 'underconfident']) AS set_name) a,
        (SELECT unnest(['stage1_same_weight', 'stage1_different_weight_override',
          'stage1_different_weight_no_override']) AS category) b),
      f AS (SELECT grid.*, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM grid
        LEFT JOIN c USING (threshold, set_name, category))
      SELECT threshold, set_name, category, n,
        CAST(sum(n) OVER (PARTITION BY threshold, set_name) AS BIGINT) AS n_set,
        {div('n', 'sum(n) OVER (PARTITION BY threshold, set_name)')} AS fraction_within_set,
        {div('k', 'n')} AS error_rate FROM f""",
)
