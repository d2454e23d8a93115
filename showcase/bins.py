"""Binned and per-value rates, histograms, fits and transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from showcase.common import (
    LINES,
    PAIRS,
    SHOTS,
    div,
    lines,
    num,
    pairs,
    plain,
    rate_sql,
    shots,
    table,
    wilson,
)
from showcase.curves import DOCS, docs
from trialsift.functions.exprs import DB_FACTOR
from trialsift.operators import bins as B

QUERIES: dict[str, tuple] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (lambda spark, sf, run=run: plain(run(spark, sf)), sql)


def rounded(df, digits: int = 7, *columns: str):
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def edge(i: str, n: int) -> str:
    return f"(CASE WHEN {i} = {n} THEN hi ELSE lo + ({i}) * ((hi - lo) / {num(n)}) END)"


def bin_expr(x: str, n: int, clamp: bool = True) -> str:
    """Bin of x between lo and hi: the last edge not above it."""
    guess = f"least(greatest(CAST(floor(({x} - lo) / ((hi - lo) / {num(n)})) AS BIGINT), -1), {n})"
    g = f"(CASE WHEN {x} >= hi THEN {n} WHEN {x} < lo THEN -1 ELSE {guess} END)"
    fixed = (
        f"(CASE WHEN {g} IN (-1, {n}) THEN {g} WHEN {x} < {edge(g, n)} THEN {g} - 1 "
        f"WHEN {x} >= {edge(f'({g} + 1)', n)} THEN {g} + 1 ELSE {g} END)"
    )
    return f"greatest(least({fixed}, {n - 1}), 0)" if clamp else fixed


def uniform_sql(cte: str, source: str, x: str, ok: str, n: int, out: str, by: str = "",
                lo_hi: tuple | None = None) -> str:
    """Binned counts k and n with every bin, then the given output columns."""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    span = (
        f"SELECT {lead} min({x}) AS lo, max({x}) AS hi FROM {source} {group}"
        if lo_hi is None
        else f"SELECT DISTINCT {lead} {num(lo_hi[0])} AS lo, {num(lo_hi[1])} AS hi FROM {source}"
    )
    using = f"JOIN span USING ({by})" if by else ", span"
    join = f"USING ({by}, bin)" if by else "USING (bin)"
    return f"""WITH {cte}, span AS ({span}),
      cells AS (SELECT {lead} {bin_expr(x, n)} AS bin, count(*) AS n, sum(({ok})::INT) AS k
        FROM {source} {using} GROUP BY ALL),
      grid AS (SELECT {lead} lo, hi, unnest(range({n})) AS bin FROM span),
      f AS (SELECT {lead} lo, hi, bin, coalesce(k, 0) AS k, coalesce(n, 0) AS n
        FROM grid LEFT JOIN cells {join})
      SELECT {lead} bin, {edge('bin', n)} AS bin_low, {edge('(bin + 1)', n)} AS bin_high,
        0.5e0 * ({edge('bin', n)} + {edge('(bin + 1)', n)}) AS bin_center, {out} FROM f"""


add(
    "bin_rate",
    lambda s, d: B.bin_rate(shots(s, d), "score", "is_error", 25, ["grp"]),
    uniform_sql(SHOTS, "shots", "score", "is_error", 25, rate_sql("k", "n"), "grp"),
)
add(
    "bin_rate_clamped_range_fixed_total",
    lambda s, d: B.bin_rate(
        shots(s, d), "score", "is_error", 12, x_range=(20.0, 140.0), n_total=10000
    ),
    uniform_sql(SHOTS, "shots", "score", "is_error", 12, rate_sql("k", "10000"), lo_hi=(20, 140)),
)
EDGES = [0.0, 5.0, 10.0, 25.0, 40.0, 50.0]
add(
    "bin_rate_given_edges",
    lambda s, d: B.bin_rate(lines(s, d), "score", "is_error", EDGES, ["l_linenumber"]),
    f"""WITH {LINES}, cells AS (SELECT l_linenumber, greatest(least(
        {' + '.join(f'(score >= {num(e)})::INT' for e in EDGES)} - 1, {len(EDGES) - 2}), 0) AS bin,
        count(*) AS n, sum(is_error::INT) AS k FROM lines GROUP BY ALL),
      e(bin, a, b) AS (VALUES {', '.join(f'({i}, {num(EDGES[i])}, {num(EDGES[i + 1])})' for i in range(len(EDGES) - 1))}),
      f AS (SELECT g.l_linenumber, e.*, coalesce(k, 0) AS k, coalesce(n, 0) AS n
        FROM (SELECT DISTINCT l_linenumber FROM lines) g CROSS JOIN e
        LEFT JOIN cells USING (l_linenumber, bin))
      SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(bin AS BIGINT) AS bin, a AS bin_low,
        b AS bin_high, 0.5e0 * (a + b) AS bin_center, {rate_sql('k', 'n')} FROM f""",
)
add(
    "value_rate",
    lambda s, d: B.value_rate(lines(s, d), "score", "is_error", ["is_open"]),
    f"""WITH {LINES} SELECT is_open, score AS value,
      {rate_sql('sum(is_error::INT)', 'count(*)')} FROM lines GROUP BY is_open, score""",
)
DENSITY = (
    "CAST(k AS BIGINT) AS count, CAST(t AS BIGINT) AS total, "
    f"{div('k', 't')} AS rate, {wilson('k', 't', False)} AS ci_low, {wilson('k', 't', True)} AS ci_high, "
    f"{wilson('k', 't', False)} * t AS count_low, {wilson('k', 't', True)} * t AS count_high"
)
add(
    "histogram_density",
    lambda s, d: B.histogram(shots(s, d), "score", 20),
    "SELECT bin, bin_low, bin_high, bin_center, " + DENSITY + " FROM (SELECT *, sum(k) OVER () AS t FROM ("
    + uniform_sql(SHOTS, "shots", "score", "true", 20, "k") + "))",
)
add(
    "score_distribution_by_error",
    lambda s, d: B.score_distribution(
        pairs(s, d), ["logical_gap", "forced_gap_ml"], "forced_is_logical_error",
        separate_error=True, negative=True, db=True, digits=3,
    ),
    f"""WITH {PAIRS}, u AS (SELECT 'logical_gap' AS metric, forced_is_logical_error, logical_gap AS x FROM pairs
        UNION ALL SELECT 'forced_gap_ml', forced_is_logical_error, forced_gap_ml FROM pairs)
      SELECT metric, forced_is_logical_error,
        round((CASE WHEN forced_is_logical_error THEN -x ELSE x END) * {num(DB_FACTOR)}, 3) AS value,
        count(*) AS count FROM u GROUP BY ALL""",
)


def with_inf(s, d):
    return shots(s, d).withColumn(
        "score", F.when(F.col("shot_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("score"))
    )


add(
    "sentinel_counts",
    lambda s, d: B.sentinel_counts(with_inf(s, d), "score", "is_error", ["grp"]),
    f"""WITH {SHOTS}, c AS (SELECT grp, CAST(sum((shot_id % 11 = 0)::INT) AS BIGINT) AS n_inf,
        CAST(sum((shot_id % 11 = 0 AND is_error)::INT) AS BIGINT) AS n_inf_error FROM shots GROUP BY grp)
      SELECT grp, n_inf, n_inf_error, n_inf - n_inf_error AS n_inf_ok,
        {div('n_inf_error', 'n_inf')} AS inf_error_rate FROM c""",
)
add(
    "unique_values",
    lambda s, d: B.unique_values(lines(s, d), "score", "is_error", negative=True),
    f"""WITH {LINES} SELECT DISTINCT CASE WHEN is_error THEN -score ELSE score END AS value FROM lines""",
)
add(
    "accept_rate",
    lambda s, d: B.accept_rate(docs(s, d), "ok", ["lang", "source"]),
    f"""WITH {DOCS} SELECT lang, source, {rate_sql('sum(ok::INT)', 'count(*)')}
      FROM docs GROUP BY lang, source""",
)
add(
    "accept_rate_numeric",
    lambda s, d: B.accept_rate(table(s, d, "labels"), "quality"),
    f"SELECT {rate_sql('sum((quality > 0.5)::INT)', 'count(*)')} FROM labels",
)
add(
    "conditional_rate_by_value_sign_split",
    lambda s, d: B.conditional_rate(
        pairs(s, d).withColumn("g", F.col("forced_stage2_weight") - F.col("forced_stage1_weight")),
        "g", "forced_is_logical_error", by=["logical_decoder"], sign_split=True,
    ),
    f"""WITH {PAIRS}, g AS (SELECT *, forced_stage2_weight - forced_stage1_weight AS g FROM pairs)
      SELECT logical_decoder, CASE WHEN g > 0 THEN 'pos' ELSE 'neg' END AS sign_group, g AS value,
        {rate_sql('sum(forced_is_logical_error::INT)', 'count(*)')} FROM g GROUP BY ALL""",
)
add(
    "conditional_rate_by_bin",
    lambda s, d: B.conditional_rate(shots(s, d), "score", "is_error", 15, ["event_type"]),
    uniform_sql(SHOTS, "shots", "score", "is_error", 15, rate_sql("k", "n"), "event_type"),
)
FIT_IN = "WITH b AS (" + uniform_sql(
    SHOTS, "shots", "score", "is_error", 30, rate_sql("k", "n"), "grp"
) + """), p AS (SELECT grp, bin_center AS g, ln((1e0 - rate) / rate) AS z,
    CASE WHEN ci_low > 0 AND ci_high < 1 THEN ln((1e0 - ci_high) / ci_high) END AS z_low,
    CASE WHEN ci_low > 0 AND ci_high < 1 THEN ln((1e0 - ci_low) / ci_low) END AS z_high
  FROM b WHERE rate > 0 AND rate < 1)"""


def _fit_rates(s, d):
    return B.bin_rate(shots(s, d), "score", "is_error", 30, ["grp"])


add(
    "logit_points",
    lambda s, d: rounded(B.logit_points(_fit_rates(s, d), "bin_center", ["grp"]), 9),
    FIT_IN + " SELECT grp, round(g, 9) AS g, round(z, 9) AS z, round(z_low, 9) AS z_low, "
    "round(z_high, 9) AS z_high FROM p",
)
FIT = """, f AS (SELECT grp, count(*) AS n_points, regr_slope(z, g) AS slope,
    regr_intercept(z, g) AS intercept, min(g) AS g_min, max(g) AS g_max FROM p GROUP BY grp),
  r AS (SELECT *, CASE WHEN g_max <= 0 THEN g_min * 1.5e0 ELSE g_min END AS g_low,
    CASE WHEN g_max <= 0 THEN g_max ELSE g_max * 1.5e0 END AS g_high FROM f)"""
add(
    "logit_fit",
    lambda s, d: rounded(B.logit_fit(_fit_rates(s, d), by=["grp"]), 7),
    FIT_IN + FIT + """ SELECT grp, n_points, round(slope, 7) AS slope, round(intercept, 7) AS intercept,
      round(g_low, 7) AS g_low, round(g_high, 7) AS g_high FROM r""",
)
add(
    "logit_fit_line",
    lambda s, d: rounded(B.fit_line(B.logit_fit(_fit_rates(s, d), by=["grp"]), 40, ["grp"]), 7),
    FIT_IN + FIT + """, l AS (SELECT *, g_low + i * ((g_high - g_low) / 39e0) AS g
        FROM (SELECT *, unnest(range(40)) AS i FROM r))
      SELECT grp, round(g, 7) AS g, round(slope * g + intercept, 7) AS z,
        round(1e0 / (1e0 + exp(slope * g + intercept)), 7) AS rate FROM l""",
)


def heat_sql(nx: int, ny: int, xr: str, yr: str) -> str:
    bx = bin_expr("x", nx, False).replace("lo", "xl").replace("hi", "xh")
    by = bin_expr("y", ny, False).replace("lo", "yl").replace("hi", "yh")
    bx, by = bx.replace("fxlor", "floor"), by.replace("fylor", "floor")

    def e(i, n, a):
        return edge(i, n).replace("lo", f"{a}l").replace("hi", f"{a}h")

    return f"""WITH {PAIRS}, v AS (SELECT forced_stage1_weight AS x, forced_stage2_weight AS y,
        forced_is_logical_error AS e FROM pairs),
      span AS (SELECT {xr}, {yr} FROM v),
      c AS (SELECT least({bx}, {nx - 1}) AS bin_x, least({by}, {ny - 1}) AS bin_y, xl, xh, yl, yh,
        count(*) AS n, CAST(sum(e::INT) AS BIGINT) AS n_err FROM v, span
        WHERE x BETWEEN xl AND xh AND y BETWEEN yl AND yh GROUP BY ALL)
      SELECT bin_x, bin_y, {e('bin_x', nx, 'x')} AS x_low, {e('(bin_x + 1)', nx, 'x')} AS x_high,
        {e('bin_y', ny, 'y')} AS y_low, {e('(bin_y + 1)', ny, 'y')} AS y_high, n, n_err,
        round(log10(n), 10) AS log10_n, {div('n_err', 'n')} AS error_rate FROM c"""


add(
    "histogram2d",
    lambda s, d: rounded(
        B.histogram2d(
            pairs(s, d), "forced_stage1_weight", "forced_stage2_weight", "forced_is_logical_error",
            (20, 15),
        ), 10, "log10_n",
    ),
    heat_sql(20, 15, "min(x) AS xl, max(x) AS xh", "min(y) AS yl, max(y) AS yh"),
)
add(
    "histogram2d_ranges_drop_outside",
    lambda s, d: rounded(
        B.histogram2d(
            pairs(s, d), "forced_stage1_weight", "forced_stage2_weight", "forced_is_logical_error",
            (10, 10), x_range=(5.0, 60.0), y_range=(10.0, 50.0),
        ), 10, "log10_n",
    ),
    heat_sql(10, 10, "5e0 AS xl, 60e0 AS xh", "10e0 AS yl, 50e0 AS yh").replace(
        "span AS (SELECT 5e0 AS xl, 60e0 AS xh, 10e0 AS yl, 50e0 AS yh FROM v)",
        "span AS (SELECT 5e0 AS xl, 60e0 AS xh, 10e0 AS yl, 50e0 AS yh)",
    ),
)
CHANGE = """CASE WHEN forced_stage1_obs_flip AND NOT forced_is_logical_error THEN 'fixed'
  WHEN NOT forced_stage1_obs_flip AND forced_is_logical_error THEN 'broken'
  WHEN forced_stage1_obs_flip THEN 'both_wrong' ELSE 'both_correct' END"""


def transition_sql(axis: str, source: str = PAIRS) -> str:
    """``source`` may leave scores NULL: such trials count in the denominator and come last."""
    x = (
        "forced_gap_ml"
        if axis == "gap_value"
        else "CAST(count(*) OVER (ORDER BY forced_gap_ml NULLS LAST) AS DOUBLE) / count(*) OVER ()"
    )
    inner = (
        source
        + f""", ax AS (SELECT {x} AS x, {CHANGE} AS category,
            forced_stage2_weight < forced_stage1_weight AS chosen FROM pairs),
          sub AS (SELECT x, category FROM ax WHERE chosen)"""
    )
    n = 8
    return f"""WITH {inner}, span AS (SELECT min(x) AS lo, max(x) AS hi FROM sub),
      cells AS (SELECT {bin_expr('x', n)} AS bin, category, count(*) AS k FROM sub, span GROUP BY ALL),
      tot AS (SELECT bin, sum(k) AS t FROM cells GROUP BY bin),
      cats(category) AS (VALUES ('fixed'), ('broken'), ('both_wrong'), ('both_correct')),
      grid AS (SELECT lo, hi, bin, category FROM (SELECT lo, hi, unnest(range({n})) AS bin FROM span), cats),
      f AS (SELECT grid.*, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM grid
        LEFT JOIN cells USING (bin, category) LEFT JOIN tot USING (bin))
      SELECT bin, {edge('bin', n)} AS bin_low, {edge('(bin + 1)', n)} AS bin_high,
        0.5e0 * ({edge('bin', n)} + {edge('(bin + 1)', n)}) AS bin_center, category,
        CAST(k AS BIGINT) AS count, CAST(t AS BIGINT) AS n_bin, {div('k', 't')} AS fraction,
        {wilson('k', 't', False)} AS ci_low, {wilson('k', 't', True)} AS ci_high FROM f"""


def _transitions(s, d, scale):
    p = pairs(s, d).withColumn("anc", F.col("forced_stage2_weight") - F.col("forced_stage1_weight"))
    return B.transitions(
        p, "forced_gap_ml", "anc", "forced_stage1_obs_flip", "forced_is_logical_error", 8, scale
    )


add(
    "transitions_by_gap",
    lambda s, d: _transitions(s, d, "gap_value"),
    transition_sql("gap_value"),
)
add(
    "transitions_by_abort_rate",
    lambda s, d: _transitions(s, d, "abort_rate"),
    transition_sql("abort_rate"),
)
# Some trials have no forced gap (NaN where there is no rival class, NULL where it was not recorded).
MISSING = PAIRS.replace("pairs AS (", "whole AS (") + """, pairs AS (SELECT * EXCLUDE (forced_gap_ml),
  CASE WHEN shot_id % 5 < 2 THEN NULL ELSE forced_gap_ml END AS forced_gap_ml FROM whole)"""


def _transitions_missing(s, d):
    gap = F.when(F.col("shot_id") % 5 == 0, F.lit(float("nan"))).when(F.col("shot_id") % 5 > 1, F.col("forced_gap_ml"))
    p = pairs(s, d).withColumn("forced_gap_ml", gap)
    p = p.withColumn("anc", F.col("forced_stage2_weight") - F.col("forced_stage1_weight"))
    return B.transitions(
        p, "forced_gap_ml", "anc", "forced_stage1_obs_flip", "forced_is_logical_error", 8, "abort_rate"
    )


add("transitions_with_missing_scores", _transitions_missing, transition_sql("abort_rate", MISSING))
CASES = "cs(\"case\") AS (VALUES (-1), (0), (1), (2), (3))"
add(
    "case_counts",
    lambda s, d: B.case_counts(pairs(s, d), "case_label", by=["logical_decoder"]),
    f"""WITH {PAIRS}, {CASES}, g AS (SELECT logical_decoder, count(*) AS total FROM pairs GROUP BY 1),
      c AS (SELECT logical_decoder, case_label AS "case", count(*) AS n FROM pairs GROUP BY ALL)
      SELECT g.logical_decoder, CAST(cs."case" AS BIGINT) AS "case", coalesce(n, 0) AS n, total,
        coalesce({div('n', 'total')}, 0) AS fraction
      FROM g CROSS JOIN cs LEFT JOIN c ON c.logical_decoder = g.logical_decoder AND c."case" = cs."case" """,
)
_CASE_SUMS = ", ".join(
    f"CAST(sum((case_label = {c})::INT) AS BIGINT) AS case_{n}"
    for c, n in ((-1, "neg1"), (0, "0"), (1, "1"), (2, "2"), (3, "3"))
)
add(
    "case_by_gap",
    lambda s, d: B.case_by_gap(pairs(s, d), "forced_gap_ml", "case_label"),
    f"WITH {PAIRS} SELECT forced_gap_ml AS gap_bin, {_CASE_SUMS} FROM pairs GROUP BY 1",
)
add(
    "case_by_gap_normalized",
    lambda s, d: B.case_by_gap(pairs(s, d), "logical_gap", "case_label", normalize=True),
    f"""WITH {PAIRS}, c AS (SELECT logical_gap AS gap_bin, {_CASE_SUMS} FROM pairs GROUP BY 1)
      SELECT gap_bin, case_neg1, {', '.join(f"coalesce({div(f'case_{c}', 'case_0 + case_1 + case_2 + case_3')}, 0) AS case_{c}" for c in range(4))} FROM c""",
)
add(
    "split_histogram",
    lambda s, d: B.split_histogram(
        pairs(s, d).withColumn("lin", F.col("forced_stage2_weight") - F.col("forced_stage1_weight")),
        "lin", "case_label", "logical_gap", "forced_is_logical_error", width=4,
    ),
    f"""WITH {PAIRS}, v AS (SELECT CASE WHEN forced_stage2_weight - forced_stage1_weight > 0 THEN 'above'
          WHEN case_label >= 0 THEN 'case ' || case_label END AS series,
        floor((CASE WHEN forced_is_logical_error THEN -logical_gap ELSE logical_gap END) / 4e0) * 4 AS x FROM pairs),
      c AS (SELECT series, x, count(*) AS n FROM v WHERE series IS NOT NULL GROUP BY ALL)
      SELECT series, x, n, {div('n', 'sum(n) OVER (PARTITION BY series)')} AS fraction FROM c""",
)
add(
    "override_probability",
    lambda s, d: B.override_probability(
        pairs(s, d).withColumn("lin", F.col("forced_stage2_weight") - F.col("forced_stage1_weight")),
        "lin", ["logical_gap", "forced_gap_ml"], inclusive=False,
    ),
    f"""WITH {PAIRS}, u AS (SELECT 'logical_gap' AS gap, logical_gap AS x,
          forced_stage2_weight < forced_stage1_weight AS ev FROM pairs
        UNION ALL SELECT 'forced_gap_ml', forced_gap_ml, forced_stage2_weight < forced_stage1_weight FROM pairs)
      SELECT gap, x AS value, {rate_sql('sum(ev::INT)', 'count(*)')} FROM u GROUP BY gap, x""",
)
add(
    "outcome_series",
    lambda s, d: B.outcome_series(
        pairs(s, d), "forced_gap_ml", "forced_stage1_obs_flip", "forced_stage2_obs_flip"
    ),
    f"""WITH {PAIRS} SELECT CASE WHEN NOT forced_stage2_obs_flip THEN 'stage2_correct'
        WHEN forced_stage1_obs_flip THEN 'error' ELSE 'no_error' END AS series,
      forced_gap_ml AS value, count(*) AS count FROM pairs GROUP BY ALL""",
)
