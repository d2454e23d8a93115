"""Error rates and post-selection curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from showcase.common import (
    LINES,
    PAIRS,
    SHOTS,
    curve_sql,
    div,
    lines,
    num,
    pairs,
    plain,
    shots,
    table,
    wilson,
)
from trialsift.operators import curves as C

QUERIES: dict[str, tuple] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (lambda spark, sf, run=run: plain(run(spark, sf)), sql)


add(
    "error_rate",
    lambda s, d: C.error_rate(shots(s, d), "is_error", ["grp"], per_round=4),
    f"""WITH {SHOTS} SELECT grp, CAST(sum(is_error::INT) AS BIGINT) AS n_err, count(*) AS n_total,
      {div('sum(is_error::INT)', 'count(*)')} / 4e0 AS ler FROM shots GROUP BY grp""",
)


def _at(kept: str, source: str, cte: str, by: str = "", rounds: int = 1, extra: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}," if by else ""
    r = num(rounds)
    return f"""WITH {cte}, sums AS (SELECT {lead} count(*) AS n, sum(is_error::INT) AS e,
        sum(({kept})::INT) AS a, sum(({kept} AND is_error)::INT) AS k FROM {source} {group})
      SELECT {lead} 1e0 - {div('a', 'n')} AS abort_rate, {div('k', 'a')} / {r} AS post_ler,
        {wilson('k', 'a', False)} / {r} AS ci_low, {wilson('k', 'a', True)} / {r} AS ci_high,
        CAST(a AS BIGINT) AS accepted, CAST(k AS BIGINT) AS errors, n AS n_total,
        {div('e', 'n')} / {r} AS original_ler,
        ({div('k', 'a')} / {r}) / NULLIF({div('e', 'n')} / {r}, 0) AS reduction_rate {extra}
      FROM sums"""


add(
    "postselect_at_threshold",
    lambda s, d: C.postselect_at(
        shots(s, d), "score", "is_error", 60.0, "high", ["grp"], per_round=3
    ),
    _at("score >= 60", "shots", SHOTS, "grp", 3),
)
add(
    "postselect_at_threshold_low_strict",
    lambda s, d: C.postselect_at(lines(s, d), "score", "is_error", 25.0, "low", inclusive=False),
    _at("score < 25", "lines", LINES),
)
ZERO = LINES + ", centred AS (SELECT score - 25 AS score, is_error FROM lines)"
add(
    "zero_threshold_point",
    lambda s, d: C.zero_point(
        lines(s, d).withColumn("score", F.col("score") - 25), "score", "is_error"
    ),
    _at(
        "score > 0", "centred", ZERO,
        extra=f", CASE WHEN k > 0 THEN {div('k', 'a')} END AS shown_ler",
    ),
)


def unique_sql(source: str, cte: str, order: str, by: str = "", threshold: str = "score") -> str:
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    over = f"({part} ORDER BY threshold {order} ROWS UNBOUNDED PRECEDING)"
    return f"""WITH {cte}, v AS (SELECT {lead} {threshold} AS threshold, count(*) AS n,
        sum(is_error::INT) AS e FROM {source} GROUP BY {lead} 2{'' if by else ' - 1'}),
      c AS (SELECT {lead} threshold, sum(n) OVER {over} AS a, sum(e) OVER {over} AS k,
        sum(n) OVER ({part}) AS nt, sum(e) OVER ({part}) AS et FROM v)
      SELECT {lead} threshold, {curve_sql('a', 'k', 'nt', 'et')} FROM c""".replace(
        "GROUP BY  2 - 1", "GROUP BY 1"
    )


add(
    "postselect_unique",
    lambda s, d: C.postselect_unique(shots(s, d), "score", "is_error", "high"),
    unique_sql("shots", SHOTS, "DESC"),
)
add(
    "postselect_unique_low_grouped",
    lambda s, d: C.postselect_unique(shots(s, d), "score", "is_error", "low", ["grp"]),
    unique_sql("shots", SHOTS, "ASC", "grp"),
)
# The same curves over explicit value ranges, as a large input is cut.
add(
    "postselect_unique_ranges",
    lambda s, d: C.postselect_unique(lines(s, d), "score", "is_error", "high", ["is_open"], buckets=32),
    unique_sql("lines", LINES, "DESC", "is_open"),
)


def grid_sql(source: str, cte: str, grid: list[float], high: bool, by: str = "") -> str:
    """Thresholds by interpolated quantiles, then counts by comparison."""
    lead = f"{by}, " if by else ""
    qs = grid if high else [1.0 - r for r in grid]
    rows = ", ".join(f"({i}, {num(r)}, {num(q)})" for i, (r, q) in enumerate(zip(grid, qs)))
    part = f"PARTITION BY {by}" if by else ""
    on = f"AND a.{by} = s.{by}" if by else ""
    cmp_ = ">=" if high else "<="
    alias = f"s.{by}, " if by else ""
    return f"""WITH {cte}, grid(slot, target, q) AS (VALUES {rows}),
      ranked AS (SELECT {lead} score, is_error,
        row_number() OVER ({part} ORDER BY score) - 1 AS i, count(*) OVER ({part}) AS n
        FROM {source}),
      sizes AS (SELECT DISTINCT {lead} n FROM ranked),
      pos AS (SELECT {lead} slot, target, n, q * (n - 1) AS h FROM sizes, grid),
      th AS (SELECT {alias} slot, target, s.n, h - floor(h) AS t, a.score AS lo, b.score AS hi
        FROM pos s JOIN ranked a ON a.i = CAST(floor(h) AS BIGINT) {on}
        JOIN ranked b ON b.i = CAST(ceil(h) AS BIGINT) {on.replace('a.', 'b.')}),
      cut AS (SELECT {lead} slot, target, n, CASE WHEN t = 0 OR lo = hi THEN lo
        WHEN t >= 0.5 THEN hi - (hi - lo) * (1e0 - t) ELSE lo + (hi - lo) * t END AS threshold
        FROM th),
      tot AS (SELECT {lead} count(*) AS n, sum(is_error::INT) AS e FROM {source}
        {f'GROUP BY {by}' if by else ''}),
      c AS (SELECT {alias} slot, target, threshold, sum((a.score {cmp_} threshold)::INT) AS a,
        sum((a.score {cmp_} threshold AND a.is_error)::INT) AS k
        FROM cut s JOIN {source} a ON true {on} GROUP BY {alias} slot, target, threshold)
      SELECT {'c.' + by + ', ' if by else ''} CAST(slot AS BIGINT) AS slot, target, threshold,
        {curve_sql('a', 'k', 'tot.n', 'tot.e')} FROM c JOIN tot ON
        {'c.' + by + ' = tot.' + by if by else 'true'}"""


add(
    "postselect_quantiles",
    lambda s, d: C.postselect_quantiles(shots(s, d), "score", "is_error", "high", num_points=50),
    grid_sql("shots", SHOTS, C.abort_grid(50), True),
)
add(
    "postselect_quantiles_low_log",
    lambda s, d: C.postselect_quantiles(
        shots(s, d), "score", "is_error", "low", ["grp"], num_points=20, scale="log"
    ),
    grid_sql("shots", SHOTS, C.abort_grid(20, "log"), False, "grp"),
)
add(
    "postselect_quantiles_ranges",
    lambda s, d: C.postselect_quantiles(
        lines(s, d), "score", "is_error", "high", num_points=50, buckets=32
    ),
    grid_sql("lines", LINES, C.abort_grid(50), True),
)

DOCS = """docs AS (SELECT lang, source, quality = 1 AS ok, toxic = 1 AS is_error
  FROM labels JOIN documents USING (doc_id))"""


def docs(s, d):
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "source"), "doc_id").select(
        "lang", "source", (F.col("quality") == 1).alias("ok"), (F.col("toxic") == 1).alias("is_error")
    )


add(
    "postselect_sweep",
    lambda s, d: C.postselect_sweep(docs(s, d), "ok", "is_error", "lang"),
    f"""WITH {DOCS}, c AS (SELECT lang, count(*) AS n, sum(is_error::INT) AS e, sum(ok::INT) AS a,
        sum((ok AND is_error)::INT) AS k FROM docs GROUP BY lang)
      SELECT lang, {curve_sql('a', 'k', 'n', 'e')} FROM c""",
)
add(
    "postselect_separate_unconverged",
    lambda s, d: C.postselect_separate(
        shots(s, d).withColumn(
            "iteration", F.coalesce(F.col("iteration").cast("double"), F.lit(float("nan")))
        ),
        "score", "is_error", "iteration", "high", "unique",
    ),
    f"""WITH {SHOTS}, v AS (SELECT score AS threshold, count(*) AS n, sum(is_error::INT) AS e
        FROM shots WHERE iteration IS NOT NULL GROUP BY 1),
      c AS (SELECT threshold, sum(n) OVER w AS a, sum(e) OVER w AS k,
        (SELECT count(*) FROM shots) AS nt, (SELECT sum(is_error::INT) FROM shots) AS et,
        sum(e) OVER () AS ec, sum(n) OVER () AS nc
        FROM v WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
      SELECT threshold, {curve_sql('a', 'k', 'nt', 'et')},
        {div('ec', 'nc')} AS baseline_ler FROM c""",
)


def _lost(s, d):
    """Trials without an iteration have not converged."""
    nan = F.lit(float("nan"))
    return shots(s, d).withColumn("iteration", F.coalesce(F.col("iteration").cast("double"), nan))


def _separate_grid_sql(grid: list[float], high: bool, by: str) -> str:
    """Quantile grid over the converged trials, rates over all trials, baseline at the least score."""
    kept = f"{SHOTS}, kept AS (SELECT * FROM shots WHERE iteration IS NOT NULL)"
    inner = grid_sql("kept", kept, grid, high, by)
    base = "bk" if high else "lk"
    size = "bn" if high else "ln"
    return f"""WITH {SHOTS}, g AS MATERIALIZED ({inner}),
      t AS (SELECT {by}, count(*) AS nt, CAST(sum(is_error::INT) AS BIGINT) AS et, bool_or(iteration IS NULL) AS lost
        FROM shots GROUP BY {by}),
      m AS (SELECT {by}, min(score) AS least FROM shots WHERE iteration IS NOT NULL GROUP BY {by}),
      b AS (SELECT shots.{by}, count(*) AS bn, sum(is_error::INT) AS bk, sum((score = least)::INT) AS ln,
        sum((score = least AND is_error)::INT) AS lk FROM shots JOIN m ON m.{by} = shots.{by}
        WHERE iteration IS NOT NULL GROUP BY shots.{by})
      SELECT g.{by}, g.slot, g.target, g.threshold, {curve_sql('g.accepted', 'g.errors', 't.nt', 't.et')},
        CASE WHEN t.lost THEN {div(base, size)} END AS baseline_ler
      FROM g JOIN t ON t.{by} = g.{by} JOIN b ON b.{by} = g.{by}"""


add(
    "postselect_separate_continuous",
    lambda s, d: C.postselect_separate(
        _lost(s, d), "score", "is_error", "iteration", "high", "continuous", ["grp"], num_points=40
    ),
    _separate_grid_sql(C.abort_grid(40), True, "grp"),
)
add(
    "postselect_separate_continuous_low_log",
    lambda s, d: C.postselect_separate(
        _lost(s, d), "score", "is_error", "iteration", "low", "continuous", ["batch"], num_points=25, scale="log"
    ),
    _separate_grid_sql(C.abort_grid(25, "log"), False, "batch"),
)
TARGETS = [0.0, 0.1, 0.333, 0.5, 0.9]
add(
    "read_at_abort_rates",
    lambda s, d: C.read_at(
        C.postselect_unique(lines(s, d), "score", "is_error", "high"), TARGETS
    ),
    f"""WITH u AS ({unique_sql('lines', LINES, 'DESC')}),
      t(target) AS (VALUES {', '.join(f'({num(t)})' for t in TARGETS)}),
      r AS (SELECT target, u.*, row_number() OVER (PARTITION BY target
        ORDER BY abs(abort_rate - target), abort_rate) AS i FROM t, u)
      SELECT target, abort_rate, post_ler, ci_low, ci_high, accepted, errors FROM r WHERE i = 1""",
)
add(
    "reduction_rates",
    lambda s, d: C.with_reduction(
        C.postselect_unique(lines(s, d), "score", "is_error", "low", ["l_linenumber"])
    ).select("l_linenumber", "threshold", "post_ler_reduction", "ci_low_reduction", "ci_high_reduction"),
    f"""WITH u AS ({unique_sql('lines', LINES, 'ASC', 'l_linenumber')})
      SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, threshold,
        {', '.join(f'CASE WHEN errors > 0 AND original_ler > 0 THEN {c} / original_ler END AS {c}_reduction' for c in ('post_ler', 'ci_low', 'ci_high'))}
      FROM u""",
)
add(
    "second_solution_override",
    lambda s, d: C.postselect_unique(
        C.with_second_solution(
            pairs(s, d).withColumn("gap", F.col("forced_stage2_weight") - F.col("forced_stage1_weight")),
            "gap", "forced_stage1_obs_flip", "forced_stage2_obs_flip", -5.0,
        ),
        "gap", "forced_stage1_obs_flip", "high",
    ),
    unique_sql(
        "swapped",
        PAIRS
        + """, g AS (SELECT forced_stage2_weight - forced_stage1_weight AS gap, * FROM pairs),
        swapped AS (SELECT CASE WHEN gap < -5 THEN -gap ELSE gap END AS score,
          CASE WHEN gap < -5 THEN forced_stage2_obs_flip ELSE forced_stage1_obs_flip END AS is_error
          FROM g)""",
        "DESC",
    ),
)
SUBSET = PAIRS + """, sub AS (SELECT forced_gap_ml AS threshold, forced_is_logical_error AS e,
    forced_stage1_obs_flip AS b FROM pairs WHERE forced_stage2_weight < forced_stage1_weight),
  tot AS (SELECT count(*) AS n, sum(b::INT) AS b FROM sub)"""


def _subset(s, d):
    p = pairs(s, d)
    return p.withColumn("ov", F.col("forced_stage2_weight") < F.col("forced_stage1_weight"))


_SUBSET_OUT = f"""SELECT threshold, CAST(a AS BIGINT) AS n, tot.n AS n_subset, {div('a', 'tot.n')} AS fraction,
    CAST(k AS BIGINT) AS n_err, {div('k', 'a')} AS conditional_rate,
    {div('tot.b', 'tot.n')} AS baseline_rate FROM c, tot"""
add(
    "threshold_curve",
    lambda s, d: C.threshold_curve(
        _subset(s, d), "forced_gap_ml", "forced_is_logical_error", "ov", "forced_stage1_obs_flip"
    ),
    f"""WITH {SUBSET}, v AS (SELECT threshold, count(*) AS n, sum(e::INT) AS e FROM sub GROUP BY 1),
      c AS (SELECT threshold, sum(n) OVER w AS a, sum(e) OVER w AS k FROM v
        WINDOW w AS (ORDER BY threshold ROWS UNBOUNDED PRECEDING)) {_SUBSET_OUT}""",
)
GIVEN = [-1.0, 0.0, 3.5, 7.0, 12.0, 40.0]
add(
    "threshold_curve_given",
    lambda s, d: C.threshold_curve(
        _subset(s, d), "forced_gap_ml", "forced_is_logical_error", "ov", "forced_stage1_obs_flip",
        GIVEN,
    ),
    f"""WITH {SUBSET}, t(threshold) AS (VALUES {', '.join(f'({num(x)})' for x in GIVEN)}),
      c AS (SELECT t.threshold, count(sub.threshold) AS a, coalesce(sum(e::INT), 0) AS k
        FROM t LEFT JOIN sub ON sub.threshold <= t.threshold GROUP BY 1) {_SUBSET_OUT}""",
)

RATES = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999]


def kept_sql(rate: str, n: str) -> str:
    """Half-even rounding of (1 - rate) * n."""
    return f"CAST(round_even((1e0 - {rate}) * {n}, 0) AS BIGINT)"


RANK_IN = PAIRS + """, r AS (SELECT shot_id, batch, logical_is_logical_error AS le,
    forced_is_logical_error AS fe, forced_stage1_obs_flip AS y0,
    row_number() OVER (ORDER BY logical_gap DESC, batch, shot_id) AS r_exact,
    row_number() OVER (ORDER BY forced_gap_ml DESC, batch, shot_id) AS r_forced,
    row_number() OVER (ORDER BY forced_stage2_weight - forced_stage1_weight DESC, batch, shot_id)
      AS r_anc FROM pairs),
  nn AS (SELECT count(*) AS n FROM r)"""


def rates_cte(rates) -> str:
    return f"rates(abort_rate) AS (VALUES {', '.join(f'({num(x)})' for x in rates)})"


KEPT = f"k AS (SELECT abort_rate, n, {kept_sql('abort_rate', 'n')} AS kept FROM rates, nn)"
# Ties ordered by a decimal that is sometimes NULL, a date and a text.
TYPED = f"""{PAIRS}, typed AS (SELECT pairs.*, CASE WHEN shot_id % 9 = 0 THEN NULL
    ELSE CAST(o_totalprice AS DECIMAL(12, 2)) END AS price, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS word
  FROM pairs JOIN orders ON o_orderkey = shot_id)"""


def _typed(s, d):
    o = table(s, d, "orders").select(
        F.col("o_orderkey").alias("shot_id"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice").cast("decimal(12,2)")).alias("price"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("word"),
    )
    return pairs(s, d).join(o, "shot_id")


add(
    "postselect_ranked_typed_keys",
    lambda s, d: C.postselect_ranked(
        _typed(s, d), {"logical_gap": "logical_is_logical_error"}, RATES, ["word", "price", "day", "shot_id"]
    ),
    f"""WITH {TYPED}, {rates_cte(RATES)},
      r AS (SELECT logical_is_logical_error AS e, count(*) OVER () AS n, row_number() OVER (
        ORDER BY logical_gap DESC, word, price NULLS LAST, day NULLS LAST, shot_id) AS rk FROM typed),
      k AS (SELECT DISTINCT abort_rate, n, {kept_sql('abort_rate', 'n')} AS kept FROM r, rates),
      c AS (SELECT abort_rate, k.n, kept, coalesce(sum((rk <= kept AND e)::INT), 0) AS err FROM r, k GROUP BY ALL)
      SELECT 'logical_gap' AS score, 'logical_is_logical_error' AS error_source, abort_rate,
        {div('kept', 'n')} AS acceptance_rate, kept AS n_accepted, CAST(err AS BIGINT) AS n_error,
        {div('err', 'kept')} AS post_ler, {wilson('err', 'kept', False)} AS ci_low,
        {wilson('err', 'kept', True)} AS ci_high FROM c""",
)
add(
    "postselect_ranked",
    lambda s, d: C.postselect_ranked(
        pairs(s, d),
        {"logical_gap": "logical_is_logical_error", "forced_gap_ml": "forced_is_logical_error"},
        RATES, ["batch", "shot_id"],
    ),
    f"""WITH {RANK_IN}, {rates_cte(RATES)}, {KEPT},
      u AS (SELECT 'logical_gap' AS score, 'logical_is_logical_error' AS error_source, r_exact AS rk,
          le AS e FROM r UNION ALL
        SELECT 'forced_gap_ml', 'forced_is_logical_error', r_forced, fe FROM r),
      c AS (SELECT score, error_source, abort_rate, k.n, kept,
        coalesce(sum((rk <= kept AND e)::INT), 0) AS err FROM u, k GROUP BY ALL)
      SELECT score, error_source, abort_rate, {div('kept', 'n')} AS acceptance_rate,
        kept AS n_accepted, CAST(err AS BIGINT) AS n_error, {div('err', 'kept')} AS post_ler,
        {wilson('err', 'kept', False)} AS ci_low, {wilson('err', 'kept', True)} AS ci_high FROM c""",
)


def _decomposition_sql(rates: str) -> str:
    return f"""WITH {RANK_IN},
      q AS (SELECT {div('sum((forced_stage2_weight < forced_stage1_weight)::INT)', 'count(*)')} AS rm
        FROM pairs), {rates}, {KEPT},
      c AS (SELECT abort_rate, k.n, kept, sum((r_anc <= kept AND y0)::INT) AS a0,
        sum((r_forced <= kept AND y0)::INT) AS f0, sum((r_forced <= kept AND fe)::INT) AS fs
        FROM r, k GROUP BY ALL),
      o AS (SELECT abort_rate, rm AS r_minus, kept AS n_accepted, {div('a0', 'kept')} AS l_anc,
        {wilson('a0', 'kept', False)} AS l_anc_low, {wilson('a0', 'kept', True)} AS l_anc_high,
        {div('fs', 'kept')} AS l_fg,
        {wilson('fs', 'kept', False)} AS l_fg_low, {wilson('fs', 'kept', True)} AS l_fg_high,
        ({div('fs', 'n')} - {div('f0', 'n')}) / (1e0 - abort_rate) AS d_decision,
        ({div('f0', 'n')} - {div('a0', 'n')}) / (1e0 - abort_rate) AS d_ranking FROM c, q)
      SELECT *, d_decision + d_ranking AS d_total,
        CASE WHEN l_anc > 0 THEN l_fg / l_anc END AS d_total_relative FROM o"""


def _decomposition(s, d, rates=None):
    anchored = F.col("forced_stage2_weight") - F.col("forced_stage1_weight")
    return C.decompose(
        pairs(s, d).withColumn("anc", anchored),
        "anc", "forced_gap_ml", "forced_stage1_obs_flip", "forced_is_logical_error", ["batch", "shot_id"], rates,
    )


add(
    "decision_ranking_decomposition",
    lambda s, d: _decomposition(s, d, RATES),
    _decomposition_sql(rates_cte(RATES)),
)
# Rates up to twice the share of negative scores, which is one of them.
add(
    "decision_ranking_decomposition_auto_grid",
    _decomposition,
    _decomposition_sql("""top AS (SELECT rm, greatest(CASE WHEN rm > 0 THEN least(0.95e0, rm * 2e0) ELSE 0.5e0 END, 1e-3) AS top FROM q),
      rates AS (SELECT DISTINCT least(greatest(x, 0e0), 0.999999e0) AS abort_rate FROM (
        SELECT CASE WHEN i = 29 THEN top ELSE i * (top / 29e0) END AS x FROM top, range(30) t(i)
        UNION ALL SELECT rm FROM top))"""),
)
add(
    "negative_rate",
    lambda s, d: C.negative_rate(
        pairs(s, d).withColumn("anc", F.col("forced_stage2_weight") - F.col("forced_stage1_weight")),
        "anc", ["logical_decoder"],
    ),
    f"""WITH {PAIRS}, c AS (SELECT logical_decoder, count(*) AS n,
        CAST(sum((forced_stage2_weight < forced_stage1_weight)::INT) AS BIGINT) AS n_neg
        FROM pairs GROUP BY 1) SELECT *, {div('n_neg', 'n')} AS rate FROM c""",
)


def _improvement(s, d):
    base = C.postselect_sweep(lines(s, d), "is_open", "is_error", "l_tax")
    other = C.postselect_sweep(lines(s, d), "is_open", "is_error", "l_linenumber")
    out = C.relative_improvement(base, other)
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


_SW = f"""{LINES}, sw AS (SELECT {{p}} AS param, count(*) AS n, sum(is_error::INT) AS e, sum(is_open::INT) AS a,
        sum((is_open AND is_error)::INT) AS k FROM lines GROUP BY 1),
      cv AS (SELECT {curve_sql('a', 'k', 'n', 'e')} FROM sw),
      rho AS (SELECT abort_rate AS x, post_ler / original_ler AS r, ci_low / original_ler AS lo,
        ci_high / original_ler AS hi FROM cv WHERE original_ler > 0 AND post_ler IS NOT NULL)"""




add(
    "relative_improvement",
    _improvement,
    f"""WITH b AS (WITH {_SW.format(p='l_tax')} SELECT * FROM rho),
      m AS (WITH {_SW.format(p='l_linenumber')} SELECT * FROM rho),
      j AS (SELECT m.x, m.r, m.lo, m.hi,
        (SELECT max(b.x) FROM b WHERE b.x <= m.x) AS ax, (SELECT min(b.x) FROM b WHERE b.x > m.x) AS bx
        FROM m),
      i AS (SELECT j.*, {', '.join(f'''(SELECT max(b.{y}) FROM b WHERE b.x = j.ax) AS a{y},
        (SELECT max(b.{y}) FROM b WHERE b.x = j.bx) AS b{y}''' for y in ('r', 'lo', 'hi'))} FROM j),
      v AS (SELECT x, r, lo, hi, {', '.join(f'''CASE WHEN ax IS NULL THEN b{y}
        WHEN bx IS NULL OR ax = x THEN a{y}
        ELSE (b{y} - a{y}) / (bx - ax) * (x - ax) + a{y} END AS v{y}''' for y in ('r', 'lo', 'hi'))} FROM i)
      SELECT round(x, 8) AS abort_rate, round(log10(vr / r), 8) AS log_eta,
        CASE WHEN hi > 0 AND vlo / hi > 0 THEN round(log10(vlo / hi), 8) END AS log_eta_low,
        CASE WHEN lo > 0 AND vhi / lo > 0 THEN round(log10(vhi / lo), 8) END AS log_eta_high
      FROM v WHERE r > 0 AND vr / r > 0""",
)
