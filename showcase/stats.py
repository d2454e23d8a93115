"""Descriptive statistics, frequencies and rank correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from showcase.bins import rounded
from showcase.common import LINES, PAIRS, SHOTS, div, lines, pairs, plain, shots, table
from trialsift.operators import stats as S
from trialsift.session import cut_lineage, settle

QUERIES: dict[str, tuple] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (lambda spark, sf, run=run: plain(run(spark, sf)), sql)


def nearest(x: str, q: float, by: str) -> str:
    """Value at the half-even rounded position."""
    return f"max(CASE WHEN i = round({q}e0 * (n - 1)) THEN {x} END)"


def long_sql(columns: list[str], source: str, by: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS {name}, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns
    )


DESC = ["l_discount", "l_tax", "score"]
add(
    "describe",
    lambda s, d: rounded(S.describe(lines(s, d), DESC, ["is_error"], (0.25, 0.5, 0.9)), 9, "mean", "std"),
    f"""WITH {LINES}, u AS ({long_sql(DESC, 'lines', 'is_error', '"column"')}),
      r AS (SELECT *, row_number() OVER (PARTITION BY is_error, "column" ORDER BY value) - 1 AS i,
        count(*) OVER (PARTITION BY is_error, "column") AS n FROM u)
      SELECT is_error, "column", count(*) AS count, round(avg(value), 9) AS mean,
        round(stddev_samp(value), 9) AS std, min(value) AS min, {nearest('value', 0.25, '')} AS q25,
        {nearest('value', 0.5, '')} AS q50, {nearest('value', 0.9, '')} AS q90, max(value) AS max
      FROM r GROUP BY 1, 2""",
)
add(
    "decoder_stat_summary",
    lambda s, d: rounded(
        S.summarize_stats(
            shots(s, d).withColumnRenamed("event_type", "experiment"), ["score", "iteration"]
        ), 9, "mean", "std",
    ),
    f"""WITH {SHOTS}, u AS ({long_sql(['score', 'iteration'], 'shots', 'event_type AS experiment', 'stat_column')}),
      r AS (SELECT *, row_number() OVER (PARTITION BY experiment, stat_column ORDER BY value NULLS LAST) - 1 AS i,
        count(value) OVER (PARTITION BY experiment, stat_column) AS n FROM u)
      SELECT experiment, stat_column, count(*) AS rows, count(*) - count(value) AS null_count,
        count(value) AS finite_count, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std,
        min(value) AS min, {nearest('value', 0.25, '')} AS q25, median(value) AS median,
        {nearest('value', 0.75, '')} AS q75, max(value) AS max FROM r GROUP BY 1, 2""",
)
add(
    "value_frequency",
    lambda s, d: S.value_frequency(lines(s, d), ["l_discount", "score"], ["l_linenumber"], 1),
    f"""WITH {LINES}, u AS ({long_sql(['l_discount', 'score'], 'lines', 'l_linenumber', 'stat_column')})
      SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, stat_column,
        round(value * 10e0) / 10e0 AS value, count(*) AS frequency FROM u GROUP BY ALL""",
)
# Prices cut so that many values lie half way between two roundings in decimal, but not in binary.
add(
    "value_frequency_half_way",
    lambda s, d: S.value_frequency(
        table(s, d, "lineitem").select(
            (F.floor(F.col("l_extendedprice") / 10) % 2000 / 200.0).alias("price"), "l_linenumber"
        ), ["price"], ["l_linenumber"], 2,
    ),
    """WITH u AS (SELECT l_linenumber, floor(l_extendedprice / 10) % 2000 / 200e0 AS price FROM lineitem)
      SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, 'price' AS stat_column,
        round(price * 100e0) / 100e0 AS value, count(*) AS frequency FROM u GROUP BY ALL""",
)
# Groups of any size: with an even number of rows the median's position lies half way.
add(
    "describe_half_way",
    lambda s, d: rounded(
        S.describe(table(s, d, "customer"), ["c_acctbal"], ["c_nationkey"], (0.1, 0.25, 0.5)), 6, "mean", "std"
    ),
    f"""WITH r AS (SELECT c_nationkey, c_acctbal AS value,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS i,
        count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
      SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, 'c_acctbal' AS "column", count(*) AS count, round(avg(value), 6) AS mean,
        round(stddev_samp(value), 6) AS std, min(value) AS min, {nearest('value', 0.1, '')} AS q10,
        {nearest('value', 0.25, '')} AS q25, {nearest('value', 0.5, '')} AS q50, max(value) AS max
      FROM r GROUP BY 1, 2""",
)
add(
    "finite_values",
    lambda s, d: S.finite_values(
        shots(s, d).withColumn(
            "v", F.when(F.col("shot_id") % 3 == 0, F.lit(float("inf")))
            .when(F.col("shot_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("score")),
        ), "v",
    ),
    f"WITH {SHOTS} SELECT score AS value FROM shots WHERE shot_id % 3 = 2",
)
add(
    "index_frequency",
    lambda s, d: S.index_frequency(
        table(s, d, "events").select(
            (F.col("event_type") == "error").alias("is_error"),
            F.array_distinct(F.array(F.col("event_id") % 7, F.col("user_id") % 12)).alias("flips"),
        ), "flips", 11, "is_error",
    ),
    f"""WITH e AS (SELECT event_type = 'error' AS is_error, list_distinct([event_id % 7, user_id % 12]) AS flips FROM events),
      x AS (SELECT is_error, unnest(flips) AS idx FROM e),
      c AS (SELECT is_error, idx, count(*) AS n FROM x GROUP BY ALL),
      g AS (SELECT is_error, count(*) AS n_rows FROM e GROUP BY 1),
      f AS (SELECT is_error, n_rows, unnest(range(11)) AS idx FROM g)
      SELECT f.is_error, f.idx, coalesce(n, 0) AS count, n_rows,
        {div('coalesce(n, 0)', 'greatest(n_rows, 1)')} AS fraction FROM f LEFT JOIN c USING (is_error, idx)""",
)


def rank_avg(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2e0"


SCORES = ["logical_gap", "forced_gap_ml", "forced_stage1_weight"]
RHO = f"""WITH {PAIRS}, r AS (SELECT {', '.join(f'{rank_avg(c)} AS {c}' for c in SCORES)} FROM pairs)"""
_PAIRS = [(a, b) for a in SCORES for b in SCORES]


def _label(c: str) -> str:
    return "-" + c if c == "forced_gap_ml" else c


add(
    "spearman_matrix",
    lambda s, d: rounded(S.spearman_matrix(pairs(s, d), SCORES, ["forced_gap_ml"]), 9),
    RHO + " ".join(
        f"""{' UNION ALL ' if i else ' '} SELECT '{_label(a)}' AS "left", '{_label(b)}' AS "right",
        round({'1e0' if a == b else f"{'-' if (a == 'forced_gap_ml') != (b == 'forced_gap_ml') else ''}corr({a}, {b})"}, 9) AS rho
        {'' if a == b else 'FROM r'}"""
        for i, (a, b) in enumerate(_PAIRS)
    ),
)
add(
    "kendall_tau",
    lambda s, d: rounded(
        S.kendall(pairs(s, d), "logical_gap", "forced_gap_ml").select("n", "tau"), 9
    ),
    f"""WITH {PAIRS}, v AS (SELECT logical_gap AS x, forced_gap_ml AS y, count(*) AS w FROM pairs GROUP BY 1, 2),
      e AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.w * b.w) / 2 AS ex FROM v a, v b),
      n AS (SELECT CAST(sum(w) AS DOUBLE) AS n FROM v),
      tx AS (SELECT CAST(sum(t * (t - 1)) AS DOUBLE) AS t2 FROM (SELECT sum(w) AS t FROM v GROUP BY x)),
      ty AS (SELECT CAST(sum(t * (t - 1)) AS DOUBLE) AS t2 FROM (SELECT sum(w) AS t FROM v GROUP BY y))
      SELECT CAST(n AS BIGINT) AS n,
        round(2 * ex / (sqrt(n * (n - 1) - tx.t2) * sqrt(n * (n - 1) - ty.t2)), 9) AS tau FROM e, n, tx, ty""",
)
add(
    "kendall_tau_ranges",
    lambda s, d: rounded(
        S.kendall(lines(s, d), "score", "l_discount", max_rows=100).select("n", "tau"), 9
    ),
    f"""WITH {LINES}, v AS (SELECT score AS x, l_discount AS y, count(*) AS w FROM lines GROUP BY 1, 2),
      e AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.w * b.w) / 2 AS ex FROM v a, v b),
      n AS (SELECT CAST(sum(w) AS DOUBLE) AS n FROM v),
      tx AS (SELECT CAST(sum(t * (t - 1)) AS DOUBLE) AS t2 FROM (SELECT sum(w) AS t FROM v GROUP BY x)),
      ty AS (SELECT CAST(sum(t * (t - 1)) AS DOUBLE) AS t2 FROM (SELECT sum(w) AS t FROM v GROUP BY y))
      SELECT CAST(n AS BIGINT) AS n,
        round(2 * ex / (sqrt(n * (n - 1) - tx.t2) * sqrt(n * (n - 1) - ty.t2)), 9) AS tau FROM e, n, tx, ty""",
)


def _inputs(frame, name: str, left: str, right: str, max_rows: int):
    """What p-values are computed from; exact counts, and correlations to nine digits."""
    counts = ["n", "excess", "x2", "x3", "x5", "y2", "y3", "y5"]
    row = S.kendall_and_spearman(frame, left, right, max_rows)
    row = cut_lineage(row.select(F.lit(name).alias("name"), *counts, F.round("tau", 9).alias("tau"), F.round("rho", 9).alias("rho")))
    # Sums of cubes outgrow a bigint at some millions of ties; such a column stays a decimal, so that its number is whole.
    found = row.first()
    return row.withColumns({c: F.col(c).cast("bigint") for c in counts if abs(found[c]) < 2**63})


def _inputs_sql(source: str, name: str, left: str, right: str) -> str:
    ties = ", ".join(
        f"""t{c} AS MATERIALIZED (SELECT CAST(sum(t * (t - 1)) AS BIGINT) AS {c}2, CAST(sum(t * (t - 1) * (t - 2)) AS BIGINT) AS {c}3,
        CAST(sum(t * (t - 1) * (2 * t + 5)) AS BIGINT) AS {c}5 FROM (SELECT CAST(sum(w) AS HUGEINT) AS t FROM v GROUP BY {c}))"""
        for c in "xy"
    )
    return f"""SELECT * FROM (WITH v AS MATERIALIZED (SELECT CAST({left} AS DOUBLE) AS x, CAST({right} AS DOUBLE) AS y, count(*) AS w
        FROM {source} GROUP BY 1, 2),
      e AS MATERIALIZED (SELECT coalesce(sum(CASE WHEN (a.y > b.y) THEN a.w * b.w WHEN a.y < b.y THEN -a.w * b.w ELSE 0 END), 0) AS ex
        FROM v a JOIN v b ON a.x > b.x),
      n AS (SELECT CAST(sum(w) AS BIGINT) AS n FROM v), {ties},
      r AS (SELECT {rank_avg(left)} AS x, {rank_avg(right)} AS y FROM {source}), c AS (SELECT round(corr(x, y), 9) AS rho FROM r)
      SELECT '{name}' AS name, n, CAST(ex AS BIGINT) AS excess, x2, x3, x5, y2, y3, y5,
        round(2 * ex / (sqrt(CAST(n AS DOUBLE) * (n - 1) - x2) * sqrt(CAST(n AS DOUBLE) * (n - 1) - y2)), 9) AS tau, rho
      FROM e, n, tx, ty, c)"""


def _correlation_inputs(s, d):
    # Read by four passes each, so the join of orders and lines is written once.
    kept, _ = settle(pairs(s, d).select("logical_gap", "forced_gap_ml", "forced_stage1_weight"))
    return (
        _inputs(kept, "gaps", "logical_gap", "forced_gap_ml", 200_000)
        .unionByName(_inputs(kept, "weights", "forced_stage1_weight", "forced_gap_ml", 200))
        .unionByName(_inputs(table(s, d, "orders"), "orders", "o_totalprice", "o_custkey", 500))
    )


# Tied scores of pairs, and continuous ones whose points are cut into strips again and again.
add(
    "rank_correlation_inputs",
    _correlation_inputs,
    f"""WITH {PAIRS}, kept AS MATERIALIZED (SELECT * FROM pairs)
      {_inputs_sql('kept', 'gaps', 'logical_gap', 'forced_gap_ml')} UNION ALL
      {_inputs_sql('kept', 'weights', 'forced_stage1_weight', 'forced_gap_ml')} UNION ALL
      {_inputs_sql('orders', 'orders', 'o_totalprice', 'o_custkey')}""",
)
# P-values have no counterpart in SQL; tests compare them with published values.
add(
    "rank_correlations",
    lambda s, d: S.rank_correlations(
        pairs(s, d), [("logical_gap", "forced_gap_ml"), ("forced_stage1_weight", "forced_gap_ml")]
    ),
)
