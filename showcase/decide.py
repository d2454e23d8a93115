"""Candidate decisions, case labels, weights and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from showcase.bins import rounded
from showcase.common import (
    CANDIDATES,
    EDGES,
    TRUTH,
    candidates,
    class_code,
    div,
    edges,
    pairs,
    PAIRS,
    plain,
    table,
    truth,
)
from trialsift.operators import decide as D

QUERIES: dict[str, tuple] = {}
INF = float("inf")


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (lambda spark, sf, run=run: plain(run(spark, sf)), sql)


def coded(df):
    """Class arrays as numbers, flip sets as text, sentinels of the gap told apart."""
    out = df
    for c in ("logical", "base_logical", "forced_logical"):
        if c in df.columns:
            out = out.withColumn(c, class_code(c))
    if "flips" in df.columns:
        out = out.withColumn("flips", F.array_join("flips", ","))
    if "gap" in df.columns:
        g = F.col("gap")
        kind = F.when(F.isnan(g), "nan").when(g == INF, "+inf").when(g == -INF, "-inf").otherwise("finite")
        out = out.withColumn("gap_kind", kind)
    return out


def flips(a: str, b: str) -> str:
    """Indices at which two coded classes differ (bit 2 is index 0)."""
    return f"CASE xor({a}, {b}) WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '0' ELSE '0,1' END"


WIN = CANDIDATES + """, k AS MATERIALIZED (SELECT * FROM cands WHERE converged),
  w AS MATERIALIZED (SELECT shot_id, weight AS win_weight, cls AS win FROM k
    QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY weight, stage, obs_idx) = 1),
  rv AS (SELECT k.shot_id, min(weight) AS rival FROM k JOIN w USING (shot_id) WHERE cls <> win GROUP BY 1),
  nf AS (SELECT shot_id, CAST(sum((stage = 1 AND converged)::INT) AS BIGINT) AS nf FROM cands GROUP BY 1)"""


def reselect_sql(no_rival: str, alone: str) -> str:
    return f"""WITH {WIN}, g AS (SELECT base.shot_id, base.weight AS base_weight, base.cls AS bc, base.converged AS ok,
        win_weight, win, rival, nf,
        CASE WHEN NOT base.converged THEN 'finite' WHEN nf = 0 THEN '{alone}'
          WHEN rival IS NULL THEN '{no_rival}' ELSE 'finite' END AS gap_kind
        FROM base JOIN nf USING (shot_id) LEFT JOIN w USING (shot_id) LEFT JOIN rv USING (shot_id))
      SELECT shot_id, gap_kind, CASE WHEN gap_kind = 'finite' THEN
          CASE WHEN NOT ok OR nf = 0 THEN 0e0 ELSE rival - win_weight END END AS gap,
        CAST(CASE WHEN ok THEN win ELSE bc END AS BIGINT) AS logical, NOT ok AS forced_error,
        CASE WHEN ok THEN {flips('bc', 'win')} ELSE '' END AS flips, base_weight,
        CAST(bc AS BIGINT) AS base_logical, nf AS n_forced_converged FROM g"""


add(
    "reselect_gap",
    lambda s, d: coded(D.reselect_gap(candidates(s, d))),
    reselect_sql("nan", "finite"),
)
add(
    "reselect_gap_fixed_convention",
    lambda s, d: coded(D.fixed_gap(candidates(s, d))),
    reselect_sql("+inf", "+inf"),
)
BEST = CANDIDATES + """, f AS (SELECT * FROM cands WHERE stage = 1 AND converged),
  b AS MATERIALIZED (SELECT shot_id, weight AS bw, cls AS bcl FROM f
    QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY weight, obs_idx, cls) = 1),
  nf AS (SELECT shot_id, CAST(sum((stage = 1 AND converged)::INT) AS BIGINT) AS nf FROM cands GROUP BY 1)"""
add(
    "anchored_gap",
    lambda s, d: coded(D.anchored_gap(candidates(s, d), unconverged="positive")),
    f"""WITH {BEST} SELECT base.shot_id,
        CASE WHEN NOT base.converged THEN '-inf' WHEN bw IS NULL THEN '+inf' ELSE 'finite' END AS gap_kind,
        CASE WHEN base.converged THEN bw - base.weight END AS gap, CAST(base.cls AS BIGINT) AS logical,
        NOT base.converged AS forced_error,
        CASE WHEN base.converged AND bw IS NOT NULL THEN {flips('base.cls', 'bcl')} ELSE '' END AS flips,
        base.weight AS base_weight, CASE WHEN base.converged THEN bw END AS forced_weight,
        CAST(CASE WHEN base.converged THEN bcl END AS BIGINT) AS forced_logical, nf AS n_forced_converged
      FROM base JOIN nf USING (shot_id) LEFT JOIN b USING (shot_id)""",
)


def _with_reweighted(s, d):
    c = candidates(s, d)
    o = table(s, d, "orders")
    extra = o.select(
        F.col("o_orderkey").alias("shot_id"),
        F.lit(2).alias("stage"),
        F.lit(0).alias("obs_idx"),
        (F.col("o_totalprice") / 12.0).alias("weight"),
        F.array(F.col("o_custkey") % 4 == 0, F.col("o_orderpriority") < "3").alias("logical"),
        (F.col("o_orderkey") % 7 != 0).alias("converged"),
        F.lit(None).cast("double").alias("stat"),
    )
    return c.unionByName(extra)


add(
    "reweighted_gap",
    lambda s, d: coded(D.reweighted_gap(_with_reweighted(s, d), unconverged="negative")),
    f"""WITH {BEST}, x AS (SELECT o_orderkey AS shot_id, o_totalprice / 12e0 AS wr, o_orderkey % 7 <> 0 AS okr,
        (CASE WHEN o_custkey % 4 = 0 THEN 2 ELSE 0 END) + (CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END) AS cr
        FROM orders),
      j AS (SELECT base.shot_id, base.weight AS w1, base.cls AS c1, base.converged AS ok, bw, bcl, wr, cr,
        okr AND cr = base.cls AS same, okr AND cr <> base.cls AS other
        FROM base JOIN x USING (shot_id) LEFT JOIN b USING (shot_id)),
      g AS (SELECT *, CASE WHEN NOT ok THEN '-inf' WHEN bw IS NULL AND NOT other THEN '-inf' ELSE 'finite' END AS gap_kind,
        (CASE WHEN other THEN least(coalesce(bw, wr), wr) ELSE bw END)
          - (CASE WHEN same AND wr < w1 THEN wr ELSE w1 END) AS gap0 FROM j)
      SELECT shot_id, gap_kind, CASE WHEN gap_kind = 'finite' THEN gap0 END AS gap, CAST(c1 AS BIGINT) AS logical,
        NOT ok AS forced_error, CASE WHEN ok AND bw IS NOT NULL THEN {flips('c1', 'bcl')}
          WHEN ok AND other THEN {flips('c1', 'cr')} ELSE '' END AS flips FROM g""",
)
CASE_SQL = WIN + f""", {TRUTH}, a AS MATERIALIZED (SELECT DISTINCT shot_id FROM cands JOIN truth USING (shot_id)
    WHERE stage = 1 AND cls = truth),
  j AS (SELECT base.shot_id, converged AS ok, cls <> truth AS bw, win <> truth AS fw, cls <> win AS moved,
    a.shot_id IS NOT NULL AS alt FROM base JOIN truth USING (shot_id) LEFT JOIN w USING (shot_id)
    LEFT JOIN a ON a.shot_id = base.shot_id)"""
add(
    "case_label",
    lambda s, d: D.case_label(candidates(s, d), truth(s, d)),
    f"""WITH {CASE_SQL} SELECT shot_id, CAST(CASE WHEN NOT ok THEN -1 WHEN bw AND NOT alt THEN 0
      WHEN bw AND NOT fw THEN 1 WHEN bw THEN 2 WHEN moved THEN 3 ELSE -1 END AS BIGINT) AS "case" FROM j""",
)
add(
    "case_from_summary",
    lambda s, d: pairs(s, d).select(
        D.case_from_summary("forced_stage1_obs_flip", "forced_is_logical_error").alias("case")
    ).groupBy("case").agg(F.count("*").alias("n")),
    f"""WITH {PAIRS} SELECT CASE WHEN forced_stage1_obs_flip AND forced_is_logical_error THEN '0+2'
        WHEN forced_stage1_obs_flip THEN '1' WHEN forced_is_logical_error THEN '3' ELSE '-1' END AS "case",
      count(*) AS n FROM pairs GROUP BY 1""",
)
add(
    "candidate_summary",
    lambda s, d: rounded(
        D.candidate_summary(candidates(s, d), truth(s, d)), 9, "forced_mean_stat", "forced_std_stat"
    ),
    f"""WITH {CANDIDATES}, {TRUTH}, f AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY weight, obs_idx) AS p
        FROM cands WHERE stage = 1 AND converged),
      st AS (SELECT shot_id, avg(CASE WHEN stage = 1 THEN stat END) AS m,
        stddev_pop(CASE WHEN stage = 1 THEN stat END) AS sd, max(CASE WHEN stage = 1 THEN stat END) AS mx,
        CAST(sum((stage = 1 AND converged)::INT) AS BIGINT) AS nf FROM cands GROUP BY 1)
      SELECT base.shot_id, base.weight AS stage1_weight, base.cls <> truth AS stage1_obs_flip,
        CASE WHEN base.converged THEN f1.weight END AS stage2_weight,
        base.converged AND coalesce(f1.cls <> truth, false) AS stage2_obs_flip,
        CASE WHEN base.converged THEN f2.weight END AS stage2_2ndbest_weight,
        base.converged AND coalesce(f2.cls <> truth, false) AS stage2_2ndbest_obs_flip,
        base.stat AS baseline_stat, CASE WHEN base.converged THEN f1.stat END AS forced_stat,
        CASE WHEN base.converged THEN f2.stat END AS forced_2nd_best_stat,
        CASE WHEN base.converged THEN round(m, 9) END AS forced_mean_stat,
        CASE WHEN base.converged THEN round(sd, 9) END AS forced_std_stat,
        CASE WHEN base.converged THEN mx END AS forced_max_stat, nf AS n_forced_converged
      FROM base JOIN truth USING (shot_id) JOIN st USING (shot_id)
      LEFT JOIN f f1 ON f1.shot_id = base.shot_id AND f1.p = 1
      LEFT JOIN f f2 ON f2.shot_id = base.shot_id AND f2.p = 2""",
)


def _items(s, d):
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("shot_id"), F.col("l_partkey").alias("error_id")
    )


def _priors(s, d):
    return table(s, d, "part").select(
        F.col("p_partkey").alias("error_id"), (F.col("p_size") / F.lit(200.0)).alias("prior")
    )


ITEMS = """items AS (SELECT l_orderkey AS shot_id, l_partkey AS error_id FROM lineitem),
  priors AS (SELECT p_partkey AS error_id, least(greatest(p_size / 200e0, 1e-14), 0.99999999999999e0) AS prior FROM part)"""
add(
    "solution_weights",
    lambda s, d: rounded(D.solution_weights(_items(s, d), _priors(s, d)), 8),
    f"""WITH {ITEMS} SELECT shot_id, round(sum(ln((1e0 - prior) / prior)), 8) AS weight
      FROM items JOIN priors USING (error_id) GROUP BY 1""",
)
add(
    "logical_class",
    lambda s, d: D.logical_class(_items(s, d), edges(s, d)[1], 5).select(
        "shot_id", *[F.get("logical", F.lit(i)).alias(f"o{i}") for i in range(5)]
    ),
    f"""WITH {ITEMS}, {EDGES}, c AS (SELECT shot_id, observable_id, count(*) % 2 AS p
        FROM items LEFT JOIN obs USING (error_id) GROUP BY ALL)
      SELECT shot_id, {', '.join(f'coalesce(bool_or(observable_id = {i} AND p = 1), false) AS o{i}' for i in range(5))}
      FROM c GROUP BY 1""",
)
add(
    "label_errors",
    lambda s, d: candidates(s, d).where("stage = 0").join(truth(s, d), "shot_id").select(
        "shot_id", D.label_errors("logical", "truth", ~F.col("converged")).alias("is_logical_error")
    ),
    f"""WITH {CANDIDATES}, {TRUTH} SELECT shot_id, cls <> truth OR NOT converged AS is_logical_error
      FROM base JOIN truth USING (shot_id)""",
)
ROUNDS = """rounds AS (SELECT l_orderkey AS shot_id, l_linenumber - 1 AS round, l_partkey % 2 AS c,
    (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS cls, l_suppkey % 5 <> 0 AS ok, l_suppkey, l_partkey
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey, l_suppkey, l_returnflag) = 1)"""


def _rounds(s, d):
    """One row per order and line number; the kept line does not depend on row order."""
    li = table(s, d, "lineitem")
    first = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("r")
    )
    odd = F.col("r.l_partkey") % 2
    return first.select(
        F.col("l_orderkey").alias("shot_id"),
        (F.col("l_linenumber") - 1).alias("round"),
        F.when(odd == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("correction"),
        F.array(F.col("r.l_returnflag") == "R").alias("logical"),
        (F.col("r.l_suppkey") % 5 != 0).alias("converged"),
    )


def agreement_sql(value: str) -> str:
    return f"""WITH {ROUNDS}, z AS (SELECT * FROM rounds WHERE round = 0),
      a AS (SELECT shot_id, min({value}) = max({value}) AS same FROM rounds GROUP BY 1)
      SELECT a.shot_id, z.ok AND (z.c = 0 OR same) AS accept, NOT z.ok AS forced_error,
        CAST(z.cls AS BIGINT) AS logical FROM a LEFT JOIN z USING (shot_id)"""


for criterion, value in (("PEC", "c"), ("LEC", "cls")):
    add(
        f"agreement_accept_{criterion.lower()}",
        lambda s, d, criterion=criterion: D.agreement_accept(_rounds(s, d), criterion).withColumn(
            "logical", F.get("logical", F.lit(0)).cast("bigint")
        ),
        agreement_sql(value),
    )
for kind, formula in (
    ("Ratio", "pow(prior, 1.5e0)"),
    ("Gap", "prior * exp(-(ln(prior) / sum(ln(prior)) OVER (PARTITION BY shot_id)) * 1.5e0)"),
):
    add(
        f"reweight_priors_{kind.lower()}",
        lambda s, d, kind=kind: rounded(
            D.reweight_priors(_items(s, d).distinct().join(_priors(s, d), "error_id"), 1.5, kind)
            .select("shot_id", "error_id", "new_prior"), 9,
        ),
        f"""WITH {ITEMS}, j AS (SELECT DISTINCT shot_id, error_id, prior FROM items JOIN priors USING (error_id))
          SELECT shot_id, error_id, round({formula}, 9) AS new_prior FROM j""",
    )


def _clusters(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy(
        F.col("l_orderkey").alias("shot_id"), F.col("l_linenumber").alias("cluster_id")
    ).agg(
        F.array_sort(F.collect_set("l_partkey")).alias("bits"),
        (F.max("l_suppkey") % 4 != 0).alias("active"),
        F.when(F.max("l_suppkey") % 6 == 1, F.lit(0)).otherwise(F.lit(-1)).alias("absorbed_by"),
    )


CLUSTERS = """cl AS (SELECT l_orderkey AS shot_id, l_linenumber AS cluster_id, max(l_suppkey) AS m
    FROM lineitem GROUP BY ALL),
  wt AS (SELECT p_partkey AS error_id, p_size * 0.5e0 AS weight FROM part),
  s AS (SELECT l_orderkey AS shot_id, l_linenumber AS cluster_id, sum(weight) AS s
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN wt ON l_partkey = error_id
    GROUP BY ALL),
  t AS (SELECT sum(weight) AS total FROM wt)"""
for alpha, norm in ((2.0, "sqrt(sum(s * s))"), (INF, "max(s)")):
    add(
        f"cluster_norm_{'inf' if alpha == INF else '2'}",
        lambda s, d, alpha=alpha: rounded(
            D.cluster_norm(
                _clusters(s, d),
                table(s, d, "part").select(
                    F.col("p_partkey").alias("error_id"), (F.col("p_size") * 0.5).alias("weight")
                ),
                alpha,
            ), 10,
        ),
        f"""WITH {CLUSTERS}, q AS (SELECT shot_id, {norm} AS n FROM s JOIN cl USING (shot_id, cluster_id)
            WHERE m % 4 <> 0 AND m % 6 <> 1 GROUP BY 1)
          SELECT shot_id, round(coalesce(n / total, 0), 10) AS q
          FROM (SELECT DISTINCT shot_id FROM cl) LEFT JOIN q USING (shot_id), t""",
    )
add(
    "best_of_ensemble",
    lambda s, d: D.best_of_ensemble(
        candidates(s, d).where("stage = 1").groupBy("shot_id", F.col("obs_idx").alias("member"))
        .agg(F.min("weight").alias("weight"), F.max("stat").alias("stat"))
    ),
    f"""WITH {CANDIDATES}, m AS (SELECT shot_id, obs_idx AS member, min(weight) AS weight, max(stat) AS stat
        FROM cands WHERE stage = 1 GROUP BY ALL)
      SELECT shot_id, CAST(member AS BIGINT) AS member, weight, stat FROM m
      QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY weight, member) = 1""",
)
add(
    "mean_unit_vector",
    lambda s, d: rounded(D.mean_unit_vector(table(s, d, "embeddings"), "embedding", ["label"]), 7),
    """WITH v AS (SELECT label, embedding,
        sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
      e AS (SELECT label, n, unnest(range(len(embedding))) AS idx, unnest(embedding) AS x FROM v)
      SELECT CAST(label AS BIGINT) AS label, idx,
        round(sum(CASE WHEN n > 0 THEN CAST(x AS DOUBLE) / n ELSE 0 END) / count(*), 7) AS mean
      FROM e GROUP BY ALL""",
)
add(
    "consistency_check",
    lambda s, d: D.check_consistency(
        candidates(s, d).where("stage = 0").select(
            "shot_id", F.col("converged").alias("baseline_converged"),
            F.col("logical").alias("baseline_logical"),
        ).join(
            truth(s, d).select(
                "shot_id", F.col("truth").alias("forced_logical"),
                (F.col("shot_id") % 9 != 0).alias("forced_converged"),
            ), "shot_id",
        ), strict=False,
    ).select("shot_id", "forced_error", "violation"),
    f"""WITH {CANDIDATES}, {TRUTH} SELECT shot_id, NOT (converged AND shot_id % 9 <> 0) AS forced_error,
      converged AND shot_id % 9 <> 0 AND cls <> truth AS violation FROM base JOIN truth USING (shot_id)""",
)
