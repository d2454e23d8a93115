"""Bipartite error models, id ranges and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from showcase.bins import rounded
from showcase.common import EDGES, edges, plain, table
from trialsift.functions.exprs import symmetric_difference
from trialsift.operators import idranges as I
from trialsift.operators import model as M

QUERIES: dict[str, tuple] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (lambda spark, sf, run=run: plain(run(spark, sf)), sql)


# Mechanisms: orders; components: their lines by parity of the line number.
MECH = """parts AS (SELECT DISTINCT l_orderkey AS ord, l_linenumber % 2 AS part, l_suppkey % 6 AS det,
    l_partkey % 3 AS ob FROM lineitem),
  dx AS (SELECT ord, det FROM (SELECT DISTINCT ord, part, det FROM parts) GROUP BY ALL HAVING count(*) % 2 = 1),
  ox AS (SELECT ord, ob FROM (SELECT DISTINCT ord, part, ob FROM parts) GROUP BY ALL HAVING count(*) % 2 = 1),
  m AS (SELECT DISTINCT ord FROM parts),
  mech AS (SELECT ord, (ord % 9 + 1) / 100e0 AS prob,
    coalesce((SELECT string_agg(det, ',' ORDER BY det) FROM dx WHERE dx.ord = m.ord), '') AS dets,
    coalesce((SELECT string_agg(ob, ',' ORDER BY ob) FROM ox WHERE ox.ord = m.ord), '') AS obs FROM m)"""


def mechanisms(s, d):
    li = table(s, d, "lineitem")
    parts = li.groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("part")).agg(
        F.array_sort(F.collect_set((F.col("l_suppkey") % 6).cast("int"))).alias("detectors"),
        F.array_sort(F.collect_set((F.col("l_partkey") % 3).cast("int"))).alias("observables"),
    )
    grouped = parts.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("part", "detectors", "observables"))).alias("cs")
    )
    return grouped.select(
        F.col("l_orderkey").alias("ord"),
        ((F.col("l_orderkey") % 9 + 1) / F.lit(100.0)).alias("prob"),
        F.transform(
            "cs",
            lambda c: F.struct(
                c["detectors"].alias("detectors"), c["observables"].alias("observables")
            ),
        ).alias("components"),
    )


def _text(df, *columns):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


MERGED = MECH + """, g AS (SELECT dets AS detectors, arg_max(obs, ord) AS observables,
    round((1e0 - product(1e0 - 2e0 * prob)) / 2e0, 10) AS prior, min(ord) AS first_ord FROM mech GROUP BY 1)"""
add(
    "merge_mechanisms",
    lambda s, d: rounded(_text(M.merge_mechanisms(mechanisms(s, d)), "detectors", "observables"), 10),
    f"""WITH {MERGED} SELECT row_number() OVER (ORDER BY first_ord) - 1 AS error_id, detectors, observables,
      prior, first_ord FROM g""",
)
EDGE = """e AS (SELECT ord, part, string_agg(det, ',' ORDER BY det) AS dets, count(*) AS nd
    FROM (SELECT DISTINCT ord, part, det FROM parts) GROUP BY 1, 2),
  eo AS (SELECT ord, part, string_agg(ob, ',' ORDER BY ob) AS obs
    FROM (SELECT DISTINCT ord, part, ob FROM parts) GROUP BY 1, 2),
  pos AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY part) - 1 AS i FROM e JOIN eo USING (ord, part)),
  ge AS (SELECT dets AS detectors, arg_max(obs, ord * 10 + i) AS observables,
    round((1e0 - product(1e0 - 2e0 * ((ord % 9 + 1) / 100e0))) / 2e0, 10) AS prior,
    min(ord * 10 + i) AS f FROM pos WHERE nd <= 2 GROUP BY 1)"""
add(
    "merge_edges",
    lambda s, d: rounded(
        _text(M.merge_edges(mechanisms(s, d)), "detectors", "observables").drop("first_ord"), 10
    ),
    f"""WITH {MECH}, {EDGE} SELECT row_number() OVER (ORDER BY f) - 1 AS error_id, detectors, observables,
      prior FROM ge""",
)
add(
    "model_edge_tables",
    lambda s, d: M.check_edges(M.merge_mechanisms(mechanisms(s, d))).groupBy("detector_id").agg(
        F.count("*").alias("n_errors")
    ),
    f"""WITH {MERGED}, u AS (SELECT unnest(string_split(detectors, ',')) AS t FROM g WHERE detectors <> '')
      SELECT CAST(t AS BIGINT) AS detector_id, count(*) AS n_errors FROM u GROUP BY 1""",
)




def _dropped(s, d):
    # The detector table is derived from the data: every detector any mechanism touches.
    used = mechanisms(s, d).select(F.explode("components").alias("c")).select(
        F.explode("c.detectors").alias("detector_id")
    ).distinct()
    coords = used.select(
        "detector_id", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("detector_id").cast("double")).alias("coords")
    )
    return M.drop_basis(mechanisms(s, d), coords, "X")


add(
    "drop_basis",
    lambda s, d: _dropped(s, d)[0].select(
        "ord",
        F.array_join(
            F.transform(
                "components",
                lambda c: F.concat_ws(
                    "|",
                    F.array_join(F.array_sort(c["detectors"]), ","),
                    F.array_join(F.array_sort(c["observables"]), ","),
                ),
            ), "^",
        ).alias("text"),
        "undetected",
    ),
    f"""WITH {MECH}, ids AS (SELECT DISTINCT ord, part FROM parts),
      nd AS (SELECT ord, part, string_agg(det - 3, ',' ORDER BY det) AS t, count(*) AS n
        FROM (SELECT DISTINCT ord, part, det FROM parts) WHERE det >= 3 GROUP BY 1, 2),
      no AS (SELECT ord, part, string_agg(ob, ',' ORDER BY ob) AS t FROM (SELECT DISTINCT ord, part, ob FROM parts) GROUP BY 1, 2),
      c AS (SELECT ord, part, coalesce(nd.t, '') || '|' || no.t AS t, nd.t IS NULL AS lone
        FROM ids LEFT JOIN nd USING (ord, part) JOIN no USING (ord, part))
      SELECT ord, string_agg(t, '^' ORDER BY part) AS text, bool_or(lone) AS undetected FROM c GROUP BY 1""",
)
add(
    "hyperedges",
    lambda s, d: M.hyperedges(mechanisms(s, d), 3).select(
        "ord", "n_components", "n_detectors", F.array_join("component_sizes", ",").alias("sizes"),
        F.array_join("detectors", ",").alias("detectors"), F.array_join("observables", ",").alias("observables"),
    ),
    f"""WITH {MECH}, cs AS (SELECT ord, part, count(DISTINCT det) AS n FROM parts GROUP BY 1, 2)
      SELECT ord, (SELECT count(*) FROM cs WHERE cs.ord = mech.ord) AS n_components,
        CAST(len(string_split(dets, ',')) AS BIGINT) AS n_detectors,
        (SELECT string_agg(n, ',' ORDER BY part) FROM cs WHERE cs.ord = mech.ord) AS sizes,
        dets AS detectors, obs AS observables FROM mech WHERE dets <> '' AND len(string_split(dets, ',')) >= 3""",
)
add(
    "observable_supports",
    lambda s, d: M.supports(edges(s, d)[1]),
    f"WITH {EDGES} SELECT CAST(observable_id AS BIGINT) AS observable_id, count(*) AS support_size FROM obs GROUP BY 1",
)
OVER = EDGES + """, ov AS (SELECT observable_id, detector_id, count(*) AS k FROM obs JOIN checks USING (error_id) GROUP BY ALL),
  cy AS (SELECT observable_id, CAST(sum(k * (k - 1)) / 2 AS BIGINT) AS cycles FROM ov GROUP BY 1),
  su AS (SELECT observable_id, count(*) AS support_size FROM obs GROUP BY 1)"""
add(
    "new_cycles",
    lambda s, d: M.new_cycles(*edges(s, d)),
    f"""WITH {OVER} SELECT CAST(observable_id AS BIGINT) AS observable_id, support_size,
      coalesce(cycles, 0) AS cycles FROM su LEFT JOIN cy USING (observable_id)""",
)
add(
    "overlap_summary",
    lambda s, d: M.overlap_summary(*edges(s, d)).withColumn(
        "distribution",
        F.array_join(
            F.transform("distribution", lambda h: F.concat_ws(":", h["overlap"].cast("string"), h["n"].cast("string"))),
            ",",
        ),
    ),
    f"""WITH {OVER}, nc AS (SELECT count(DISTINCT detector_id) AS n FROM checks),
      full_ AS (SELECT observable_id, detector_id, coalesce(k, 0) AS k FROM su
        CROSS JOIN (SELECT DISTINCT detector_id FROM checks) LEFT JOIN ov USING (observable_id, detector_id)),
      h AS (SELECT observable_id, k, count(*) AS n FROM full_ GROUP BY ALL)
      SELECT CAST(su.observable_id AS BIGINT) AS observable_id, support_size, max(k) AS max_overlap,
        CAST(sum(CASE WHEN k >= 2 THEN n ELSE 0 END) AS BIGINT) AS checks_ge_2,
        CAST(sum(n * k * (k - 1)) / 2 AS BIGINT) AS cycles,
        string_agg(k || ':' || n, ',' ORDER BY k) AS distribution
      FROM su JOIN h USING (observable_id) GROUP BY ALL""",
)


def _hash(seed: str) -> str:
    return f"CAST('0x' || substr(md5({seed} || '-' || error_id), 1, 13) AS BIGINT)"


SPLIT = OVER + f""", sd AS (SELECT o.*, support_size, seed, {_hash('seed')} AS h,
    CASE WHEN support_size < 2 THEN 1 ELSE least(3, support_size) END AS m
    FROM obs o JOIN su USING (observable_id), (SELECT unnest([0, 1, 2, 3]) AS seed)),
  bl AS (SELECT *, h % m AS block FROM sd),
  bb AS (SELECT *, CASE WHEN p < (support_size % m) * (support_size // m + 1) THEN p // (support_size // m + 1)
      ELSE support_size % m + (p - (support_size % m) * (support_size // m + 1)) // (support_size // m) END AS block
    FROM (SELECT *, row_number() OVER (PARTITION BY seed, observable_id ORDER BY h) - 1 AS p FROM sd))"""


def split_sql(blocks: str) -> str:
    return f"""WITH {SPLIT}, z AS (SELECT observable_id, seed, block, count(*) AS n FROM {blocks} GROUP BY ALL),
      s AS (SELECT observable_id, seed, CAST(sum(n) AS BIGINT) AS support_size, count(*) AS actual_splits,
        string_agg(n, ',' ORDER BY n) AS block_sizes FROM z GROUP BY ALL),
      o2 AS (SELECT observable_id, seed, block, detector_id, count(*) AS k FROM {blocks} JOIN checks USING (error_id) GROUP BY ALL),
      c AS (SELECT observable_id, seed, CAST(sum(k * (k - 1)) / 2 AS BIGINT) AS cycles FROM o2 GROUP BY ALL)
      SELECT CAST(observable_id AS BIGINT) AS observable_id, CAST(seed AS BIGINT) AS seed, support_size, actual_splits,
        block_sizes, coalesce(cycles, 0) AS cycles FROM s LEFT JOIN c USING (observable_id, seed)"""


for name, balanced in (("split_cycles", False), ("split_cycles_balanced", True)):
    add(
        name,
        lambda s, d, balanced=balanced: M.split_cycles(*edges(s, d), 3, range(4), balanced).withColumn(
            "block_sizes", F.array_join("block_sizes", ",")
        ),
        split_sql("bb" if balanced else "bl"),
    )
add(
    "monte_carlo_cycles",
    lambda s, d: rounded(M.monte_carlo_cycles(*edges(s, d), 3, 4), 9),
    f"""WITH r AS ({split_sql('bl')}) SELECT observable_id, count(*) AS samples, round(avg(cycles), 9) AS mean,
      round(stddev_pop(cycles), 9) AS std, min(cycles) AS min, max(cycles) AS max FROM r GROUP BY 1""",
)
add(
    "cycle_comparison",
    lambda s, d: M.compare_split(*edges(s, d), 3, 1).withColumn("block_sizes", F.array_join("block_sizes", ",")),
    f"""WITH r AS ({split_sql('bl')}), u AS (WITH {OVER} SELECT observable_id, cycles FROM cy)
      SELECT r.observable_id, support_size, coalesce(u.cycles, 0) AS unsplit_cycles, r.cycles AS split_cycles,
        CAST(3 AS BIGINT) AS requested_splits, actual_splits, block_sizes, seed AS split_seed
      FROM r LEFT JOIN u USING (observable_id) WHERE seed = 1""",
)
add(
    "monte_carlo_comparison",
    lambda s, d: rounded(M.compare_monte_carlo(*edges(s, d), 3, 4), 9),
    f"""WITH r AS ({split_sql('bl')}), u AS (WITH {OVER} SELECT observable_id, cycles FROM cy)
      SELECT r.observable_id, any_value(support_size) AS support_size, coalesce(any_value(u.cycles), 0) AS unsplit_cycles,
        round(coalesce(any_value(u.cycles), 0) / 3e0, 9) AS unsplit_over_m, count(*) AS samples,
        round(avg(r.cycles), 9) AS mean, round(stddev_pop(r.cycles), 9) AS std, min(r.cycles) AS min,
        max(r.cycles) AS max, CAST(3 AS BIGINT) AS n_splits FROM r LEFT JOIN u USING (observable_id) GROUP BY 1""",
)
add(
    "model_size",
    lambda s, d: M.model_size(*edges(s, d)),
    f"""WITH {EDGES} SELECT (SELECT count(DISTINCT detector_id) FROM checks) AS n_checks,
      (SELECT count(*) FROM (SELECT error_id FROM checks UNION SELECT error_id FROM obs)) AS n_errors,
      (SELECT count(DISTINCT observable_id) FROM obs) AS n_observables""",
)
add(
    "symmetric_difference",
    lambda s, d: table(s, d, "events").select(
        "event_id",
        F.array_join(
            symmetric_difference(
                F.array(F.col("event_id") % 5, F.col("event_id") % 7),
                F.array(F.col("user_id") % 5, F.col("user_id") % 7),
            ), ",",
        ).alias("xor"),
    ),
    """WITH e AS (SELECT event_id, unnest(list_distinct([event_id % 5, event_id % 7])) AS x FROM events
        UNION ALL SELECT event_id, unnest(list_distinct([user_id % 5, user_id % 7])) FROM events),
      k AS (SELECT event_id, x FROM e GROUP BY ALL HAVING count(*) = 1),
      t AS (SELECT event_id, string_agg(x, ',' ORDER BY x) AS xor FROM k GROUP BY 1)
      SELECT event_id, coalesce(t.xor, '') AS xor FROM events LEFT JOIN t USING (event_id)""",
)

# ---- id ranges ---------------------------------------------------------------------------------
IDS = """ids AS (SELECT user_id % 3 AS g, event_id AS i FROM events
    WHERE event_id % 97 <> 0 AND (event_id // 1000) % 4 <> 2)"""


def _ids(s, d):
    return table(s, d, "events").where(
        (F.col("event_id") % 97 != 0) & (F.floor(F.col("event_id") / 1000) % 4 != 2)
    ).select((F.col("user_id") % 3).alias("g"), F.col("event_id").alias("i"))


def islands(by: str) -> str:
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""r AS (SELECT {lead} min(i) AS range_start, max(i) + 1 AS range_end FROM
        (SELECT {lead} i, i - row_number() OVER ({part} ORDER BY i) AS k FROM ids) GROUP BY {lead} k)"""


add(
    "covered_ranges",
    lambda s, d: I.covered_ranges(_ids(s, d), "i", block=500),
    f"WITH {IDS}, {islands('')} SELECT * FROM r",
)
add(
    "covered_ranges_grouped",
    lambda s, d: I.covered_ranges(_ids(s, d), "i", ["g"], block=64),
    f"WITH {IDS}, {islands('g')} SELECT * FROM r",
)
add(
    "uncovered_ranges",
    lambda s, d: I.uncovered_ranges(
        I.covered_ranges(_ids(s, d), "i", block=500), 10, _ids(s, d).agg(F.max("i")).first()[0] + 40, block=700
    ),
    f"""WITH {IDS}, {islands('')}, q AS (SELECT range_start, range_end FROM r UNION ALL SELECT max(i) + 50, max(i) + 50 FROM ids),
      p AS (SELECT greatest(10, coalesce(max(range_end) OVER (ORDER BY range_start, range_end
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10)) AS gap_start, range_start AS gap_end FROM q
        WHERE range_end > 10)
      SELECT * FROM p WHERE gap_start < gap_end""",
)
add(
    "dense_renumbering",
    lambda s, d: I.dense_ids(_ids(s, d), "i"),
    f"WITH {IDS} SELECT i, row_number() OVER (ORDER BY i) - 1 AS new_id FROM ids",
)
add(
    "even_batches",
    lambda s, d: I.even_batches(_ids(s, d), "i", 7),
    f"""WITH {IDS}, p AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS position FROM ids)
      SELECT g, i, position, ntile(7) OVER (ORDER BY i) - 1 AS batch FROM p""",
)
