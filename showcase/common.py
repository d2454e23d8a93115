"""Inputs of the registered queries, in Spark and as SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.functions.exprs import z_value

Z = z_value(0.05)
Z2 = Z * Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Small integers as bigint, NaN and infinities as NULL, for comparison across engines."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind == "double":
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)
        columns.append(c.alias(name))
    return df.select(*columns)


# ---- SQL building blocks ------------------------------------------------------------------------


def num(x: float) -> str:
    """Literal parsed as a double."""
    text = repr(float(x))
    return text if "e" in text or "E" in text else f"{text}e0"


def div(k: str, n: str) -> str:
    return f"(CAST({k} AS DOUBLE) / NULLIF(CAST({n} AS DOUBLE), 0))"


def wilson(k: str, n: str, high: bool) -> str:
    p, nd = div(k, n), f"NULLIF(CAST({n} AS DOUBLE), 0)"
    centre = f"({p} + {num(Z2)} / ({nd} * 2e0))"
    half = (
        f"({num(Z)} * sqrt(({p} * (1e0 - {p})) / {nd} + {num(Z2)} / ({nd} * {nd} * 4e0)))"
    )
    return f"(({centre} {'+' if high else '-'} {half}) / ({num(Z2)} / {nd} + 1e0))"


def rate_sql(k: str, n: str, lead: str = "") -> str:
    return (
        f"{lead} CAST({k} AS BIGINT) AS count, CAST({n} AS BIGINT) AS total, {div(k, n)} AS rate, "
        f"{wilson(k, n, False)} AS ci_low, {wilson(k, n, True)} AS ci_high"
    )


def curve_sql(acc: str, err: str, total: str, err_total: str) -> str:
    return (
        f"1e0 - {div(acc, total)} AS abort_rate, {div(err, acc)} AS post_ler, "
        f"{wilson(err, acc, False)} AS ci_low, {wilson(err, acc, True)} AS ci_high, "
        f"CAST({acc} AS BIGINT) AS accepted, CAST({err} AS BIGINT) AS errors, "
        f"CAST({total} AS BIGINT) AS n_total, {div(err_total, total)} AS original_ler"
    )


# ---- trials from events: continuous scores -------------------------------------------------------

SHOTS = """shots AS (
  SELECT event_id AS shot_id, event_id % 8 AS batch, value AS score,
         event_type = 'error' AS is_error, user_id % 4 AS grp, event_type,
         CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id % 17 END AS iteration
  FROM events)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("shot_id"),
        (F.col("event_id") % 8).alias("batch"),
        F.col("value").alias("score"),
        (F.col("event_type") == "error").alias("is_error"),
        (F.col("user_id") % 4).alias("grp"),
        "event_type",
        F.when(F.col("user_id") % 10 == 0, None).otherwise(F.col("user_id") % 17).alias("iteration"),
    )


# ---- line items: discrete, tied scores -----------------------------------------------------------

LINES = """lines AS (
  SELECT l_quantity AS score, l_returnflag = 'R' AS is_error, l_linestatus = 'O' AS is_open,
         l_discount, l_tax, l_linenumber, l_orderkey
  FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("score"),
        (F.col("l_returnflag") == "R").alias("is_error"),
        (F.col("l_linestatus") == "O").alias("is_open"),
        "l_discount",
        "l_tax",
        "l_linenumber",
        "l_orderkey",
    )


# ---- orders and their lines: an exact / forced score pair with two stages -------------------------

PAIRS = """per_order AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, min(l_extendedprice) AS lo,
         max(l_extendedprice) AS hi, bool_or(l_returnflag = 'R') AS any_r,
         bool_or(l_linestatus = 'F' AND l_linenumber = 1) AS any_f
  FROM lineitem GROUP BY l_orderkey),
pairs AS (
  SELECT o_orderkey AS shot_id, o_orderkey % 8 AS batch,
    CASE WHEN o_custkey % 2 = 0 THEN 'ILP' ELSE 'ILP2' END AS logical_decoder, 'BP' AS forced_decoder,
    CAST(CAST(floor(o_totalprice / 5000e0) AS BIGINT) % 30 AS DOUBLE) AS logical_gap,
    CAST(CAST(qty AS BIGINT) % 30 AS DOUBLE) AS forced_gap_ml,
    o_orderstatus = 'F' AS logical_is_logical_error, any_r AS forced_is_logical_error,
    floor(lo / 1000e0) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS logical_stage1_weight,
    floor(lo / 1000e0) AS forced_stage1_weight, floor(hi / 2000e0) AS forced_stage2_weight,
    any_f AS forced_stage1_obs_flip, any_r AS forced_stage2_obs_flip,
    n_lines % 2 = 0 AS forced_stage2_2ndbest_obs_flip,
    CAST(n_lines % 5 - 1 AS BIGINT) AS case_label
  FROM orders JOIN per_order ON o_orderkey = l_orderkey)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.min("l_extendedprice").alias("lo"),
        F.max("l_extendedprice").alias("hi"),
        F.max(F.col("l_returnflag") == "R").alias("any_r"),
        F.max((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("any_f"),
    )
    o = table(spark, sf_dir, "orders")
    joined = o.join(per_order, o.o_orderkey == per_order.l_orderkey)
    low = F.floor(F.col("lo") / 1000.0).cast("double")
    return joined.select(
        F.col("o_orderkey").alias("shot_id"),
        (F.col("o_orderkey") % 8).alias("batch"),
        F.when(F.col("o_custkey") % 2 == 0, "ILP").otherwise("ILP2").alias("logical_decoder"),
        F.lit("BP").alias("forced_decoder"),
        (F.floor(F.col("o_totalprice") / 5000.0) % 30).cast("double").alias("logical_gap"),
        (F.col("qty").cast("bigint") % 30).cast("double").alias("forced_gap_ml"),
        (F.col("o_orderstatus") == "F").alias("logical_is_logical_error"),
        F.col("any_r").alias("forced_is_logical_error"),
        (low + F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(1.0)).alias(
            "logical_stage1_weight"
        ),
        low.alias("forced_stage1_weight"),
        F.floor(F.col("hi") / 2000.0).cast("double").alias("forced_stage2_weight"),
        F.col("any_f").alias("forced_stage1_obs_flip"),
        F.col("any_r").alias("forced_stage2_obs_flip"),
        (F.col("n_lines") % 2 == 0).alias("forced_stage2_2ndbest_obs_flip"),
        (F.col("n_lines") % 5 - 1).alias("case_label"),
    )


# Derived pair columns, as in the library.
DERIVED = """derived AS (
  SELECT *, forced_gap_ml - logical_gap AS gap_diff,
    abs(forced_stage1_weight - logical_stage1_weight) <= 1e-9 AS stage1_weight_same,
    CASE WHEN logical_is_logical_error THEN -logical_gap ELSE logical_gap END AS logical_gap_signed,
    CASE WHEN forced_is_logical_error THEN -forced_gap_ml ELSE forced_gap_ml END AS forced_gap_signed,
    CASE WHEN abs(forced_gap_ml - logical_gap) <= 1e-9 THEN 'exact'
         WHEN forced_gap_ml > logical_gap + 1e-9 THEN 'overestimate'
         ELSE 'underestimate' END AS gap_relation,
    forced_stage2_weight < forced_stage1_weight AS forced_override,
    forced_stage2_weight - forced_stage1_weight AS anchored_gap
  FROM pairs)"""


# ---- candidates: an order's header is the baseline, its lines are forced solutions ---------------

CANDIDATES = """cands AS MATERIALIZED (
  SELECT o_orderkey AS shot_id, 0 AS stage, 0 AS obs_idx, o_totalprice / 10e0 AS weight,
    (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END)
      + (CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END) AS cls,
    o_orderkey % 50 <> 0 AS converged, CAST(NULL AS DOUBLE) AS stat FROM orders
  UNION ALL
  SELECT l_orderkey, 1, l_linenumber, l_extendedprice,
    (CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END)
      + (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END),
    l_linenumber <> 7, l_quantity
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
base AS MATERIALIZED (SELECT * FROM cands WHERE stage = 0)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    header = o.select(
        F.col("o_orderkey").alias("shot_id"),
        F.lit(0).alias("stage"),
        F.lit(0).alias("obs_idx"),
        (F.col("o_totalprice") / 10.0).alias("weight"),
        F.array(F.col("o_orderstatus") == "F", F.col("o_orderpriority") < "3").alias("logical"),
        (F.col("o_orderkey") % 50 != 0).alias("converged"),
        F.lit(None).cast("double").alias("stat"),
    )
    forced = li.join(o.select("o_orderkey"), li.l_orderkey == o.o_orderkey, "left_semi").select(
        F.col("l_orderkey").alias("shot_id"),
        F.lit(1).alias("stage"),
        F.col("l_linenumber").alias("obs_idx"),
        F.col("l_extendedprice").alias("weight"),
        F.array(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F").alias("logical"),
        (F.col("l_linenumber") != 7).alias("converged"),
        F.col("l_quantity").alias("stat"),
    )
    return header.unionByName(forced)


TRUTH = """truth AS (SELECT o_orderkey AS shot_id,
  (CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 0 END)
    + (CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END) AS truth FROM orders)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("shot_id"),
        F.array(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 5 == 0).alias("truth"),
    )


def class_code(c: str):
    """Two class bits as a number."""
    return (F.get(c, F.lit(0)).cast("bigint") * 2 + F.get(c, F.lit(1)).cast("bigint"))


# ---- bipartite model: suppliers are checks, parts are mechanisms, sizes are observables -----------

EDGES = """checks AS (SELECT DISTINCT l_suppkey AS detector_id, l_partkey AS error_id FROM lineitem),
obs AS (SELECT p_size % 5 AS observable_id, p_partkey AS error_id FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    checks = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("detector_id"), F.col("l_partkey").alias("error_id"))
        .distinct()
    )
    obs = table(spark, sf_dir, "part").select(
        (F.col("p_size") % 5).alias("observable_id"), F.col("p_partkey").alias("error_id")
    )
    return checks, obs
