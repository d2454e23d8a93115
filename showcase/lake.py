"""Lake reading, chunk collection, streams and the batch scorer, on data derived from the tables.

The lake is written below the cluster's shared folder once per session and table directory; it
grows with the tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showcase.common import PAIRS, div, pairs, plain, table
from trialsift.operators.scorer import ScoreResult, score_batches
from trialsift.session import cut_lineage, scratch_path
from trialsift.sources import catalog as C
from trialsift.sources import collect as K
from trialsift.sources import lake as L
from trialsift.sources.files import delete, exists, make_folder, rename
from trialsift.streaming import collect as T

QUERIES: dict[str, tuple] = {}
_LAKES: dict[tuple, str] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (lambda spark, sf, run=run: plain(run(spark, sf)), sql)


# A trial is known by (d, batch, shot_id); ids restart in every batch.
TRIALS = PAIRS + """, trials AS (SELECT CAST(CASE WHEN shot_id % 2 = 0 THEN 3 ELSE 5 END AS BIGINT) AS d,
    CAST(1 + (shot_id // 2) % 2 AS BIGINT) AS lot, shot_id // 4 AS sid, * FROM pairs)"""
BATCHES = (1, 2)
_DETAIL = {
    "baseline_correction_weight": "forced_stage1_weight",
    "baseline_logical_error": "forced_stage1_obs_flip",
    "forced_correction_weight": "forced_stage2_weight",
    "forced_logical_error": "forced_stage2_obs_flip",
    "forced_2nd_best_correction_weight": "forced_gap_ml",
    "forced_2nd_best_logical_error": "forced_stage2_2ndbest_obs_flip",
}


def trials(s: SparkSession, d: str) -> DataFrame:
    p = pairs(s, d)
    return p.select(
        F.when(F.col("shot_id") % 2 == 0, 3).otherwise(5).alias("d"),
        (F.floor(F.col("shot_id") / 2) % 2 + 1).cast("int").alias("lot"),
        F.floor(F.col("shot_id") / 4).cast("bigint").alias("sid"),
        *p.columns,
    )


def build_lake(s: SparkSession, d: str) -> str:
    key = (s.sparkContext.applicationId, d)
    if key in _LAKES:
        return _LAKES[key]
    root = scratch_path(s, "lake")
    # Written once, by directory and batch: each statistic below reads its own columns of its own trials.
    staged = scratch_path(s, "trials")
    trials(s, d).write.partitionBy("d", "lot").parquet(staged)
    rows = s.read.parquet(staged)
    for distance, p in ((3, 0.001), (5, 0.002)):
        circuit = f"{root}/code=surface_Z,d={distance},rounds={distance},noisemodel=si1000,p={p},xyz=False"
        mine = rows.where(F.col("d") == distance).withColumnsRenamed(
            {"batch": "old_batch", "shot_id": "old_id"}
        ).withColumnsRenamed({"sid": "shot_id", "lot": "batch"})

        def put(run: str, stem: str, *columns) -> None:
            K.export_batches(
                mine.select("batch", "shot_id", *columns),
                f"{circuit}/{C.RESULT_FOLDER}/{run}", stem, BATCHES,
            )

        exact = C.run_directory_name("ILP", "logical_gap", {"get_detail_stat": True})
        forced = C.run_directory_name("BP-LSD", "forced_gap_ml", {"get_detail_stat": True})
        linear = C.run_directory_name("BP-LSD", "linearize_logicalgap", {})
        put(exact, "metric=logical_gap", "logical_gap")
        put(exact, "logicalerror", F.col("logical_is_logical_error").alias("is_logical_error"))
        put(
            exact, "detailed_stats",
            F.col("logical_stage1_weight").alias("baseline_correction_weight"),
            F.col("forced_stage1_obs_flip").alias("baseline_logical_error"),
        )
        put(forced, "metric=forced_gap_ml", "forced_gap_ml")
        put(forced, "metric=forced_gap_ml_case", F.col("case_label").cast("byte").alias("forced_gap_ml_case"))
        put(forced, "logicalerror", F.col("forced_is_logical_error").alias("is_logical_error"))
        put(forced, "detailed_stats", *[F.col(c).alias(n) for n, c in _DETAIL.items()])
        put(forced, "decoder_stat", F.col("forced_stage1_weight").alias("baseline_iteration"))
        put(linear, "metric=linearize_logicalgap",
            (F.col("forced_stage2_weight") - F.col("forced_stage1_weight")).alias("linearize_logicalgap"))
        put(linear, "logicalerror", F.col("forced_stage1_obs_flip").alias("is_logical_error"))
    delete(s, staged)
    _LAKES[key] = root
    return root


def lake(s, d) -> DataFrame:
    return C.scan_catalog(s, build_lake(s, d))


add(
    "lake_query",
    lambda s, d: L.read_lake(s, lake(s, d), "forced_gap_ml", circuit={"d": 3, "ibm_reproduce": False}).select(
        "shot_id", "batch", "d", "p", "noisemodel", "decoder", "xyz", "forced_gap_ml", "is_logical_error"
    ),
    f"""WITH {TRIALS} SELECT sid AS shot_id, lot AS batch, d, 0.001e0 AS p, 'si1000' AS noisemodel,
      'BP-LSD' AS decoder, false AS xyz, forced_gap_ml, forced_is_logical_error AS is_logical_error
      FROM trials WHERE d = 3""",
)
add(
    "lake_query_two_metrics",
    lambda s, d: L.read_lake(
        s, lake(s, d), ["logical_gap", "linearize_logicalgap"], circuit={"p": 0.002}, batches=[2]
    ).select("shot_id", "batch", "d", "metric", "logical_gap", "linearize_logicalgap", "is_logical_error"),
    f"""WITH {TRIALS}, t AS (SELECT * FROM trials WHERE d = 5 AND lot = 2)
      SELECT sid AS shot_id, lot AS batch, d, 'logical_gap' AS metric, logical_gap,
        CAST(NULL AS DOUBLE) AS linearize_logicalgap, logical_is_logical_error AS is_logical_error FROM t
      UNION ALL SELECT sid, lot, d, 'linearize_logicalgap', NULL, forced_stage2_weight - forced_stage1_weight,
        forced_stage1_obs_flip FROM t""",
)
add(
    "lake_extra_statistics",
    lambda s, d: L.read_lake(
        s, lake(s, d), "forced_gap_ml",
        extra={"decoder_stat": ["baseline_iteration"], "detailed_stats": ["forced_logical_error"]},
    ).select("shot_id", "batch", "d", "forced_gap_ml", "baseline_iteration", "forced_logical_error"),
    f"""WITH {TRIALS} SELECT sid AS shot_id, lot AS batch, d, forced_gap_ml, forced_stage1_weight AS baseline_iteration,
      forced_stage2_obs_flip AS forced_logical_error FROM trials""",
)
add(
    "lake_label_swap",
    lambda s, d: L.read_lake(
        s, lake(s, d), "forced_gap_ml", labels_from="linearize_logicalgap"
    ).select("shot_id", "batch", "d", "forced_gap_ml", "is_logical_error"),
    f"""WITH {TRIALS} SELECT sid AS shot_id, lot AS batch, d, forced_gap_ml,
      forced_stage1_obs_flip AS is_logical_error FROM trials""",
)
add(
    "lake_detail_pair",
    lambda s, d: L.read_detail_pair(s, lake(s, d)).select(
        "shot_id", "batch", "d", "logical_decoder", "forced_decoder", "logical_gap", "forced_gap_ml",
        "logical_is_logical_error", "forced_is_logical_error", "logical_stage1_weight",
        "forced_stage1_weight", "forced_stage2_weight", "forced_stage2_2ndbest_weight",
        "forced_stage2_2ndbest_obs_flip",
    ),
    f"""WITH {TRIALS} SELECT sid AS shot_id, lot AS batch, d, 'ILP' AS logical_decoder, 'BP-LSD' AS forced_decoder,
      logical_gap, forced_gap_ml, logical_is_logical_error, forced_is_logical_error, logical_stage1_weight,
      forced_stage1_weight, forced_stage2_weight, forced_gap_ml AS forced_stage2_2ndbest_weight,
      forced_stage2_2ndbest_obs_flip FROM trials""",
)
add(
    "lake_case_and_gap",
    lambda s, d: L.read_stems(
        s, lake(s, d),
        {"metric=forced_gap_ml": ["forced_gap_ml"], "metric=forced_gap_ml_case": ["forced_gap_ml_case"]},
        metric="forced_gap_ml", circuit={"d": 5},
    ).select("shot_id", "batch", "forced_gap_ml", "forced_gap_ml_case"),
    f"""WITH {TRIALS} SELECT sid AS shot_id, lot AS batch, forced_gap_ml, case_label AS forced_gap_ml_case
      FROM trials WHERE d = 5""",
)
add(
    "lake_experiments",
    lambda s, d: L.read_experiments(
        s, lake(s, d),
        {
            "near": {"metric": "forced_gap_ml", "circuit": {"d": 3}, **L.split_filters(None, detail=True)},
            "far": {"metric": "forced_gap_ml", "circuit": {"d": 5}, "batches": [1]},
        },
    ).select("experiment", "shot_id", "batch", "baseline_iteration"),
    f"""WITH {TRIALS} SELECT CASE WHEN d = 3 THEN 'near' ELSE 'far' END AS experiment, sid AS shot_id,
      lot AS batch, forced_stage1_weight AS baseline_iteration FROM trials WHERE d = 3 OR lot = 1""",
)
add(
    "lake_split_sources",
    lambda s, d: L.read_split_sources(s, lake(s, d)).select(
        "shot_id", "batch", "d", "linearize_logicalgap", "forced_gap_ml", "forced_gap_ml_case",
        "is_logical_error_fg", "logical_gap",
    ),
    f"""WITH {TRIALS} SELECT sid AS shot_id, lot AS batch, d,
      forced_stage2_weight - forced_stage1_weight AS linearize_logicalgap, forced_gap_ml,
      case_label AS forced_gap_ml_case, forced_is_logical_error AS is_logical_error_fg, logical_gap FROM trials""",
)
add(
    "lake_parameters_with_detail",
    lambda s, d: C.distinct_params(C.with_detail(lake(s, d), "forced_gap_ml", ["BP-LSD"]), "p"),
    f"WITH {TRIALS} SELECT DISTINCT CASE WHEN d = 3 THEN 0.001e0 ELSE 0.002e0 END AS p FROM trials",
)

# ---- chunks -------------------------------------------------------------------------------------


def wide(s, d) -> DataFrame:
    return trials(s, d).select(
        F.col("lot").alias("batch"),
        F.col("shot_id"),
        F.col("forced_is_logical_error").alias("is_logical_error"),
        F.col("forced_gap_ml").alias("metric_forced_gap_ml"),
        F.col("case_label").alias("metric_forced_gap_ml_case"),
        F.col("forced_stage1_weight").alias("detail_stat_stage1_weight"),
        F.col("forced_stage1_obs_flip").alias("detail_stat_stage1_obs_flip"),
        F.col("forced_stage2_weight").alias("detail_stat_stage2_weight"),
        F.col("forced_stage2_obs_flip").alias("detail_stat_stage2_obs_flip"),
        F.col("forced_stage1_weight").alias("decoder_stat_baseline_iteration"),
    )


def write_chunks(s, df: DataFrame, path: str, parts: int = 6) -> None:
    """Chunks of trials from one pass over the rows; a chunk has four files or fewer, however many the trials."""
    staged = scratch_path(s, "staged")
    numbered = df.withColumn("__chunk", F.pmod(F.xxhash64("shot_id"), F.lit(parts)))
    numbered = numbered.repartition(4 * parts, "__chunk", F.pmod(F.hash("shot_id"), F.lit(4)))
    numbered.write.partitionBy("__chunk").parquet(staged)
    for i in range(parts):
        target = f"{path}/chunk_{i:04d}.parquet"
        if exists(s, f"{staged}/__chunk={i}"):
            if not exists(s, path):
                make_folder(s, path)
            rename(s, f"{staged}/__chunk={i}", target)
        else:
            df.where("false").write.parquet(target)
    delete(s, staged)


def _collected(s, d) -> DataFrame:
    base, rows, found = scratch_path(s, "collect"), cut_lineage(wide(s, d)), []
    for lot in BATCHES:
        chunks, to = f"{base}/chunks/batch={lot}", f"{base}/out"
        write_chunks(s, rows.where(F.col("batch") == lot), chunks, 4)
        K.compact(s, chunks, max_files=2, group=2)
        K.collect_chunks(s, chunks, to, lot, "forced_gap_ml")
        out = s.read.parquet(f"{to}/logicalerror_batch={lot}.parquet")
        for stem in ("metric=forced_gap_ml", "metric=forced_gap_ml_case", "detailed_stats", "decoder_stat"):
            # Small as files, but not as rows: neither side is for broadcasting.
            out = out.join(s.read.parquet(f"{to}/{stem}_batch={lot}.parquet").hint("merge"), "shot_id")
        found.append(out.withColumn("batch", F.lit(lot)))
    return found[0].unionByName(found[1])


add(
    "collect_chunks",
    _collected,
    f"""WITH {TRIALS} SELECT lot AS batch, shot_id, forced_is_logical_error AS is_logical_error, forced_gap_ml,
      case_label AS forced_gap_ml_case, forced_stage1_weight AS baseline_correction_weight,
      forced_stage1_obs_flip AS baseline_logical_error, forced_stage2_weight AS forced_correction_weight,
      forced_stage2_obs_flip AS forced_logical_error, forced_stage1_weight AS baseline_iteration
      FROM trials""",
)


def _legacy(s, d) -> DataFrame:
    base, found = scratch_path(s, "legacy"), []
    for lot in BATCHES:
        rows = trials(s, d).where(F.col("lot") == lot)
        for name, c in (("stage1_weight", "forced_stage1_weight"), ("stage1_obs_flip", "forced_stage1_obs_flip"),
                        ("stage2_weight", "forced_stage2_weight")):
            rows.select("shot_id", F.col(c).alias(name)).write.parquet(f"{base}/metric={name}_batch={lot}.parquet")
    K.convert_legacy(s, base)
    for lot in BATCHES:
        found.append(s.read.parquet(f"{base}/detailed_stats_batch={lot}.parquet").withColumn("batch", F.lit(lot)))
    return found[0].unionByName(found[1])


add(
    "convert_legacy_statistics",
    _legacy,
    f"""WITH {TRIALS} SELECT lot AS batch, shot_id, forced_stage1_weight AS baseline_correction_weight,
      forced_stage1_obs_flip AS baseline_logical_error, forced_stage2_weight AS forced_correction_weight
      FROM trials""",
)


def _degradation(s, d) -> DataFrame:
    chunks = trials(s, d).select(
        "shot_id",
        F.col("forced_is_logical_error").alias("is_logical_error"),
        F.col("forced_stage1_weight").alias("metric_baseline_weight"),
        F.col("forced_stage2_weight").alias("metric_forced_weight"),
        F.col("logical_gap").alias("metric_baseline_iteration"),
        F.col("forced_gap_ml").alias("metric_forced_iteration"),
    )
    return K.degradation_table(chunks)


add(
    "forcing_degradation_table",
    _degradation,
    f"""WITH {TRIALS} SELECT shot_id, forced_is_logical_error AS logicalerror, forced_stage1_weight AS baseline_weight,
      forced_stage2_weight AS forced_weight, CAST(logical_gap AS BIGINT) AS baseline_iteration,
      CAST(forced_gap_ml AS BIGINT) AS forced_iteration FROM trials""",
)


def _streamed(s, d) -> DataFrame:
    base = scratch_path(s, "stream")
    rows = cut_lineage(wide(s, d))
    write_chunks(s, rows, f"{base}/chunks", 4)
    # A resubmitted task delivers some trials a second time.
    rows.where("shot_id % 5 = 0").coalesce(4).write.parquet(f"{base}/chunks/chunk_9999.parquet")
    schema = s.read.parquet(f"{base}/chunks/chunk_9999.parquet").schema
    stream = T.read_chunk_stream(s, f"{base}/chunks", schema, max_files=2)
    T.stream_collect(stream, f"{base}/out", f"{base}/checkpoint", "forced_gap_ml").awaitTermination()
    return T.read_collected(s, f"{base}/out", "metric=forced_gap_ml")


add(
    "stream_collect",
    _streamed,
    f"WITH {TRIALS} SELECT lot AS batch, shot_id, forced_gap_ml FROM trials",
)


def _running(s, d) -> DataFrame:
    base = scratch_path(s, "running")
    write_chunks(s, wide(s, d), f"{base}/chunks", 3)
    schema = s.read.parquet(f"{base}/chunks/chunk_0000.parquet").schema
    rates = T.running_rates(T.read_chunk_stream(s, f"{base}/chunks", schema, max_files=1), ["batch"])
    # The state is one row per run; every micro-batch replaces the small result table.
    query = (
        rates.writeStream.outputMode("complete")
        .foreachBatch(lambda frame, epoch: frame.write.mode("overwrite").parquet(f"{base}/rates"))
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return s.read.parquet(f"{base}/rates")


add(
    "stream_running_rates",
    _running,
    f"""WITH {TRIALS} SELECT lot AS batch, count(*) AS n_total, CAST(sum(forced_is_logical_error::INT) AS BIGINT) AS n_err,
      {div('sum(forced_is_logical_error::INT)', 'count(*)')} AS ler FROM trials GROUP BY 1""",
)


def _tasks(s, d) -> DataFrame:
    return table(s, d, "events").select(
        (F.col("user_id") % 4).alias("run"),
        (F.col("event_id") % 50 + 1).alias("num_shots"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "view", "skipped").otherwise("ok").alias("status"),
        (F.col("event_id") % 8).cast("double").alias("duration_s"),
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("error"))
        .alias("reason"),
        (F.col("event_id") * 100).alias("shot_id_start"),
        (F.col("event_id") * 100 + F.col("event_id") % 50 + 1).alias("shot_id_end"),
        F.col("event_id").alias("batch_id"),
    )


TASKS = """tasks AS (SELECT user_id % 4 AS run, event_id % 50 + 1 AS num_shots,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped' ELSE 'ok' END AS status,
    CAST(event_id % 8 AS DOUBLE) AS duration_s,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'error' END END AS reason
    FROM events)"""


def _sum(cond: str, value: str = "num_shots") -> str:
    return f"CAST(coalesce(sum({value}) FILTER ({cond}), 0) AS BIGINT)"


add(
    "run_summary",
    lambda s, d: K.run_summary(_tasks(s, d), ["run"]),
    f"""WITH {TASKS}, r AS (SELECT run, CAST(sum(num_shots) AS BIGINT) AS total_shots,
        {_sum("status = 'ok'")} AS executed_shots, {_sum("status = 'skipped'")} AS skipped_shots,
        {_sum("status = 'error'")} AS error_shots,
        sum(duration_s) FILTER (status = 'ok') AS ok_duration_s,
        {_sum("reason = 'timeout'")} AS timeouts_shots, {_sum("reason = 'timeout'", '1')} AS timeouts,
        {_sum("reason = 'error'")} AS failed_shots, {_sum("reason = 'error'", '1')} AS failed
        FROM tasks GROUP BY 1)
      SELECT *, {div('ok_duration_s', 'executed_shots')} AS avg_time_per_shot_s FROM r""",
)


def _manifest(s, d) -> DataFrame:
    base = scratch_path(s, "manifest")
    failed = _tasks(s, d).where("status = 'error'").select(
        "shot_id_start", "shot_id_end", "batch_id", F.lit("dets.b8").alias("dets_path"), "reason",
        F.lit(None).cast("string").alias("message"), F.lit(1).alias("attempts"),
    )
    K.write_manifest(failed, f"{base}/incomplete_shots")
    return K.manifest_totals(K.read_manifest(s, f"{base}/incomplete_shots"), ["reason"])


add(
    "incomplete_manifest",
    _manifest,
    f"""WITH {TASKS} SELECT reason, count(*) AS n_ranges, CAST(sum(num_shots) AS BIGINT) AS total_incomplete_shots
      FROM tasks WHERE status = 'error' GROUP BY 1""",
)


# ---- scorer -------------------------------------------------------------------------------------
class CountModel:
    """Toy scorer: predicts an error from the number of fired detectors."""

    def score(self, bits: np.ndarray, true_obs: np.ndarray | None = None) -> ScoreResult:
        fired = bits.sum(axis=1)
        return ScoreResult(
            predictions=fired >= 3,
            metrics={"fired": fired.astype(float), "__is_logical_error": fired == 4},
            detail_stats={"stage1_weight": fired * 0.5},
            decoder_stats={"known_truth": float(true_obs is not None)},
        )


def _scored(s, d) -> DataFrame:
    shots = table(s, d, "lineitem").select(
        F.xxhash64("l_orderkey").alias("batch"),
        F.col("l_orderkey").alias("shot_id"),
        F.array(
            F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04,
            F.col("l_linenumber") > 3,
        ).alias("detectors"),
        F.array(F.col("l_returnflag") == "R").alias("observables"),
    )
    wide_rows = score_batches(
        shots, CountModel,
        "batch long, shot_id long, is_logical_error boolean, metric_fired double, "
        "detail_stat_stage1_weight double, decoder_stat_known_truth double",
        model_key="count",
    )
    return wide_rows.groupBy("metric_fired", "detail_stat_stage1_weight", "decoder_stat_known_truth").agg(
        F.count("*").alias("n"), F.sum(F.col("is_logical_error").cast("long")).alias("n_err")
    )


add(
    "batch_scorer",
    _scored,
    """WITH t AS (SELECT (l_quantity > 25)::INT + (l_discount > 0.05)::INT + (l_tax > 0.04)::INT
        + (l_linenumber > 3)::INT AS f, l_returnflag = 'R' AS r FROM lineitem)
      SELECT CAST(f AS DOUBLE) AS metric_fired, f * 0.5e0 AS detail_stat_stage1_weight,
        1e0 AS decoder_stat_known_truth, count(*) AS n,
        CAST(sum(((f >= 3) <> r OR f = 4)::INT) AS BIGINT) AS n_err FROM t GROUP BY f""",
)
