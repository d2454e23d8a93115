"""Layouts, sinks and life cycles of the lake, each written from all rows and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showcase.bins import rounded
from showcase.common import PAIRS, SHOTS, pairs, plain, shots, table
from showcase.lake import BATCHES, TRIALS, lake, trials, wide, write_chunks
from showcase.stats import long_sql, nearest
from trialsift.operators import pairs as P
from trialsift.operators import stats as S
from trialsift.session import scratch_path
from trialsift.sources import catalog as C
from trialsift.sources import collect as K
from trialsift.sources import ingest as N
from trialsift.sources import lake as L

QUERIES: dict[str, tuple] = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (lambda spark, sf, run=run: plain(run(spark, sf)), sql)


def _strict(s, d) -> DataFrame:
    """Trials of the one directory that a strict look-up finds."""
    catalog = lake(s, d)
    found = C.resolve_one(catalog, {"code": "surface_Z", "d": 5, "p": 0.002}, {"metric": "forced_gap_ml"})
    own = catalog.where((F.col("circuit_dir") == found.circuit_dir) & (F.col("decoder_dir") == found.decoder_dir))
    return L.read_lake(s, own, "forced_gap_ml").select("shot_id", "batch", "d", "p", "forced_gap_ml")


add(
    "strict_directory",
    _strict,
    f"""WITH {TRIALS} SELECT sid AS shot_id, lot AS batch, d, 0.002e0 AS p, forced_gap_ml FROM trials WHERE d = 5""",
)


def _legacy_layout(s, d) -> DataFrame:
    """Detailed statistics as older runs wrote them: one file per statistic, no second-best weight."""
    root, rows = scratch_path(s, "older"), trials(s, d)
    rows = rows.drop("batch", "shot_id").withColumnsRenamed({"sid": "shot_id", "lot": "batch"})
    for distance, p in ((3, 0.001), (5, 0.002)):
        circuit = f"{root}/code=surface_Z,d={distance},rounds={distance},noisemodel=si1000,p={p},xyz=False"
        run = C.run_directory_name("BP-LSD", "forced_gap_ml", {"get_detail_stat": True})
        mine = rows.where(F.col("d") == distance)

        def put(stem: str, column: str, name: str) -> None:
            table = mine.select("batch", "shot_id", F.col(column).alias(name))
            K.export_batches(table, f"{circuit}/{C.RESULT_FOLDER}/{run}", stem, BATCHES)

        put("metric=forced_gap_ml", "forced_gap_ml", "forced_gap_ml")
        put("logicalerror", "forced_is_logical_error", "is_logical_error")
        for name in ("stage1_weight", "stage1_obs_flip", "stage2_weight", "stage2_obs_flip"):
            put(f"metric={name}", f"forced_{name}", name)
    found = L.read_detail(s, C.scan_catalog(s, root), "forced_gap_ml", "forced")
    return found.select(
        "shot_id", "batch", "d", "forced_gap_ml", "forced_is_logical_error", "forced_stage1_weight",
        "forced_stage1_obs_flip", "forced_stage2_weight", "forced_stage2_obs_flip",
    )


add(
    "lake_older_layout",
    _legacy_layout,
    f"""WITH {TRIALS} SELECT sid AS shot_id, lot AS batch, d, forced_gap_ml, forced_is_logical_error,
      forced_stage1_weight, forced_stage1_obs_flip, forced_stage2_weight, forced_stage2_obs_flip FROM trials""",
)
add(
    "lake_split_sources_without_case",
    lambda s, d: L.read_split_sources(s, lake(s, d), with_case=False).select(
        "shot_id", "batch", "d", "linearize_logicalgap", "logical_gap"
    ),
    f"""WITH {TRIALS} SELECT sid AS shot_id, lot AS batch, d,
      forced_stage2_weight - forced_stage1_weight AS linearize_logicalgap, logical_gap FROM trials""",
)


def _degradation(s, d) -> DataFrame:
    """Degradation tables collected batch by batch, and read back through the catalog."""
    base = scratch_path(s, "degradation")
    circuit = f"{base}/code=surface_Z,d=3,rounds=3,noisemodel=si1000,p=0.001,xyz=False"
    run = f"{circuit}/{C.RESULT_FOLDER}/" + C.run_directory_name("BP", K.DEGRADATION, {})
    rows = trials(s, d).select(
        F.col("lot").alias("batch"),
        "shot_id",
        F.col("forced_is_logical_error").alias("is_logical_error"),
        F.col("forced_stage1_weight").alias("metric_baseline_weight"),
        F.col("forced_stage2_weight").alias("metric_forced_weight"),
        F.col("logical_gap").alias("metric_baseline_iteration"),
        F.col("forced_gap_ml").alias("metric_forced_iteration"),
    )
    for lot in BATCHES:
        chunks = f"{base}/chunks/batch={lot}"
        write_chunks(s, rows.where(F.col("batch") == lot).drop("batch"), chunks, 3)
        K.collect_degradation(s, chunks, run, lot)
    stem = f"metric={K.DEGRADATION}"
    found = L.read_stems(s, C.scan_catalog(s, base), {stem: [], "logicalerror": ["is_logical_error"]})
    return found.select(
        "shot_id", "batch", "logicalerror", "is_logical_error", "baseline_weight", "forced_weight",
        "baseline_iteration", "forced_iteration",
    )


add(
    "degradation_round_trip",
    _degradation,
    f"""WITH {TRIALS} SELECT shot_id, lot AS batch, forced_is_logical_error AS logicalerror,
      forced_is_logical_error AS is_logical_error, forced_stage1_weight AS baseline_weight,
      forced_stage2_weight AS forced_weight, CAST(logical_gap AS BIGINT) AS baseline_iteration,
      CAST(forced_gap_ml AS BIGINT) AS forced_iteration FROM trials""",
)


def _life_cycle(s, d) -> DataFrame:
    """Trials per batch through chunks, a merge that is cut off before it cleans up, and publishing."""
    base, rows, counts = scratch_path(s, "cycle"), wide(s, d), []
    for lot in BATCHES:
        chunks = f"{base}/chunks/batch={lot}"
        write_chunks(s, rows.where(F.col("batch") == lot), chunks, 5)
        K.compact(s, chunks, max_files=3, group=2, remove=False)
        K.collect_chunks(s, chunks, base, lot, "forced_gap_ml")
    opened = len(K.open_batches(s, base))
    for lot in BATCHES:
        removed = K.drop_chunks(s, f"{base}/chunks/batch={lot}")
        table = s.read.parquet(f"{base}/metric=forced_gap_ml_batch={lot}.parquet")
        counts.append(
            table.agg(
                F.lit(lot).alias("batch"), F.count("*").alias("trials"),
                F.lit(opened).alias("open_batches"), F.lit(removed).alias("files_removed"),
            )
        )
    return counts[0].unionByName(counts[1])


add(
    "chunk_life_cycle",
    _life_cycle,
    f"""WITH {TRIALS} SELECT lot AS batch, count(*) AS trials, 2 AS open_batches, 3 AS files_removed
      FROM trials GROUP BY 1""",
)


def _summary(s, d) -> DataFrame:
    path = scratch_path(s, "summary")
    rates = pairs(s, d).groupBy("case_label").agg(
        F.count("*").alias("n"), F.sum(F.col("forced_is_logical_error").cast("long")).alias("errors")
    )
    K.write_summary(rates, path, {"filters": {"metric": "forced_gap_ml", "d": [3, 5]}})
    return s.read.schema("case_label long, n long, errors long, filters string").json(path)


add(
    "result_summary",
    _summary,
    f"""WITH {PAIRS} SELECT case_label, count(*) AS n, CAST(sum(forced_is_logical_error::INT) AS BIGINT) AS errors,
      '{{"d": [3, 5], "metric": "forced_gap_ml"}}' AS filters FROM pairs GROUP BY 1""",
)
add(
    "reselection_indicators",
    lambda s, d: P.with_indicators(pairs(s, d)).select("shot_id", "y0", "y_star", "delta_fg", "delta_anc"),
    f"""WITH {PAIRS} SELECT shot_id, forced_stage1_obs_flip AS y0, forced_is_logical_error AS y_star,
      forced_gap_ml AS delta_fg, forced_stage2_weight - forced_stage1_weight AS delta_anc FROM pairs""",
)
add(
    "stat_columns_found",
    lambda s, d: rounded(
        S.summarize_stats(
            shots(s, d).select(
                F.col("event_type").alias("experiment"), "shot_id", "batch",
                F.col("score").alias("forced_iteration"), F.col("iteration").alias("baseline_iteration"),
            )
        ), 9, "mean", "std",
    ),
    f"""WITH {SHOTS}, named AS (SELECT event_type, score AS forced_iteration, iteration AS baseline_iteration FROM shots),
      u AS ({long_sql(['forced_iteration', 'baseline_iteration'], 'named', 'event_type AS experiment', 'stat_column')}),
      r AS (SELECT *, row_number() OVER (PARTITION BY experiment, stat_column ORDER BY value NULLS LAST) - 1 AS i,
        count(value) OVER (PARTITION BY experiment, stat_column) AS n FROM u)
      SELECT experiment, stat_column, count(*) AS rows, count(*) - count(value) AS null_count,
        count(value) AS finite_count, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std,
        min(value) AS min, {nearest('value', 0.25, '')} AS q25, median(value) AS median,
        {nearest('value', 0.75, '')} AS q75, max(value) AS max FROM r GROUP BY 1, 2""",
)


def _flip_sets(s, d) -> DataFrame:
    """Flip sets of all orders, from their lines, as binary files of sixteen batches and back."""
    trials = table(s, d, "lineitem").groupBy(
        (F.col("l_orderkey") % 16).cast("int").alias("batch"), F.col("l_orderkey").alias("shot_id")
    ).agg(
        F.collect_set(F.col("l_partkey") * 37 % 70_000).alias("flips"),
        F.max(F.col("l_returnflag") == "R").alias("is_logical_error"),
    )
    # Some trials have no flip at all.
    kept = F.when(F.col("shot_id") % 11 == 0, F.array().cast("array<bigint>")).otherwise(F.col("flips"))
    path = scratch_path(s, "flips")
    N.write_flip_sets(trials.withColumn("flips", kept), path)
    found = N.join_flip_labels(N.read_flip_sets(s, path), trials.select("batch", "shot_id", "is_logical_error"))
    return found.select("batch", "shot_id", F.array_join("flips", ",").alias("flips"), "is_logical_error")


add(
    "flip_sets_round_trip",
    _flip_sets,
    """SELECT l_orderkey % 16 AS batch, l_orderkey AS shot_id,
        CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(list(l_partkey * 37 % 70000))), ',') END AS flips,
        bool_or(l_returnflag = 'R') AS is_logical_error FROM lineitem GROUP BY l_orderkey""",
)


def _bit_shots(s, d) -> DataFrame:
    """Detector bits and observables of all events, as files of bit records and back."""
    events = table(s, d, "events").select(
        F.floor(F.col("event_id") / 700).alias("file"),
        F.col("event_id").alias("shot_id"),
        F.expr(
            "filter(sequence(0, 20), i -> (shiftright(event_id * 7919 + user_id * 104729, i) & 1) = 1)"
        ).alias("detectors"),
        F.array(F.col("event_type") == "error", F.col("user_id") % 3 == 0).alias("observables"),
    )
    path = scratch_path(s, "bits")
    N.write_bit_shots(events, path, 21, 2)
    found = N.read_bit_shots(s, f"{path}/part=*.b8", 21, 2)
    return found.select(
        F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("file"),
        F.col("shot_id").alias("pos"),
        F.array_join("detectors", ",").alias("detectors"),
        F.get("observables", F.lit(0)).alias("first"),
        F.get("observables", F.lit(1)).alias("second"),
    )


add(
    "bit_shots_round_trip",
    _bit_shots,
    """SELECT CAST(event_id // 700 AS BIGINT) AS file,
        row_number() OVER (PARTITION BY event_id // 700 ORDER BY event_id) - 1 AS pos,
        array_to_string(list_filter(range(21), lambda i: ((event_id * 7919 + user_id * 104729) >> CAST(i AS INTEGER)) & 1 = 1), ',') AS detectors,
        event_type = 'error' AS first, user_id % 3 = 0 AS second FROM events""",
)
