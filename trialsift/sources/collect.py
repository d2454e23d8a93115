"""Collection of wide chunk tables into the narrow tables of a result lake.

Chunks are ``chunk_*.parquet`` files (or directories) with compacted ``parts/part_*.parquet`` next
to them.  Publishing is left to Spark's commit protocol: a target exists only once it is complete.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.functions.exprs import ratio
from trialsift.sources.files import delete, escape_glob, exists, glob, rename, size_of

# Column prefixes of a wide chunk and the names of the detailed statistics.
METRIC, DETAIL, STAT = "metric_", "detail_stat_", "decoder_stat_"
DETAIL_RENAMES = {
    "stage1_obs_flip": "baseline_logical_error",
    "stage1_weight": "baseline_correction_weight",
    "stage2_obs_flip": "forced_logical_error",
    "stage2_weight": "forced_correction_weight",
    "stage2_2ndbest_obs_flip": "forced_2nd_best_logical_error",
    "stage2_2nd_best_obs_flip": "forced_2nd_best_logical_error",
    "stage2_2ndbest_weight": "forced_2nd_best_correction_weight",
    "stage2_2nd_best_weight": "forced_2nd_best_correction_weight",
}
DEGRADATION = "forcing_degradation_test"
_BATCH = re.compile(r"_batch=(\d+)\.parquet$")


def chunk_paths(spark: SparkSession, chunk_dir: str) -> list[str]:
    """Chunks and parts to read; a chunk that a committed part holds is left out."""
    base = escape_glob(chunk_dir.rstrip("/"))
    parts = [p for p, _ in glob(spark, f"{base}/parts/part_*.parquet")]
    held = merged_chunks(spark, chunk_dir, parts)
    chunks = [p for p, _ in glob(spark, f"{base}/chunk_*.parquet") if _name(p) not in held]
    if not chunks and not parts:
        raise FileNotFoundError(f"no chunks below {chunk_dir}")
    return chunks + parts


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[1]


def merged_chunks(spark: SparkSession, chunk_dir: str, parts: Sequence[str]) -> set[str]:
    """Names of the chunks that committed parts hold, from the lists written before the parts."""
    base = chunk_dir.rstrip("/")
    lists = [f"{base}/parts/{_name(p).removesuffix('.parquet')}.members" for p in parts]
    lists = [path for path in lists if exists(spark, path)]
    if not lists:
        return set()
    return {r.value for r in spark.read.text([escape_glob(p) for p in lists]).collect()}


def read_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true")
    return reader.parquet(*[escape_glob(p) for p in paths])


def read_chunks(spark: SparkSession, chunk_dir: str) -> DataFrame:
    return read_paths(spark, chunk_paths(spark, chunk_dir))


def prefixed(columns: Sequence[str], prefix: str) -> list[str]:
    return sorted(c for c in columns if c.startswith(prefix))


def metrics_of(columns: Sequence[str]) -> list[str]:
    return [c.removeprefix(METRIC) for c in prefixed(columns, METRIC)]


def detail_columns(columns: Sequence[str]) -> list[Column]:
    """Detailed statistics under their published names; the first column wins a name."""
    chosen: dict[str, str] = {}
    for c in prefixed(columns, DETAIL):
        short = c.removeprefix(DETAIL)
        chosen.setdefault(DETAIL_RENAMES.get(short, short), c)
    return [F.col(c).alias(name) for name, c in chosen.items()]


def narrow_tables(chunks: DataFrame, metric: str, keys: Sequence[str] = ("shot_id",)):
    """Narrow tables of a wide chunk table, by file stem; a missing metric is an error."""
    names = metrics_of(chunks.columns)
    if not names:
        raise ValueError("chunks hold no metric column")
    if metric not in names:
        raise ValueError(f"metric {metric!r} is not among the chunk metrics {names}")
    keys = list(keys)
    tables = {"logicalerror": chunks.select(*keys, "is_logical_error")}
    for name in names:
        tables[f"metric={name}"] = chunks.select(*keys, F.col(METRIC + name).alias(name))
    details = detail_columns(chunks.columns)
    if details:
        tables["detailed_stats"] = chunks.select(*keys, *details)
    stats = prefixed(chunks.columns, STAT)
    if stats:
        tables["decoder_stat"] = chunks.select(
            *keys, *[F.col(c).alias(c.removeprefix(STAT)) for c in stats]
        ).sortWithinPartitions(*keys)
    if "obs_flip_idx" in chunks.columns:
        tables["obs_flip_idx"] = chunks.select(*keys, "obs_flip_idx").sortWithinPartitions(*keys)
    return tables


def _write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def collect_chunks(
    spark: SparkSession, chunk_dir: str, out_dir: str, batch: int, metric: str
) -> list[str]:
    """Publish one batch: labels, every metric, detailed and decoder statistics, flip sets.

    Returns the metric names.  Each table is a scan of its own columns of the chunks.
    """
    chunks = read_chunks(spark, chunk_dir)
    tables = narrow_tables(chunks, metric)
    for stem, table in tables.items():
        _write(table, f"{out_dir.rstrip('/')}/{stem}_batch={batch}.parquet")
    convert_legacy(spark, out_dir)
    return metrics_of(chunks.columns)


def convert_legacy(spark: SparkSession, out_dir: str) -> list[int]:
    """Build ``detailed_stats`` from the older one-file-per-statistic layout.

    Existing tables are never replaced and the old files stay, so the call can be repeated.
    Returns the batches converted.
    """
    base = escape_glob(out_dir.rstrip("/"))
    by_batch: dict[int, dict[str, str]] = {}
    for name in DETAIL_RENAMES:
        for pattern in (f"metric={name}_batch=*.parquet", f"{name}_batch=*.parquet"):
            for path, _ in glob(spark, f"{base}/{pattern}"):
                batch = int(_BATCH.search(path).group(1))
                by_batch.setdefault(batch, {}).setdefault(name, path)
    done = []
    for batch, files in sorted(by_batch.items()):
        target = f"{out_dir.rstrip('/')}/detailed_stats_batch={batch}.parquet"
        if exists(spark, target):
            continue
        joined, used = None, set()
        for name, path in sorted(files.items()):
            table = read_paths(spark, [path])
            published = DETAIL_RENAMES[name]
            if published in used or name not in table.columns:
                continue
            table = table.select("shot_id", F.col(name).alias(published))
            joined = table if joined is None else joined.join(table.hint("merge"), "shot_id")
            used.add(published)
        if joined is not None:
            _write(joined.sortWithinPartitions("shot_id"), target, mode="ignore")
            done.append(batch)
    return done


def degradation_table(chunks: DataFrame) -> DataFrame:
    """Forcing-degradation columns of wide chunks, checked and cast."""
    names = metrics_of(chunks.columns)
    missing = sorted({"baseline_weight", "forced_weight"} - set(names))
    if missing:
        raise ValueError(f"chunks lack {missing}")
    stages = [n for n in names if n.startswith("baseline_") and n != "baseline_weight"]
    if len(stages) != 1:
        raise ValueError(f"expected exactly one baseline statistic, found {stages}")
    suffix = stages[0].removeprefix("baseline_")
    if f"forced_{suffix}" not in names:
        raise ValueError(f"chunks lack the forced side of {suffix}")
    kind = "bigint" if suffix == "iteration" else "double"
    return chunks.select(
        "shot_id",
        F.col("is_logical_error").cast("boolean").alias("logicalerror"),
        F.col("metric_baseline_weight").cast("double").alias("baseline_weight"),
        F.col("metric_forced_weight").cast("double").alias("forced_weight"),
        F.col(f"metric_baseline_{suffix}").cast(kind).alias(f"baseline_{suffix}"),
        F.col(f"metric_forced_{suffix}").cast(kind).alias(f"forced_{suffix}"),
    )


def collect_degradation(
    spark: SparkSession, chunk_dir: str, out_dir: str, batch: int
) -> list[str]:
    """Publish one forcing-degradation batch; returns its value columns."""
    chunks = read_chunks(spark, chunk_dir)
    table = degradation_table(chunks)
    base = out_dir.rstrip("/")
    labels = chunks.select("shot_id", F.col("is_logical_error").cast("boolean"))
    _write(labels, f"{base}/logicalerror_batch={batch}.parquet")
    _write(table, f"{base}/metric={DEGRADATION}_batch={batch}.parquet")
    return table.columns[1:]


def next_part_index(spark: SparkSession, chunk_dir: str) -> int:
    found = glob(spark, f"{escape_glob(chunk_dir.rstrip('/'))}/parts/part_*.parquet")
    numbers = [int(m.group(1)) for p, _ in found if (m := re.search(r"part_(\d+)\.parquet$", p))]
    return max(numbers, default=0) + 1


def merge_group_size(max_files: int | None, group: int | None) -> int | None:
    """Chunks per merge; None switches merging off."""
    if not max_files or max_files <= 0:
        return None
    return group if group and group > 0 else min(200, max_files)


def compact(
    spark: SparkSession,
    chunk_dir: str,
    max_files: int | None = 1000,
    group: int | None = None,
    file_bytes: int = 128 * 1024 * 1024,
    remove: bool = True,
) -> list[str]:
    """Merge groups of chunks into parts of few, large files; returns the new parts.

    Only full groups are merged, and only once more than ``max_files`` chunks exist.  A list of its
    members is written before each part, and the chunks are removed after the part is committed; if
    the run ends in between, readers leave the listed chunks out, so no trial counts twice.
    """
    size = merge_group_size(max_files, group)
    base = chunk_dir.rstrip("/")
    parts = [p for p, _ in glob(spark, f"{escape_glob(base)}/parts/part_*.parquet")]
    held = merged_chunks(spark, base, parts)
    chunks = [p for p, _ in glob(spark, f"{escape_glob(base)}/chunk_*.parquet") if _name(p) not in held]
    if size is None or len(chunks) <= max_files:
        return []
    made = []
    for start in range(0, len(chunks) - size + 1, size):
        members = chunks[start : start + size]
        total = sum(size_of(spark, p) for p in members)
        target = f"{base}/parts/part_{next_part_index(spark, base):06d}.parquet"
        files = max(1, math.ceil(total / file_bytes))
        names = spark.createDataFrame([(_name(p),) for p in members], "value string")
        names.coalesce(1).write.mode("overwrite").text(target.removesuffix(".parquet") + ".members")
        _write(read_paths(spark, members).coalesce(files), target, mode="error")
        made.append(target)
        if remove:
            for path in members:
                delete(spark, path)
    return made


def open_batches(spark: SparkSession, out_dir: str) -> list[int]:
    """Batches that still have a chunk folder."""
    found = glob(spark, f"{escape_glob(out_dir.rstrip('/'))}/chunks/batch=*")
    numbers = [p.rsplit("batch=", 1)[1] for p, _ in found]
    return sorted(int(n) for n in numbers if n.isdigit())


def drop_chunks(spark: SparkSession, chunk_dir: str) -> int:
    """Remove chunks and parts of a published batch; returns how many were removed."""
    try:
        paths = chunk_paths(spark, chunk_dir)
    except FileNotFoundError:
        return 0
    return sum(delete(spark, p) for p in paths)


def summary_path(out_dir: str, batch: int) -> str:
    """Per-batch summary file, so that batches running at the same time never share one."""
    return f"{out_dir.rstrip('/')}/metadata/metadata_batch={batch}.json"


# ---- manifests and run summaries ---------------------------------------------------------------

RANGE_SCHEMA = (
    "shot_id_start long, shot_id_end long, num_shots long, batch_id long, dets_path string, "
    "reason string, message string, attempts int"
)
MANIFEST_SCHEMA = (
    f"schema_version int, ranges array<struct<{RANGE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>,"
    " total_incomplete_shots long"
)


def sized_ranges(ranges: DataFrame) -> DataFrame:
    """Incomplete ranges with their lengths and the standard columns."""
    sized = ranges.withColumn("num_shots", F.col("shot_id_end") - F.col("shot_id_start"))
    fields = [part.split() for part in RANGE_SCHEMA.split(", ")]
    return sized.select(
        *[
            (F.col(name) if name in sized.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in fields
        ]
    )


def manifest_totals(ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of incomplete ranges and of trials in them."""
    length = F.col("shot_id_end") - F.col("shot_id_start")
    return ranges.groupBy(*by).agg(
        F.count("*").alias("n_ranges"),
        F.coalesce(F.sum(length), F.lit(0)).alias("total_incomplete_shots"),
    )


def write_manifest(ranges: DataFrame, path: str) -> None:
    """Write the incomplete ranges as JSON lines, one range per line, from all tasks."""
    rows = sized_ranges(ranges).withColumn("schema_version", F.lit(1))
    rows.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Ranges of a manifest, one row per range.

    ``document``: each file is one JSON document with an array ``ranges``, as older runs wrote it.
    """
    if document:
        docs = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
        rows = docs.select(F.explode("ranges").alias("r")).select("r.*")
    else:
        rows = spark.read.schema(RANGE_SCHEMA).json(path)
    return rows.withColumn("attempts", F.coalesce("attempts", F.lit(1)))


def run_summary(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per status, time per finished trial, and incomplete trials by reason.

    ``tasks``: ``num_shots``, ``status`` (ok, skipped, anything else is an error), ``duration_s``
    and optionally ``reason`` (timeout, error).
    """
    n = F.col("num_shots")
    status = F.col("status")

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).alias(name)

    reasons = []
    if "reason" in tasks.columns:
        for reason, name in (("timeout", "timeouts"), ("error", "failed")):
            hit = F.col("reason") == reason
            reasons.append(total(F.when(hit, n).otherwise(0), f"{name}_shots"))
            reasons.append(total(F.when(hit, 1).otherwise(0), f"{name}"))
    out = tasks.groupBy(*by).agg(
        total(n, "total_shots"),
        total(F.when(status == "ok", n).otherwise(0), "executed_shots"),
        total(F.when(status == "skipped", n).otherwise(0), "skipped_shots"),
        total(F.when(~status.isin("ok", "skipped"), n).otherwise(0), "error_shots"),
        F.coalesce(
            F.sum(F.when(status == "ok", F.col("duration_s")).otherwise(0.0)), F.lit(0.0)
        ).alias("ok_duration_s"),
        *reasons,
    )
    return out.withColumn("avg_time_per_shot_s", ratio("ok_duration_s", "executed_shots"))


def write_summary(df: DataFrame, path: str, context: Mapping[str, Any] | None = None) -> None:
    """Write a result table as JSON lines, with constant context columns such as the filters."""
    out = df
    for name, value in (context or {}).items():
        out = out.withColumn(name, F.lit(json.dumps(value, sort_keys=True)))
    out.write.mode("overwrite").json(path)


def export_batches(
    df: DataFrame,
    out_dir: str,
    stem: str,
    batches: Sequence[int],
    batch_column: str = "batch",
) -> None:
    """Write a table under the per-batch file names of the lake, in one pass over it.

    For new data prefer :func:`write_partitioned`, whose parameters are real partition columns.
    """
    base, spark = out_dir.rstrip("/"), df.sparkSession
    staged = f"{base}/.{stem}-{uuid.uuid4().hex}"
    rows = df.where(F.col(batch_column).isin(list(batches)))
    rows.write.option("compression", "zstd").partitionBy(batch_column).parquet(staged)
    for b in batches:
        target = f"{base}/{stem}_batch={b}.parquet"
        if exists(spark, f"{staged}/{batch_column}={b}"):
            delete(spark, target)
            rename(spark, f"{staged}/{batch_column}={b}", target)
        else:
            _write(rows.where("false").drop(batch_column), target)
    delete(spark, staged)


def write_partitioned(df: DataFrame, path: str, params: Sequence[str], files: int | None = None):
    """Write with typed partition columns, so that Spark prunes directories by itself."""
    rows = df if files is None else df.repartition(files, *params)
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*params).parquet(path)
