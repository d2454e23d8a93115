"""Reading trial tables from a result lake.

A read turns the pruned catalog into explicit file lists, one multi-file scan per file stem, and
joins the stems on ``(dir_id, batch, shot_id)``.  ``dir_id`` and ``batch`` come from a table of the
files; directory parameters are attached at the end as typed columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialsift.functions.registry import metric_names
from trialsift.sources.catalog import RESULT_FOLDER, common_type, literal, prune, typed, with_detail
from trialsift.sources.files import encoded, escape_glob

KEYS = ("dir_id", "batch", "shot_id")
_BROADCAST_ROWS = 100_000  # directories or files

# Columns of the detailed statistics and their names after reading.
DETAIL_NAMES = {
    "baseline_correction_weight": "stage1_weight",
    "baseline_logical_error": "stage1_obs_flip",
    "forced_correction_weight": "stage2_weight",
    "forced_logical_error": "stage2_obs_flip",
    "forced_2nd_best_correction_weight": "stage2_2ndbest_weight",
    "forced_2nd_best_logical_error": "stage2_2ndbest_obs_flip",
}


class Directories:
    """Directories of a pruned catalog with driver-side ids and typed parameters."""

    def __init__(self, rows: Sequence[Row]):
        names = sorted({(r.circuit_dir, r.decoder_dir) for r in rows})
        self.ids = {name: i for i, name in enumerate(names)}
        params: dict[int, dict[str, Any]] = {}
        for r in rows:
            i = self.ids[r.circuit_dir, r.decoder_dir]
            if i not in params:
                raw = {**r.circuit, **r.decoder}
                params[i] = {k: literal(v) for k, v in raw.items() if v is not None}
        self.params = params
        keys = sorted({k for p in params.values() for k in p})
        self.types = {k: common_type(p.get(k) for p in params.values()) for k in keys}

    def attach(self, df: DataFrame) -> DataFrame:
        """Add one typed column per parameter."""
        keys = [k for k in self.types if k not in df.columns]
        data = [
            (i, *[typed(p.get(k), self.types[k]) for k in keys]) for i, p in self.params.items()
        ]
        schema = T.StructType(
            [T.StructField("dir_id", T.IntegerType())]
            + [T.StructField(k, T._parse_datatype_string(self.types[k])) for k in keys]
        )
        table = df.sparkSession.createDataFrame(data, schema)
        return df.join(_small(table, len(data)), "dir_id")


# Directory pair and batch of a data file, from its path: a batch is a file or a folder of files.
_FILE = re.compile(rf"/([^/]+/{RESULT_FOLDER}/[^/]+)/[^/]+_batch=(\d+)\.(?:parquet|bin)(?:/|$)")


def read_files(
    spark: SparkSession, rows: Sequence[Row], ids: Mapping[tuple[str, str], int],
    columns: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Scan data files with their directory id and batch as columns.

    Directory and batch are parsed once from the path of each file, on the driver, whose file index
    holds the same list.  Rows meet them by the name of their file in one join with a table of the
    files, so the plan is the same for any number of files and no row's path is parsed.
    """
    # A label file may serve several directories, but is read once.
    paths = list(dict.fromkeys(r.path for r in rows))
    df = spark.read.option("recursiveFileLookup", "true").parquet(*[escape_glob(p) for p in paths])
    chosen = df.columns if columns is None else columns
    serves: dict[str, set[int]] = {}
    for r in rows:
        serves.setdefault(encoded(_FILE.search(r.path).group(1)), set()).add(ids[r.circuit_dir, r.decoder_dir])
    files = []
    for name in df.inputFiles():
        folder, batch = _FILE.search(name).groups()
        # Local paths are spelled with one slash or with three; a row has one of the two.
        spelled = {name, re.sub(r"^file:/+", "file:/", name), re.sub(r"^file:/+", "file:///", name)}
        files += [(n, int(batch), i) for n in sorted(spelled) for i in sorted(serves[folder])]
    table = spark.createDataFrame(files, "__file string, batch int, dir_id int")
    scanned = df.select(*chosen, F.col("_metadata.file_path").alias("__file"))
    # A file that the table does not name is an error, not a loss of rows.
    lost = F.raise_error(F.concat(F.lit("a file of no known directory: "), F.col("__file"))).cast("int")
    placed = scanned.join(_small(table, len(files)), "__file", "left")
    return placed.withColumn("dir_id", F.coalesce("dir_id", lost)).drop("__file")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of directories or files, broadcast while it is short; a plain join is right for any length."""
    return F.broadcast(table) if rows <= _BROADCAST_ROWS else table


def _with(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join two tables of trials on their keys.

    Ids and flags shrink to a small part in a file, so file sizes say nothing of rows; a table of trials is
    never for broadcasting.
    """
    return df.join(other.hint("merge"), list(KEYS), how)


def _collect(catalog: DataFrame) -> list[Row]:
    """File metadata on the driver; Spark's own file index holds the same list there."""
    return catalog.select(
        "path", "circuit_dir", "decoder_dir", "circuit", "decoder", "stem", "batch"
    ).collect()


def _batches(rows: Sequence[Row]) -> set[tuple[str, str, int]]:
    return {(r.circuit_dir, r.decoder_dir, r.batch) for r in rows}


def _within(rows: Sequence[Row], wanted: set[tuple[str, str, int]]) -> list[Row]:
    return [r for r in rows if (r.circuit_dir, r.decoder_dir, r.batch) in wanted]


def read_lake(
    spark: SparkSession,
    catalog: DataFrame,
    metric: str | Sequence[str],
    extra: Mapping[str, Sequence[str]] | None = None,
    circuit: Mapping[str, Any] | None = None,
    decoder: Mapping[str, Any] | None = None,
    exclude: Sequence[str] = (),
    decoders: Sequence[str] | None = None,
    batches: Sequence[int] | None = None,
    labels_from: str | None = None,
    params: bool = True,
) -> DataFrame:
    """Trials of one or several metrics with label, parameters and optional statistics.

    ``extra`` maps a file stem to the columns joined from it (inner join; a missing file is an
    error).  Batches without a label file are skipped.  ``labels_from`` takes the label from the
    one sibling directory of that metric with the same decoder.  Nothing found is an error.
    """
    frames = []
    for name in metric_names(metric):
        frame = _read_metric(
            spark, catalog, name, dict(extra or {}), circuit, decoder, exclude, decoders, batches,
            labels_from, params,
        )
        if frame is not None:
            frames.append(frame)
    if not frames:
        raise FileNotFoundError(f"no data for metric(s) {metric} with the given filters")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def _read_metric(
    spark, catalog, metric, extra, circuit, decoder, exclude, decoders, batches, labels_from, params
) -> DataFrame | None:
    chosen = prune(catalog, circuit, decoder, exclude, [metric], decoders, batches)
    stems = [f"metric={metric}", "logicalerror", *extra]
    rows = _collect(prune(chosen, stems=stems))
    by_stem = {s: [r for r in rows if r.stem == s] for s in stems}
    values = by_stem[f"metric={metric}"]
    if not values:
        return None
    if labels_from is None:
        labels = by_stem["logicalerror"]
    else:
        if labels_from == metric:
            raise ValueError("labels_from must name another metric")
        labels = _sibling_labels(catalog, values, labels_from, circuit)
    usable = _batches(values) & _batches(labels)
    values, labels = _within(values, usable), _within(labels, usable)
    if not values:
        return None
    directories = Directories(values)
    ids = directories.ids
    df = read_files(spark, values, ids, ["shot_id", metric])
    label = read_files(spark, labels, ids, ["shot_id", "is_logical_error"])
    df = _with(df, label)
    for stem, columns in extra.items():
        files = _within(by_stem[stem], usable)
        missing = _batches(values) - _batches(files)
        if missing:
            raise FileNotFoundError(f"{stem} is missing for {sorted(missing)[0]}")
        df = _with(df, read_files(spark, files, ids, ["shot_id", *columns]))
    return directories.attach(df) if params else df


def _sibling_labels(catalog, values, metric, circuit) -> list[Row]:
    """Label files of the sibling metric directories, entered under the directories they serve."""
    siblings = _collect(prune(catalog, circuit, metrics=[metric], stems=["logicalerror"]))
    found: list[Row] = []

    def name(r: Row) -> str:
        return (r.decoder.get("decoder") or "").strip("'\"")

    served: dict[tuple[str, str], list[Row]] = {}
    for r in values:
        served.setdefault((r.circuit_dir, r.decoder_dir), []).append(r)
    offered: dict[tuple[str, str], list[Row]] = {}
    for r in siblings:
        offered.setdefault((r.circuit_dir, name(r)), []).append(r)
    for (circuit_dir, decoder_dir), own in sorted(served.items()):
        files = offered.get((circuit_dir, name(own[0])), [])
        dirs = {r.decoder_dir for r in files}
        if len(dirs) != 1:
            state = "no" if not dirs else "more than one"
            raise FileNotFoundError(f"{state} sibling {metric} directory next to {decoder_dir}")
        missing = {r.batch for r in own} - {r.batch for r in files}
        if missing:
            raise FileNotFoundError(f"{metric} label files are missing for batches {missing}")
        for r in files:
            found.append(Row(**{**r.asDict(), "decoder_dir": decoder_dir}))
    return found


def swap_labels(df: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace ``is_logical_error`` by the label of another table of the same trials."""
    other = labels.select(*keys, F.col("is_logical_error").alias("__label"))
    return (
        df.drop("is_logical_error").join(other, list(keys))
        .withColumnRenamed("__label", "is_logical_error")
    )


# ---- detailed statistics -----------------------------------------------------------------------


def read_detail(
    spark: SparkSession,
    catalog: DataFrame,
    metric: str,
    prefix: str,
    decoders: Sequence[str] | None = None,
    circuit: Mapping[str, Any] | None = None,
    batches: Sequence[int] | None = None,
    params: bool = True,
) -> DataFrame:
    """Metric, label and detailed statistics with prefixed names.

    Batches without a ``detailed_stats`` file fall back to the older layout of one file per
    statistic (weights required, second-best ones optional).
    """
    rows = _collect(
        prune(with_detail(catalog, metric, decoders), circuit, batches=batches)
    )
    values = [r for r in rows if r.stem == f"metric={metric}"]
    if not values:
        raise FileNotFoundError(f"no detailed data for {metric}")
    labels = [r for r in rows if r.stem == "logicalerror"]
    details = [r for r in rows if r.stem == "detailed_stats"]
    lost = _batches(values) - _batches(labels)
    if lost:
        raise FileNotFoundError(f"label file is missing for {sorted(lost)[0]}")
    directories = Directories(values)
    ids, wanted = directories.ids, _batches(values)
    df = read_files(spark, values, ids, ["shot_id", metric])
    label = read_files(
        spark, _within(labels, wanted), ids,
        ["shot_id", F.col("is_logical_error").alias(f"{prefix}_is_logical_error")],
    )
    df = _with(df, label)
    names = {
        source: f"{prefix}_{target}"
        for source, target in DETAIL_NAMES.items()
        if metric == "forced_gap_ml" or "2ndbest" not in target
    }
    parts = []
    new = _within(details, wanted)
    if new:
        parts.append(_new_detail(spark, new, ids, names))
    old = wanted - _batches(new)
    if old:
        parts.append(_old_detail(spark, rows, old, ids, names))
    detail = parts[0]
    for part in parts[1:]:
        detail = detail.unionByName(part, allowMissingColumns=True)
    df = _with(df, detail)
    if not params:
        return df
    out = directories.attach(df)
    return out.withColumn(f"{prefix}_decoder", F.col("decoder").cast("string"))


def _new_detail(spark, rows, ids, names) -> DataFrame:
    scan = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true")
    schema = scan.parquet(*[escape_glob(r.path) for r in rows]).columns
    if "baseline_correction_weight" not in schema:
        raise ValueError("detailed_stats holds no column baseline_correction_weight")
    present = [s for s in names if s in schema]
    df = read_files(spark, rows, ids, ["shot_id", *present])
    return df.select(*KEYS, *[F.col(s).alias(names[s]) for s in present])


def _old_detail(spark, rows, wanted, ids, names) -> DataFrame:
    out = None
    for source, target in names.items():
        legacy = target.split("_", 1)[1]
        files = _within([r for r in rows if r.stem == f"metric={legacy}"], wanted)
        missing = wanted - _batches(files)
        if missing and "2ndbest" not in legacy:
            raise FileNotFoundError(f"metric={legacy} is missing for {sorted(missing)[0]}")
        if not files:
            continue
        df = read_files(spark, files, ids, ["shot_id", F.col(legacy).alias(target)])
        how = "inner" if "2ndbest" not in legacy else "left"
        out = df if out is None else _with(out, df, how)
    return out


def read_detail_pair(
    spark: SparkSession,
    catalog: DataFrame,
    left: str = "logical_gap",
    right: str = "forced_gap_ml",
    left_decoders: Sequence[str] | None = None,
    right_decoders: Sequence[str] | None = None,
    circuit: Mapping[str, Any] | None = None,
    batches: Sequence[int] | None = None,
) -> DataFrame:
    """Trials of two metrics joined within the same circuit, batch and id.

    Every left directory meets every right directory of its circuit, told apart by the columns
    ``logical_decoder`` and ``forced_decoder``.
    """
    a = read_detail(spark, catalog, left, "logical", left_decoders, circuit, batches)
    b = read_detail(spark, catalog, right, "forced", right_decoders, circuit, batches)
    names = sorted(_circuit_keys(catalog, circuit) & set(a.columns) & set(b.columns))
    keep = [c for c in b.columns if c.startswith("forced_")]
    a = a.withColumnRenamed("dir_id", "logical_dir_id")
    b = b.select(*names, "batch", "shot_id", F.col("dir_id").alias("forced_dir_id"), *keep)
    a_ = a.withColumn("__c", F.to_json(F.struct(*names)))
    b_ = b.withColumn("__c", F.to_json(F.struct(*names))).drop(*names)
    joined = a_.join(b_.hint("merge"), ["__c", "batch", "shot_id"]).drop("__c")
    return joined


def _circuit_keys(catalog: DataFrame, circuit) -> set[str]:
    keys = prune(catalog, circuit).select(F.explode(F.map_keys("circuit")).alias("k")).distinct()
    return {r.k for r in keys.collect()}


def read_stems(
    spark: SparkSession,
    catalog: DataFrame,
    columns: Mapping[str, Sequence[str]],
    metric: str | None = None,
    circuit: Mapping[str, Any] | None = None,
    decoder: Mapping[str, Any] | None = None,
    exclude: Sequence[str] = (),
    decoders: Sequence[str] | None = None,
    batches: Sequence[int] | None = None,
) -> DataFrame:
    """Inner join of several file stems of the same directories, for batches that have them all.

    Used for case labels, degradation tables and decoder statistics, for instance
    ``{"metric=forced_gap_ml_case": ["forced_gap_ml_case"], "logicalerror": [...]}``.
    """
    chosen = prune(
        catalog, circuit, decoder, exclude, None if metric is None else [metric], decoders,
        batches, list(columns),
    )
    rows = _collect(chosen)
    by_stem = {s: [r for r in rows if r.stem == s] for s in columns}
    usable = set.intersection(*[_batches(v) for v in by_stem.values()])
    if not usable:
        raise FileNotFoundError(f"no batch holds all of {list(columns)}")
    directories = Directories(_within(next(iter(by_stem.values())), usable))
    out = None
    for stem, names in columns.items():
        # No column list: everything the files hold.
        wanted = ["shot_id", *names] if names else None
        df = read_files(spark, _within(by_stem[stem], usable), directories.ids, wanted)
        out = df if out is None else _with(out, df)
    return directories.attach(out)


def read_experiments(
    spark: SparkSession,
    catalog: DataFrame,
    experiments: Mapping[str, Mapping[str, Any]],
    stem: str = "decoder_stat",
) -> DataFrame:
    """Decoder statistics of several experiments, labelled in the column ``experiment``.

    Each experiment is a set of arguments of :func:`read_stems` (metric, circuit, decoder, exclude,
    decoders, batches).
    """
    out = None
    for label, options in experiments.items():
        df = read_stems(spark, catalog, {stem: []}, **options).withColumn("experiment", F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("at least one experiment is needed")
    return out


def split_filters(
    random_split: bool | None, n_splits: int | None = None, split_seed: int | None = None,
    detail: bool | None = None,
) -> dict[str, Any]:
    """Directory filters of a split configuration; None stands for the ordinary directories.

    Both spellings of the split flag found in old names are excluded there.
    """
    decoder: dict[str, Any] = {} if detail is None else {"get_detail_stat": bool(detail)}
    if random_split is None:
        exclude = ["random_split", "randon_split", "n_splits"]
        if detail is None:
            exclude.append("get_detail_stat")
        return {"decoder": decoder, "exclude": exclude}
    decoder["random_split"] = bool(random_split)
    exclude = []
    if n_splits is None:
        exclude.append("n_splits")
    else:
        decoder["n_splits"] = int(n_splits)
    if split_seed is not None:
        decoder["split_seed"] = int(split_seed)
    elif exclude:
        exclude.append("split_seed")
    return {"decoder": decoder, "exclude": exclude}


def read_split_sources(
    spark: SparkSession,
    catalog: DataFrame,
    circuit: Mapping[str, Any] | None = None,
    linear_decoders: Sequence[str] | None = None,
    forced_decoders: Sequence[str] | None = None,
    exact_decoders: Sequence[str] | None = None,
    batches: Sequence[int] | None = None,
    with_case: bool = True,
) -> DataFrame:
    """Linearised, forced (with case) and exact gap of the same trials; NULL rows are dropped.

    Without ``with_case`` only the linearised and the exact gap are joined.
    """
    from trialsift.operators.pairs import TRIAL_KEYS

    lin = read_lake(
        spark, catalog, "linearize_logicalgap", circuit=circuit, decoders=linear_decoders,
        batches=batches,
    )
    exact = read_lake(
        spark, catalog, "logical_gap", circuit=circuit, decoders=exact_decoders, batches=batches
    )
    frames = [(lin, ["linearize_logicalgap"])]
    required = ["linearize_logicalgap", "logical_gap"]
    if with_case:
        forced = read_stems(
            spark,
            catalog,
            {
                "metric=forced_gap_ml": ["forced_gap_ml"],
                "metric=forced_gap_ml_case": ["forced_gap_ml_case"],
                "logicalerror": ["is_logical_error"],
            },
            metric="forced_gap_ml",
            circuit=circuit,
            decoders=forced_decoders,
            batches=batches,
        ).withColumnRenamed("is_logical_error", "is_logical_error_fg")
        frames.append((forced, ["forced_gap_ml", "forced_gap_ml_case", "is_logical_error_fg"]))
        required.append("forced_gap_ml_case")
    frames.append((exact, ["logical_gap"]))
    shared = set.intersection(*[set(f.columns) for f, _ in frames])
    keys = ["shot_id", *[k for k in TRIAL_KEYS if k in shared]]
    out = None
    for frame, columns in frames:
        part = frame.select(*keys, *columns)
        out = part if out is None else out.join(part.hint("merge"), keys)
    return out.dropna(subset=required)
