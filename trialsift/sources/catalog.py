"""Catalog of a result lake whose parameters live in directory names.

Layout: ``root/<circuit k=v,...>/decoding_result/<decoder k=v,...>/<stem>_batch=<N>.parquet``.  A
batch is one Parquet file or a directory Spark wrote under that name.  Listing is Spark's own
(parallel) file listing; parsing, typing and pruning are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from trialsift.functions.exprs import col

# Parameters a circuit directory must name; folder between the two levels.
CIRCUIT_KEYS = ("code", "d", "p")
RESULT_FOLDER = "decoding_result"


def strip_quotes(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit("'\""))


def parse_params(name: str | Column) -> Column:
    """Map of the ``k=v`` parts of a comma-separated name; other parts are ignored."""
    parts = F.filter(F.split(col(name), ","), lambda s: F.contains(s, F.lit("=")))
    pairs = F.transform(
        parts,
        lambda s: F.struct(
            F.trim(F.substring_index(s, "=", 1)).alias("key"),
            F.trim(F.substr(s, F.instr(s, "=") + 1)).alias("value"),
        ),
    )
    return F.map_from_entries(pairs)


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per data file: path, both parameter maps, file stem, batch and length."""
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.{parquet,bin}")
            .load(root)
            .select("path", "length")
        )
    except AnalysisException as error:
        raise FileNotFoundError(f"no such lake: {root}") from error
    marker = f"/{RESULT_FOLDER}/"
    above = F.substring_index("path", marker, 1)
    below = F.substr(F.col("path"), F.instr("path", marker) + len(marker))
    rows = files.where(F.contains("path", F.lit(marker))).select(
        "path",
        "length",
        F.substring_index(above, "/", -1).alias("circuit_dir"),
        F.get(F.split(below, "/"), F.lit(0)).alias("decoder_dir"),
        F.get(F.split(below, "/"), F.lit(1)).alias("file_name"),
    )
    batch = r"^(.*)_batch=(\d+)\.(parquet|bin)$"
    rows = rows.where(F.rlike("file_name", F.lit(batch))).select(
        "path",
        "length",
        "circuit_dir",
        "decoder_dir",
        parse_params("circuit_dir").alias("circuit"),
        parse_params("decoder_dir").alias("decoder"),
        F.regexp_extract("file_name", batch, 1).alias("stem"),
        F.regexp_extract("file_name", batch, 2).cast("int").alias("batch"),
    )
    for key in CIRCUIT_KEYS:
        rows = rows.where(F.map_contains_key("circuit", key))
    return rows


def matches(params: str | Column, key: str, expected: Any) -> Column:
    """Typed comparison of one parameter; a missing key equals False only."""
    raw = strip_quotes(F.try_element_at(col(params), F.lit(key)))
    if isinstance(expected, bool):
        same = F.lower(raw) == F.lit(str(expected).lower())
        return F.coalesce(same, F.lit(expected is False))
    if isinstance(expected, int):
        same = raw.try_cast("bigint") == F.lit(expected)
    elif isinstance(expected, float):
        v, e = raw.try_cast("double"), F.lit(expected)
        scale = F.greatest(F.abs(v), F.abs(e)) * F.lit(1e-9)
        same = F.abs(v - e) <= F.greatest(scale, F.lit(1e-15))
    else:
        same = raw == F.lit(str(expected))
    return F.coalesce(same, F.lit(False))


def prune(
    catalog: DataFrame,
    circuit: Mapping[str, Any] | None = None,
    decoder: Mapping[str, Any] | None = None,
    exclude: Sequence[str] = (),
    metrics: Sequence[str] | None = None,
    decoders: Sequence[str] | None = None,
    batches: Iterable[int] | None = None,
    stems: Sequence[str] | None = None,
) -> DataFrame:
    """Keep catalog rows by parameters, metric, decoder, batch and file stem."""
    out = catalog
    for key, value in (circuit or {}).items():
        out = out.where(matches("circuit", key, value))
    for key, value in (decoder or {}).items():
        out = out.where(matches("decoder", key, value))
    for key in exclude:
        out = out.where(~F.map_contains_key("decoder", key))
    if metrics is not None:
        out = out.where(strip_quotes(F.try_element_at("decoder", F.lit("metric"))).isin(list(metrics)))
    if decoders is not None:
        out = out.where(
            strip_quotes(F.try_element_at("decoder", F.lit("decoder"))).isin(list(decoders))
        )
    if batches is not None:
        out = out.where(F.col("batch").isin(list(batches)))
    if stems is not None:
        out = out.where(F.col("stem").isin(list(stems)))
    return out


def with_detail(catalog: DataFrame, metric: str, decoders: Sequence[str] | None = None) -> DataFrame:
    """Directories of a metric that were written with detail statistics."""
    return prune(catalog, decoder={"get_detail_stat": True}, metrics=[metric], decoders=decoders)


def resolve_one(
    catalog: DataFrame,
    circuit: Mapping[str, Any] | None = None,
    decoder: Mapping[str, Any] | None = None,
    absent: Sequence[str] = ("ibm_reproduce",),
) -> Row:
    """The single directory (pair) with the given parameters.

    ``p`` is matched to 1e-12, and a circuit must not name an ``absent`` key unless asked for it.
    No match and several matches are errors.
    """
    circuit = dict(circuit or {})
    p = circuit.pop("p", None)
    out = prune(catalog, circuit, decoder)
    if p is not None:
        value = strip_quotes(F.try_element_at("circuit", F.lit("p"))).try_cast("double")
        out = out.where(F.abs(value - F.lit(float(p))) <= F.lit(1e-12))
    for key in absent:
        if key not in circuit:
            out = out.where(~F.map_contains_key("circuit", key))
    level = ["circuit_dir", "decoder_dir"] if decoder is not None else ["circuit_dir"]
    found = out.select(*level).distinct().limit(2).collect()
    if not found:
        raise FileNotFoundError("no directory matches the given parameters")
    if len(found) > 1:
        raise ValueError("several directories match: " + ", ".join(str(r.asDict()) for r in found))
    return found[0]


def distinct_params(catalog: DataFrame, key: str, kind: str = "double") -> DataFrame:
    """Sorted distinct values of a circuit parameter."""
    raw = strip_quotes(F.try_element_at("circuit", F.lit(key)))
    return (
        catalog.select(raw.try_cast(kind).alias(key))
        .where(F.col(key).isNotNull())
        .distinct()
        .orderBy(key)
    )


# ---- typed parameters of few directories (driver side, metadata only) -------------------------


def literal(raw: str) -> Any:
    """Value of one parameter: boolean, integer, float, else text without quotes."""
    text = raw.strip("'\"")
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def common_type(values: Iterable[Any]) -> str:
    """One SQL type for a parameter over the whole catalog."""
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return "boolean"
    if kinds == {int}:
        return "bigint"
    if kinds and kinds <= {int, float}:
        return "double"
    return "string"


def typed(value: Any, kind: str) -> Any:
    if value is None:
        return None
    if kind == "double":
        return float(value)
    if kind == "string":
        return str(value)
    return value


def run_directory_name(decoder: str, metric: str, options: Mapping[str, Any]) -> str:
    """Directory name of a run: decoder, metric, then its options sorted by name."""
    parts = [f"decoder={decoder}", f"metric={metric}"]
    parts += [f"{k}={options[k]!r}" for k in sorted(options)]
    return ",".join(parts)
