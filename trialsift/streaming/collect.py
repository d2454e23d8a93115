"""Chunk files as a stream: exactly-once collection and running rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trialsift.functions.exprs import flag, ratio
from trialsift.session import cut_lineage
from trialsift.sources.collect import narrow_tables
from trialsift.sources.files import escape_glob


def read_chunk_stream(
    spark: SparkSession,
    chunk_root: str,
    schema: StructType | str,
    max_files: int = 1000,
    clean: str | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Chunk files of all runs below a folder, as they arrive.

    ``clean`` may be ``delete`` or ``archive`` to let the source drop files it has processed.
    """
    reader = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", "true")
    )
    if clean:
        reader = reader.option("cleanSource", clean)
        if archive:
            reader = reader.option("sourceArchiveDir", archive)
    return reader.parquet(escape_glob(chunk_root))


def stream_collect(
    chunks: DataFrame,
    out_dir: str,
    checkpoint: str,
    metric: str,
    keys: Sequence[str] = ("batch", "shot_id"),
    available_now: bool = True,
) -> StreamingQuery:
    """Append new chunks to the narrow tables, each trial once.

    The source never hands out a file twice, and a micro-batch replaces exactly its own
    ``epoch`` partition, so a repeated micro-batch leaves no duplicates.  Trials that a resubmitted
    task wrote again within a micro-batch are dropped there; across micro-batches the reader
    keeps the first epoch (:func:`read_collected`).
    """
    keys = list(keys)

    def publish(frame: DataFrame, epoch: int) -> None:
        # Written once; each narrow table then reads its own columns.
        frame = cut_lineage(frame.dropDuplicates(keys))
        for stem, table in narrow_tables(frame, metric, keys).items():
            target = f"{out_dir.rstrip('/')}/{stem}/epoch={epoch}"
            table.write.mode("overwrite").option("compression", "zstd").parquet(target)

    writer = chunks.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_collected(
    spark: SparkSession, out_dir: str, stem: str, keys: Sequence[str] = ("batch", "shot_id")
) -> DataFrame:
    """A collected narrow table; a trial that arrived in several epochs keeps the first one."""
    df = spark.read.option("basePath", f"{out_dir.rstrip('/')}/{stem}").parquet(
        f"{out_dir.rstrip('/')}/{escape_glob(stem)}"
    )
    rest = [c for c in df.columns if c not in (*keys, "epoch")]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "epoch").alias("r"))
    return first.select(*keys, "r.*")


def running_rates(
    chunks: DataFrame, by: Sequence[str] = (), accept: str | None = None
) -> DataFrame:
    """Trials, errors and accepted trials so far; for output mode ``update`` or ``complete``.

    There is no event time, hence no watermark: the state is one row per run.
    """
    sums = [F.count("*").alias("n_total"), F.sum(flag("is_logical_error")).alias("n_err")]
    if accept:
        sums.append(F.sum(flag(accept)).alias("n_accepted"))
    out = chunks.groupBy(*by).agg(*sums).withColumn("ler", ratio("n_err", "n_total"))
    return out.withColumn("accept_rate", ratio("n_accepted", "n_total")) if accept else out
