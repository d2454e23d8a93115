"""Session helpers: scratch space, lineage cuts and bucket counts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "trialsift", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local session, where driver and executors are one process, may go without the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    context = spark.sparkContext
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """New, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query when it has ended, not when the driver collects garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The table survives the loss of executors, is read column by column, and its size is known to
    the optimizer.  It is deleted when the application ends, or before by :func:`clear_scratch`.
    With ``free`` the shuffle files of the write are deleted as soon as it is done.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(_FREE)
        elif free:
            spark.conf.set(_FREE, before)
    _WRITTEN.append(path)
    written, fs = _file_system(spark, path)
    fs.deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables written by :func:`cut_lineage`; results built on them become unreadable."""
    removed = 0
    while _WRITTEN:
        path, fs = _file_system(spark, _WRITTEN.pop())
        removed += bool(fs.delete(path, True))
    return removed


def default_buckets(df: DataFrame) -> int:
    """Number of value ranges used to spread a large ordered computation over the cluster.

    A power of two near four ranges per shuffle partition, so that the range size falls as the
    cluster grows; the list of bounds stays below 4096 numbers.
    """
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = 32
    while buckets < wanted and buckets < 4096:
        buckets *= 2
    return buckets


# Plan nodes that make reading an input again expensive.
_COSTLY = frozenset(
    {
        "Join", "Aggregate", "Window", "Sort", "RepartitionByExpression", "Repartition",
        "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython",
        "Expand", "RebalancePartitions",
    }
)


def _costly(plan) -> bool:
    if plan.nodeName() in _COSTLY:
        return True
    children = plan.children()
    return any(_costly(children.apply(i)) for i in range(children.size()))


def is_costly(df: DataFrame) -> bool:
    """Whether reading ``df`` again would repeat joins, aggregations or Python work (no job runs)."""
    return _costly(df._jdf.queryExecution().optimizedPlan())


def settle(df: DataFrame, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Make a narrow input fit for several passes, and choose its number of value ranges.

    A plain scan is read again for each pass; the result of joins or aggregations is written to the
    shared folder once.  No estimate of a size decides anything: every input is cut into ranges, and
    Spark merges the partitions of a small one.
    """
    fixed = cut_lineage(df) if is_costly(df) else df
    return fixed, buckets or default_buckets(df)


def settle_table(df: DataFrame) -> DataFrame:
    """Side table of a join with its size known, so that Spark broadcasts it only if it is small."""
    return cut_lineage(df) if is_costly(df) else df


_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *packages: str) -> None:
    """Send package folders to the Python workers, once per application.

    Functions that run in tasks refer to these packages by name.
    """
    for folder in packages:
        key = (spark.sparkContext.applicationId, folder)
        if key in _SHIPPED:
            continue
        name = os.path.basename(folder.rstrip("/"))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for base, _, files in os.walk(folder):
                for file in sorted(files):
                    if file.endswith(".py"):
                        path = os.path.join(base, file)
                        out.write(path, os.path.join(name, os.path.relpath(path, folder)))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(key)


def ship_self(spark: SparkSession) -> None:
    """Send this package to the workers."""
    ship(spark, os.path.dirname(os.path.abspath(__file__)))
