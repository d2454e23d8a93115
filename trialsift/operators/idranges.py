"""Contiguous id ranges, their gaps, dense renumbering and even batches.

Ids are cut into fixed blocks.  Islands are found inside each block; only islands touching a block
border can continue in the next one, so just those (two per block at most) are stitched together.  They are
stitched in blocks of ``FAN`` blocks, what touches a border of these in blocks of as many again, and so
on up to the whole range of a long; no task sees more than ``2 * FAN`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.functions.exprs import col
from trialsift.plans.ranges import cumulative

BLOCK = 1_000_000
FAN = 65_536


def _window(by: Sequence[str], *rest: str):
    keys = [*by, *rest]
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _block_of(column: str, size: int) -> Column:
    """Number of the block that holds an id; whole-number arithmetic, also below zero."""
    return F.expr(f"({column} - pmod({column}, {size}L)) div {size}L")


def _split(ranges: DataFrame, by: Sequence[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Ranges that touch a border of their block, and the others."""
    first = F.col("block") * F.lit(size)
    touching = (F.col("range_start") == first) | (F.col("range_end") == first + F.lit(size))
    columns = [*by, "range_start", "range_end"]
    return ranges.where(touching).select(*columns), ranges.where(~touching).select(*columns)


def _stitch(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join ranges that continue each other within ``keys``."""
    order = _window(keys).orderBy("range_start")
    fresh = F.coalesce((F.col("range_start") > F.lag("range_end").over(order)).cast("long"), F.lit(1))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranges.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(so_far))
        .groupBy(*keys, "run")
        .agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"))
    )


def covered_ranges(
    df: DataFrame, id_column: str, by: Sequence[str] = (), block: int = BLOCK, fan: int = FAN
) -> DataFrame:
    """Maximal runs of consecutive ids as ``range_start``, ``range_end`` (exclusive)."""
    by = list(by)
    ids = df.select(*by, col(id_column).cast("long").alias("i")).where("i is not null").distinct()
    ids = ids.withColumn("block", _block_of("i", block))
    w = _window(by, "block").orderBy("i")
    # Within a run of consecutive ids the difference to the row number is constant.
    island = F.col("i") - F.row_number().over(w)
    parts = (
        ids.withColumn("island", island)
        .groupBy(*by, "block", "island")
        .agg(F.min("i").alias("range_start"), (F.max("i") + 1).alias("range_end"))
    )
    size, done = block, []
    border, inner = _split(parts, by, size)
    done.append(inner)
    while size * fan < 1 << 62:
        size *= fan
        merged = _stitch(border.withColumn("block", _block_of("range_start", size)), [*by, "block"])
        border, inner = _split(merged, by, size)
        done.append(inner)
    # The whole range of a long has few blocks of this size.
    out = _stitch(border, by).select(*by, "range_start", "range_end")
    for inner in done:
        out = out.unionByName(inner)
    return out


def uncovered_ranges(
    ranges: DataFrame, start: int, total: int, by: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Complement of sorted, disjoint ranges inside ``[start, start + total)`` per group.

    A group without any range does not appear; with no grouping, the whole span is returned then.
    """
    by = list(by)
    end = start + total
    spark = ranges.sparkSession
    r = ranges.where((F.col("range_end") > start) & (F.col("range_start") < end))
    if by:
        groups = ranges.select(*by).distinct()
    else:
        groups = spark.range(1).select()
    # A zero-length range at the end of the span closes the last gap of each group.
    closing = groups.select(
        *by,
        F.lit(end).cast("long").alias("range_start"),
        F.lit(end).cast("long").alias("range_end"),
    )
    r = r.select(*by, "range_start", "range_end").unionByName(closing)
    r = r.withColumn("block", F.floor(F.col("range_start") / F.lit(block)).cast("long"))
    # Furthest end of all ranges in earlier blocks, from one row per block.
    ends = r.groupBy(*by, "block").agg(F.max("range_end").alias("block_end"))
    earlier = _window(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "block", F.max("block_end").over(earlier).alias("before"))
    inside = _window(by, "block").orderBy("range_start", "range_end")
    local = F.max("range_end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    joined = r.withColumn("local", local).join(ends, [*by, "block"])
    previous = F.greatest(
        F.coalesce(F.greatest("local", "before"), F.lit(start)), F.lit(start)
    ).cast("long")
    gap_end = F.least("range_start", F.lit(end)).cast("long")
    gaps = joined.select(*by, previous.alias("gap_start"), gap_end.alias("gap_end"))
    return gaps.where(F.col("gap_start") < F.col("gap_end"))


def dense_ids(df: DataFrame, id_column: str, name: str = "new_id", buckets: int | None = None):
    """Map every distinct id to its position 0, 1, ... in ascending order."""
    table = cumulative(df.select(id_column).distinct(), id_column, buckets=buckets)
    return table.select(id_column, F.col("n_before").alias(name))


def batch_of(index: str | Column, total: str | Column | int, batches: int) -> Column:
    """Batch of a zero-based position when ``total`` rows are cut into contiguous even batches.

    Sizes differ by at most one, the larger batches come first.
    """
    i = col(index).cast("long")
    n = (F.lit(total) if isinstance(total, int) else col(total)).cast("long")
    m = F.lit(batches).cast("long")
    size = F.floor(n / m).cast("long")
    extra = n % m
    head = extra * (size + 1)
    return F.when(i < head, F.floor(i / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(i - head, size))
    ).cast("int")


def even_batches(
    df: DataFrame, order: str, batches: int, buckets: int | None = None
) -> DataFrame:
    """Number the rows by a unique column and cut them into even contiguous batches."""
    if batches < 1:
        raise ValueError("batches must be at least 1")
    table = cumulative(df, order, buckets=buckets).select(
        order, F.col("n_before").alias("position"), F.col("n_total").alias("__n")
    )
    return (
        df.join(table, order).withColumn("batch", batch_of("position", "__n", batches)).drop("__n")
    )


def batch_sizes(total: int, batches: int) -> list[int]:
    """Sizes of the even batches; none may be empty."""
    if not 1 <= batches <= total:
        raise ValueError("need 1 <= batches <= total")
    size, extra = divmod(total, batches)
    return [size + 1] * extra + [size] * (batches - extra)
