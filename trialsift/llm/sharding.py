"""Reproducible shards: a Feistel permutation of global row numbers.

Rows are numbered 0 .. N-1 in the order of their key.  The permutation works on pairs (left, right)
of ``Z_a x Z_b`` with ``a * b`` just above N (a generalised Feistel network); a number that leaves
0 .. N-1 walks on along its cycle until it is back.  The permuted number ``p`` gives shard ``p % k``
and slot ``p // k``: shards differ by one row at most and slots have no gaps.  Shard and slot of a
row number can be computed, and inverted, without any data.

Row numbers need one count per key range and one exchange by key range, in which the texts travel
along; no task holds more than its range.  Everything is an expression of Spark SQL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.llm.common import fresh, hashable, others, quoted
from trialsift.plans.ranges import sketch_bounds, with_ranges

ROUNDS = 6
# A number is outside with a chance below 1 / sqrt(N), so 40 steps suffice for any N in practice;
# a walk that is not back by then fails the query instead of giving a wrong place.
MAX_WALK = 40


def _sizes(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _noise(value: Column, round_: Column, seed: int) -> Column:
    """Sixty pseudo-random bits of a value in a round."""
    text = F.concat_ws(":", F.lit(str(seed)), round_.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _once(x: Column, n: int, seed: int, forward: bool) -> Column:
    """The network applied once to numbers below a * b, or undone."""
    a, b = _sizes(n)
    rounds = list(range(ROUNDS)) if forward else list(range(ROUNDS - 1, -1, -1))

    def step(state: Column, r: Column) -> Column:
        left, right = state["l"], state["r"]
        width = F.when(r % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
        if forward:
            moved = (left + _noise(right, r, seed) % width) % width
            return F.struct(right.alias("l"), moved.alias("r"))
        back = F.pmod(right - _noise(left, r, seed) % width, width)
        return F.struct(back.alias("l"), left.alias("r"))

    # Even rounds have left in Z_a and right in Z_b; an even number of rounds ends as it began.
    start = F.struct((x % a).alias("l"), F.floor(x / a).alias("r"))
    order = F.expr(f"array({','.join(map(str, rounds))})")
    return F.aggregate(order, start, step, lambda s: s["r"] * F.lit(a).cast("long") + s["l"])


def permuted(number: Column, n: int, seed: int = 0, forward: bool = True) -> Column:
    """Place of row ``number`` among ``n`` rows (or the number of a place, if not ``forward``)."""
    if n <= 0:
        return F.lit(None).cast("long")

    def walk(x: Column, k: Column) -> Column:
        return F.when((k > 0) & (x < n), x).otherwise(_once(x, n, seed, forward))

    steps = F.expr(f"sequence(0, {MAX_WALK})")
    place = F.aggregate(steps, number.cast("long"), walk)
    checked = F.when(place < n, place)
    lost = F.raise_error(F.lit("the walk of a row number did not end")).cast("long")
    return F.when(number.isNotNull(), F.coalesce(checked, lost))


def numbered(df: DataFrame, key: str, name: str, extra: Sequence[Column] = ()) -> tuple[DataFrame, int]:
    """``df`` with its global row number by ``key`` (NULL first), and the number of rows.

    Equal keys are ordered by a hash of the row, so that only rows equal in all columns are
    interchangeable.
    """
    (bucket,) = fresh(df, "bucket")
    bounds = sketch_bounds(df, {"k": quoted(key)})["k"]
    ranged = with_ranges(df, {bucket: (quoted(key), bounds)})
    ranged = ranged.withColumn(
        bucket, F.when(quoted(key).isNull(), F.lit(-1)).otherwise(F.coalesce(quoted(bucket), F.lit(0)))
    )
    # One row per key range: at most 4098, whatever the size of the table.
    counts = {r[0]: r[1] for r in ranged.groupBy(bucket).count().collect()}
    total, offsets = 0, [0] * (max(counts, default=-1) + 2)
    for b in sorted(counts):
        offsets[b + 1], total = total, total + counts[b]
    inside = Window.partitionBy(bucket).orderBy(
        quoted(key).asc_nulls_first(), F.xxhash64(*hashable(df)), *extra
    )
    before = F.expr(f"array({','.join(f'{o}L' for o in offsets)})")
    number = F.get(before, quoted(bucket) + 1) + F.row_number().over(inside) - 1
    return ranged.select(*others(df, (name,)), number.alias(name)), total


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """All columns of ``docs`` and ``shard`` (int), ``slot`` (long) and ``row_number`` (long).

    NULL keys come first in the numbering; repeated rows get places of their own.  An empty table
    gives an empty table.  Columns with the names of outputs are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows, n = numbered(docs.select(*others(docs, ("shard", "slot", "row_number"))), key, "row_number")
    (place,) = fresh(rows, "place")
    rows = rows.withColumn(place, permuted(F.col("row_number"), n, seed))
    return rows.select(
        *others(rows, (place,)),
        (quoted(place) % shards).cast("int").alias("shard"),
        F.floor(quoted(place) / shards).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", seed: int = 0) -> None:
    """One folder per shard, its rows in the order of their slots."""
    assigned = assign_shards(docs, shards, key, seed)
    assigned.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
