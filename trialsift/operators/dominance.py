"""Concordant minus discordant pairs of a weighted point set of any size.

Points are cut into strips along both axes.  A pair of points then lies in different strips of both axes,
which the counts of the grid cells decide; or in one y-strip but different x-strips; or in one x-strip.

* A y-strip is read in the order of y by one task, which keeps the weight of every x-strip so far.
* An x-strip is read in the order of x by one task and cut into pieces of at most ``max_rows`` points, which are
  counted as they come.  Pairs of different pieces are counted like those of different x-strips: the x-strip is
  read again in the order of y, with a weight for every piece.

So every point is sorted three times, however often its strip is cut.  A task holds a bulk of points and one number
for each strip or piece.  A strip or piece that holds one value has only ties and is not counted within.

The bounds of strips are quantile sketches.  They steer sizes only; the count is exact for any bounds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialsift.plans.ranges import is_hot, with_ranges
from trialsift.session import cut_lineage, ship_self

STRIPS = 128  # a power of two
_FEWEST = 8  # strips of points just over the limit
MAX_ROWS = 200_000


def count_excess(x: np.ndarray, y: np.ndarray, w: np.ndarray, g: np.ndarray | None = None) -> int:
    """Weighted concordant minus discordant pairs over strictly different x and y, within each group ``g``.

    A digit-by-digit pass over the ranks of y: at every bit, rows that share all higher bits are
    paired with the rows of the other bit value and a smaller x, by running sums.  The group stands
    before the highest bit, so that one pass counts many groups.
    """
    if len(x) < 2:
        return 0
    g = np.zeros(len(x), np.int64) if g is None else g
    by_y = np.lexsort((y, g))
    ys, gs = y[by_y], g[by_y]
    new_g = np.r_[True, gs[1:] != gs[:-1]]
    held = np.add.reduceat(w[by_y].astype(float), np.flatnonzero(new_g))
    exact = float((held * held).sum()) < 2.0**61
    w = w.astype(np.int64) if exact else w.astype(object)
    dense = np.cumsum(new_g | np.r_[True, ys[1:] != ys[:-1]]) - 1
    # Ranks of y and numbers of groups, both from 0.
    rank, group = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    group[by_y] = np.cumsum(new_g) - 1
    rank[by_y] = dense - dense[new_g][group[by_y]]
    order = np.lexsort((x, group))
    x, w, rank, group = x[order], w[order], rank[order], group[order]
    xr = np.cumsum(np.r_[True, (x[1:] != x[:-1]) | (group[1:] != group[:-1])])
    bits = int(rank.max()).bit_length()
    total = 0
    for level in range(bits - 1, -1, -1):
        prefix = (group << (bits - level - 1)) | (rank >> (level + 1))
        by_prefix = np.argsort(prefix, kind="stable")
        p, xs, ws = prefix[by_prefix], xr[by_prefix], w[by_prefix]
        bit = (rank[by_prefix] >> level) & 1
        ones = np.cumsum(ws * bit) - ws * bit
        zeros = np.cumsum(ws * (1 - bit)) - ws * (1 - bit)
        new_p = np.r_[True, p[1:] != p[:-1]]
        new_x = new_p | np.r_[True, xs[1:] != xs[:-1]]
        index = np.arange(len(p))
        start_p = np.maximum.accumulate(np.where(new_p, index, 0))
        start_x = np.maximum.accumulate(np.where(new_x, index, 0))
        smaller_ones = ones[start_x] - ones[start_p]
        smaller_zeros = zeros[start_x] - zeros[start_p]
        total += int((ws * bit * smaller_zeros).sum() - (ws * (1 - bit) * smaller_ones).sum())
    return total


_TOGETHER = 100_000  # rows of whole groups that are counted in one pass, unless one group holds more


def _count_sorted(batches):
    """Counts of groups from batches sorted by group; the last group of a batch may go on in the next one."""
    import pyarrow as pa

    def count(table: pa.Table) -> pa.RecordBatch:
        columns = (table.column(c).to_numpy() for c in ("x", "y", "w", "g"))
        return pa.RecordBatch.from_pydict({"excess": [str(count_excess(*columns))]})

    held, rows, enough = [], 0, _TOGETHER
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        g = table.column("g").to_numpy()
        first = int(np.searchsorted(g, g[-1]))  # of the group that may go on
        if first:
            yield count(table.slice(0, first))
            held, rows = table.slice(first).to_batches(), rows - first
        enough = max(_TOGETHER, 2 * rows)
    if rows:
        yield count(pa.Table.from_batches(held))


def _bulks(batches, size: int):
    """Columns g, x, y, w of at least ``size`` rows at a time, and whether they are the last ones."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= size:
            yield [np.concatenate(c) for c in zip(*held)], False
            held, rows = [], 0
        held.append([batch.column(c).to_numpy() for c in ("g", "x", "y", "w")])
        rows += batch.num_rows
    if held:
        yield [np.concatenate(c) for c in zip(*held)], True


def _cut_pieces(batches, max_rows: int):
    """Cut groups sorted by g and x into pieces, and count within each piece.

    The positions of a group fall into windows of ``max_rows``.  The values of x that begin and end in window k
    are piece 2k; a value that goes on after window k is piece 2k + 1 on its own.  Gives the points of groups with
    more than one window, with the piece as x, and the counts in rows of their own.
    """
    import pyarrow as pa

    kept, base, began = None, 0, 0  # rows of a window that may go on; the first one's position, and that of its value
    for bulk, last in _bulks(batches, max(_TOGETHER, max_rows)):
        g, x, y, w = bulk if kept is None else (np.concatenate(c) for c in zip(kept, bulk))
        new_g = np.r_[True, g[1:] != g[:-1]]
        new_x = new_g | np.r_[True, x[1:] != x[:-1]]
        heads, starts = np.flatnonzero(new_g), np.flatnonzero(new_x)
        group, run = np.cumsum(new_g) - 1, np.cumsum(new_x) - 1
        at = np.arange(len(g)) - heads[group] + np.where(group == 0, base, 0)
        begin = at[starts]
        begin[0] = began
        ends, tops = np.r_[starts[1:], len(g)] - 1, np.r_[heads[1:], len(g)] - 1
        alone = begin // max_rows != at[ends] // max_rows
        piece = (2 * (begin // max_rows) + alone)[run]
        ready = len(g)
        if not last:
            ready = int(np.argmax((group == group[-1]) & (at >= at[-1] // max_rows * max_rows)))
        inside = np.flatnonzero(~alone[run[:ready]])
        number = np.cumsum(new_g | np.r_[True, piece[1:] != piece[:-1]])[inside]
        yield pa.RecordBatch.from_pydict(
            {"g": [0], "x": [0], "y": [0.0], "w": [0], "excess": [str(count_excess(x[inside], y[inside], w[inside], number))]}
        )
        cut = np.flatnonzero((at[tops] >= max_rows)[group[:ready]])
        if len(cut):
            yield pa.RecordBatch.from_pydict(
                {"g": g[cut], "x": piece[cut], "y": y[cut], "w": w[cut], "excess": pa.nulls(len(cut), pa.string())}
            )
        if not last:
            kept, base, began = [c[ready:] for c in (g, x, y, w)], int(at[ready]), int(begin[run[ready]])


def _count_between(batches):
    """Count pairs of different x in groups sorted by g and y; x is a whole number from 0."""
    import pyarrow as pa

    group = value = None  # of the last row
    below = tied = np.zeros(0, np.int64)  # weight of every x in that group with a smaller y, and with the same y
    for (g, x, y, w), _ in _bulks(batches, _TOGETHER):
        found = count_excess(y, x, w, g)
        more = max(0, int(x.max()) + 1 - len(below))
        below, tied = np.pad(below, (0, more)), np.pad(tied, (0, more))
        same_g = g == group
        same_y = same_g & (y == value)
        for seen, rows in ((below, same_y), (below + tied, same_g & ~same_y)):
            exact = float(seen.sum()) * float(w.sum()) < 2.0**61
            lean = 2 * np.cumsum(seen) - seen - seen.sum()
            found += int(((w if exact else w.astype(object))[rows] * lean[x[rows]]).sum())
        if g[-1] != group:
            below, tied = np.zeros_like(below), np.zeros_like(tied)
        elif y[-1] != value:
            below, tied = below + tied, np.zeros_like(tied)
        group, value = g[-1], y[-1]
        last = (g == group) & (y == value)
        before = (g == group) & ~last
        np.add.at(below, x[before], w[before])
        np.add.at(tied, x[last], w[last])
        yield pa.RecordBatch.from_pydict({"excess": [str(found)]})


def _sorted(rows: DataFrame, by: str) -> DataFrame:
    """Whole groups in tasks of even size, sorted by ``by``."""
    return rows.select("g", "x", "y", "w").repartitionByRange("g").sortWithinPartitions("g", by)


def _wide(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("excess").cast("decimal(38,0)").alias("excess"))


def _small(rows: DataFrame) -> DataFrame:
    """Groups that fit a task; a task takes its groups in the order of their numbers, many at a time."""
    sorted_rows = rows.select("x", "y", "w", "g").repartition("g").sortWithinPartitions("g")
    return _wide(sorted_rows.mapInArrow(_count_sorted, "excess string"))


def _between(rows: DataFrame) -> DataFrame:
    return _wide(_sorted(rows, "y").mapInArrow(_count_between, "excess string"))


def _grid(cells: DataFrame) -> DataFrame:
    """Pairs of different strips on both axes, by running sums along the rows and columns of the grid.

    Every window holds one row or column, at most ``2 * STRIPS`` cells.
    """
    sides = cells.agg(F.collect_set("sx").alias("xs"), F.collect_set("sy").alias("ys"))
    full = sides.select(F.explode("xs").alias("sx"), "ys").select("sx", F.explode("ys").alias("sy"))
    full = full.join(cells, ["sx", "sy"], "left").fillna(0, ["w"])
    row = Window.partitionBy("sx")
    so_far = F.sum("w").over(row.orderBy("sy"))
    # Weight below less weight above, within the x-strip.
    lean = full.select("*", (2 * so_far - F.col("w") - F.sum("w").over(row)).alias("lean"))
    left = Window.partitionBy("sy").orderBy("sx").rowsBetween(Window.unboundedPreceding, -1)
    met = F.coalesce(F.sum("lean").over(left), F.lit(0))
    product = F.col("w").cast("decimal(19,0)") * met.cast("decimal(19,0)")
    return lean.select(product.cast("decimal(38,0)").alias("excess"))


def excess(points: DataFrame, max_rows: int = MAX_ROWS, strips: int = STRIPS) -> DataFrame:
    """One row: concordant minus discordant pairs of the points ``x, y, w``, as ``excess``.

    ``x`` and ``y`` are finite doubles, ``w`` a whole weight.  Points may repeat; no points give 0.
    """
    if strips < 4 or strips & (strips - 1) or strips > STRIPS:
        raise ValueError("the number of strips must be a power of two from 4 to 128")
    ship_self(points.sparkSession)
    zero = F.lit(0.0)  # a negative zero counts as zero
    rows = points.select((F.col("x") + zero).alias("x"), (F.col("y") + zero).alias("y"), F.col("w").cast("long").alias("w"))
    held = rows.count()
    if held <= max_rows:
        parts = [_small(rows.withColumn("g", F.lit(0)))]
    else:
        # Points are cut into as many strips as they need: a grid of more cells than points is of no use.
        needed = 1 << max(0, math.ceil(math.log2(2 * held / max_rows)))
        n = min(strips, max(_FEWEST, needed))
        shares = [i / n for i in range(1, n)]
        bx, by = rows.agg(*[F.percentile_approx(c, shares, 100 * strips) for c in ("x", "y")]).first()
        # A bound that repeats is a frequent value; it has a strip of its own, before the larger values of its range.
        cut = with_ranges(rows, {"sx": ("x", bx), "sy": ("y", by)}).select(
            "x", "y", "w", is_hot("x", bx).alias("ax"), is_hot("y", by).alias("ay"), "sx", "sy"
        )
        cut = cut.withColumns({s: 2 * F.col(s).cast("long") - F.col(a).cast("long") for s, a in (("sx", "ax"), ("sy", "ay"))})
        within_y = cut.where(~F.col("ay")).select(F.col("sy").alias("g"), F.col("sx").alias("x"), "y", "w")
        within_x = cut.where(~F.col("ax")).select(F.col("sx").alias("g"), "x", "y", "w")
        pieces = _sorted(within_x, "x").mapInArrow(
            lambda batches: _cut_pieces(batches, max_rows), "g long, x long, y double, w long, excess string"
        )
        pieces = cut_lineage(pieces, free=True)
        parts = [
            _grid(cut_lineage(cut.groupBy("sx", "sy").agg(F.sum("w").alias("w")), free=True)),
            _between(within_y),
            _wide(pieces.where(F.col("excess").isNotNull())),
            _between(pieces.where(F.col("excess").isNull())),
        ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    total = total.agg(F.coalesce(F.sum("excess"), F.lit(0)).cast("decimal(38,0)").alias("excess"))
    return cut_lineage(total, free=True)
