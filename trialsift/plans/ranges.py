"""Distributed order: value ranges, running sums, ranks and order statistics.

A global ``Window.orderBy`` sends every row to one task.  Everything here works on *value ranges*
instead.  One sketch pass (``percentile_approx``, combined map-side) yields a short list of range
bounds.  The bounds become literals of the plan, like the bounds Spark's own range partitioning
samples, so every stage and every re-run of a lost task sees the same ranges.  Rows are then
counted per range, ordered inside their range only, and shifted by the counts of the ranges before
theirs.  The bounds steer balance only: counts, ranks and results are exact for any bounds.

Repeated values are collapsed to counts before they are shuffled, and a value that fills several
ranges on its own ("hot") is split further by the next ordering column, so no range grows with
the share of one value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.functions.exprs import col, finite, known
from trialsift.session import default_buckets, settle, settle_table

BUCKET = "__range"


def sketch_bounds(
    df: DataFrame, columns: Mapping[str, Column | str], buckets: int | None = None
) -> dict[str, list[float]]:
    """Approximate equal-count bounds of several columns in one pass over just these columns.

    A bound that repeats marks a value holding at least about ``1 / buckets`` of the rows.
    """
    n = buckets or default_buckets(df)
    if n < 2:
        return {name: [] for name in columns}
    probabilities = [i / n for i in range(1, n)]
    accuracy = max(1000, 8 * n)
    aggregates = []
    for name, c in columns.items():
        value = col(c).cast("double")
        value = F.when(~F.isnan(value), value)
        aggregates.append(F.percentile_approx(value, probabilities, accuracy).alias(name))
    row = df.agg(*aggregates).first()
    return {name: [float(v) for v in (row[name] or [])] for name in columns}


def with_ranges(
    df: DataFrame, columns: Mapping[str, tuple[Column | str, Sequence[float]]]
) -> DataFrame:
    """Add integer columns holding the number of bounds at or below each value (a JVM bisection)."""
    staged, splits, inputs, outputs, constants = df, [], [], [], []
    for name, (value, bounds) in columns.items():
        distinct = sorted({b for b in bounds if math.isfinite(b)})
        if not distinct:
            constants.append(name)
            continue
        staged = staged.withColumn(f"{name}__x", col(value).cast("double"))
        splits.append([-math.inf, *distinct, math.inf])
        inputs.append(f"{name}__x")
        outputs.append(f"{name}__b")
    if inputs:
        staged = Bucketizer(
            inputCols=inputs, outputCols=outputs, splitsArray=splits, handleInvalid="keep"
        ).transform(staged)
    names = [c.removesuffix("__b") for c in outputs]
    return staged.select(
        *df.columns,
        *[F.col(f"{n}__b").cast("int").alias(n) for n in names],
        *[F.lit(0).alias(n) for n in constants],
    )


def hot_values(bounds: Sequence[float]) -> list[float]:
    """Values repeated among the bounds: each fills at least one whole range."""
    seen: dict[float, int] = {}
    for b in bounds:
        seen[b] = seen.get(b, 0) + 1
    return [b for b, times in seen.items() if times > 1]


def is_hot(value: Column | str, bounds: Sequence[float]) -> Column:
    hot = hot_values(bounds)
    return col(value).cast("double").isin(hot) if hot else F.lit(False)


def cumulative(
    df: DataFrame,
    x: str,
    sums: Mapping[str, Column | str] | None = None,
    by: Sequence[str] = (),
    weight: str | None = None,
    descending: bool = False,
    buckets: int | None = None,
    bounds: Sequence[float] | None = None,
    positions: Column | None = None,
    nan_last: bool = False,
) -> DataFrame:
    """One row per group and distinct value of ``x``, with exact running totals.

    Columns: ``by``, ``x``, ``n`` and the ``sums`` of the value itself; ``n_before`` and
    ``<sum>_before`` over all values ordered before it; ``n_total`` and ``<sum>_total`` of the
    group.  NULL values are left out, and NaN values too unless ``nan_last``: then they form one
    row with ``x`` NULL that comes after every other value in either direction and counts in the
    totals.  ``weight`` counts pre-collapsed rows.

    ``positions`` is an optional array expression over ``n_total`` with zero-based row positions
    of interest.  Then only values covering such a position are returned, with the covered
    positions in the array column ``positions``; without grouping, value ranges that hold no
    requested position are dropped before the shuffle.
    """
    by = list(by)
    sums = dict(sums or {})
    measures = {"n": F.lit(1).cast("long") if weight is None else col(weight).cast("long")}
    measures.update({name: col(c) for name, c in sums.items()})
    totals = [F.sum(name).alias(name) for name in measures]

    kept, value = known(x), col(x)
    if nan_last:
        kept, value = value.isNotNull(), F.when(known(x), value)
    rows = df.where(kept).select(
        *by, value.alias(x), *[c.alias(name) for name, c in measures.items()]
    )
    if bounds is None:
        rows, buckets = settle(rows, buckets)
        bounds = sketch_bounds(rows, {"x": x}, buckets)["x"]
    ranged = bool(bounds)
    if ranged:
        rows = with_ranges(rows, {BUCKET: (x, bounds)})
        if nan_last:
            outermost = F.lit(-1 if descending else len(bounds) + 1)
            rows = rows.withColumn(BUCKET, F.coalesce(BUCKET, outermost))

    def order(column: str) -> Column:
        return F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)

    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if not ranged:
        return _cumulative_small(rows, x, by, group, order(x), totals, measures, positions)
    preceding = group.orderBy(order(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    # Without positions the counts of ranges come from the collapsed rows, whose exchange both sides
    # share, so that the input is read once.
    collapsed = rows.groupBy(*by, BUCKET, x).agg(*totals) if positions is None else rows
    offsets = collapsed.groupBy(*by, BUCKET).agg(*totals)
    offsets = offsets.select(
        *by,
        BUCKET,
        *[F.coalesce(F.sum(m).over(preceding), F.lit(0)).alias(f"__{m}_off") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures],
        F.col("n").alias("__n_range"),
    )
    if positions is not None:
        covered = F.filter(
            positions,
            lambda p: (p >= F.col("__n_off")) & (p < F.col("__n_off") + F.col("__n_range")),
        )
        offsets = offsets.withColumn("__wanted", F.array_distinct(covered))
        offsets = offsets.where(F.size("__wanted") > 0)
    offsets = offsets.drop("__n_range")
    if not by and positions is not None:
        # At most one range per requested position, so a list short enough to broadcast.
        rows = rows.join(F.broadcast(offsets.select(BUCKET)), [BUCKET], "left_semi")

    # The offset of a range enters its own partition as a first row, so that one window adds it to
    # the running sums inside the range: no join is needed, and NULL groups need no special care.
    head = offsets.select(
        *by,
        BUCKET,
        F.lit(0).alias("__row"),
        F.lit(None).cast(df.schema[x].dataType).alias(x),
        *[F.col(f"__{m}_off").alias(m) for m in measures],
        *[f"{m}_total" for m in measures],
        *(["__wanted"] if positions is not None else []),
    )
    if positions is not None:
        collapsed = rows.groupBy(*by, BUCKET, x).agg(*totals)
    body = collapsed.withColumn("__row", F.lit(1))
    inside = Window.partitionBy(*by, BUCKET).orderBy("__row", order(x))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    carried = [f"{m}_total" for m in measures] + (["__wanted"] if positions is not None else [])
    result = (
        head.unionByName(body, allowMissingColumns=True)
        .select(
            *by,
            x,
            "__row",
            *measures,
            *[F.sum(m).over(before).alias(f"{m}_before") for m in measures],
            *[F.first(c).over(so_far).alias(c) for c in carried],
        )
        .where(F.col("__row") == 1)
        .drop("__row")
    )
    if positions is not None:
        here = F.filter(
            F.col("__wanted"),
            lambda p: (p >= F.col("n_before")) & (p < F.col("n_before") + F.col("n")),
        )
        result = (
            result.withColumn("positions", here).drop("__wanted").where(F.size("positions") > 0)
        )
    return result


def _cumulative_small(rows, x, by, group, ordering, totals, measures, positions) -> DataFrame:
    """The same table when a whole group fits one task."""
    before = group.orderBy(ordering).rowsBetween(Window.unboundedPreceding, -1)
    result = rows.groupBy(*by, x).agg(*totals).select(
        *by,
        x,
        *measures,
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_before") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures],
    )
    if positions is None:
        return result
    here = F.filter(
        positions, lambda p: (p >= F.col("n_before")) & (p < F.col("n_before") + F.col("n"))
    )
    return result.withColumn("positions", F.array_distinct(here)).where(F.size("positions") > 0)


def order_statistics(
    df: DataFrame,
    x: str,
    probabilities: Sequence[float],
    sums: Mapping[str, Column | str] | None = None,
    by: Sequence[str] = (),
    method: str = "linear",
    buckets: int | None = None,
    bounds: Sequence[float] | None = None,
    nan_last: bool = False,
) -> DataFrame:
    """Exact quantiles of ``x`` per group, with the running totals on both sides of each.

    ``linear`` interpolates between the two neighbouring values, ``nearest`` takes the value at
    ``q * (n - 1)`` rounded half up.  Columns: ``by``, ``slot`` (index into ``probabilities``), ``q``,
    ``value``, ``n_total``, ``<sum>_total`` (these count NaN rows too if ``nan_last``), and ``n_below`` / ``<sum>_below`` (rows strictly
    below the quantile) with ``n_upto`` / ``<sum>_upto`` (rows not above it).
    """
    by = list(by)
    sums = dict(sums or {})
    extra = {"__valid": F.when(known(x), F.lit(1)).otherwise(F.lit(0)).cast("long")}
    qs = F.array(*[F.lit(float(q)) for q in probabilities])
    last = F.col("__valid_total" if nan_last else "n_total") - 1

    def rank(q: Column) -> Column:
        exact = q * last.cast("double")
        # Positions half way between two rows go to the later one.
        return exact if method == "linear" else F.round(exact)

    wanted = F.array_distinct(
        F.flatten(
            F.transform(
                qs,
                lambda q: F.array(F.floor(rank(q)).cast("long"), F.ceil(rank(q)).cast("long")),
            )
        )
    )
    table = cumulative(
        df,
        x,
        {**sums, **extra} if nan_last else sums,
        by,
        buckets=buckets,
        bounds=bounds,
        positions=wanted,
        nan_last=nan_last,
    )
    points = table.withColumn("pos", F.explode("positions"))
    slots = F.transform(
        qs,
        lambda q, i: F.struct(
            i.alias("slot"),
            q.alias("q"),
            F.floor(rank(q)).cast("long").alias("lo"),
            F.ceil(rank(q)).cast("long").alias("hi"),
            (rank(q) - F.floor(rank(q))).alias("t"),
        ),
    )
    points = points.withColumn("s", F.explode(slots)).where(
        (F.col("pos") == F.col("s.lo")) | (F.col("pos") == F.col("s.hi"))
    )
    measures = ["n", *sums]
    is_lo, is_hi = F.col("pos") == F.col("s.lo"), F.col("pos") == F.col("s.hi")
    aggregates = [
        F.max(F.when(is_lo, F.col(x))).alias("lo_value"),
        F.max(F.when(is_hi, F.col(x))).alias("hi_value"),
        F.max("s.t").alias("t"),
        F.max("s.q").alias("q"),
    ]
    for m in measures:
        before, upto = F.col(f"{m}_before"), F.col(f"{m}_before") + F.col(m)
        aggregates += [
            F.max(f"{m}_total").alias(f"{m}_total"),
            F.max(F.when(is_lo, before)).alias(f"{m}_lo_below"),
            F.max(F.when(is_lo, upto)).alias(f"{m}_lo_upto"),
            F.max(F.when(is_hi, before)).alias(f"{m}_hi_below"),
            F.max(F.when(is_hi, upto)).alias(f"{m}_hi_upto"),
        ]
    sides = points.groupBy(*by, F.col("s.slot").alias("slot")).agg(*aggregates)
    lo, hi, t = F.col("lo_value"), F.col("hi_value"), F.col("t")
    spread = hi - lo
    value = (
        F.when((t == 0) | (lo == hi), lo)
        .when(t >= 0.5, hi - spread * (1.0 - t))
        .otherwise(lo + spread * t)
    )
    sides = sides.withColumn("value", value)
    at_lo, at_hi = F.col("value") == lo, F.col("value") == hi
    counts = []
    for m in measures:
        counts.append(F.col(f"{m}_total"))
        counts.append(
            F.when(at_lo, F.col(f"{m}_lo_below"))
            .when(at_hi, F.col(f"{m}_hi_below"))
            .otherwise(F.col(f"{m}_lo_upto"))
            .alias(f"{m}_below")
        )
        counts.append(
            F.when(at_hi, F.col(f"{m}_hi_upto")).otherwise(F.col(f"{m}_lo_upto")).alias(f"{m}_upto")
        )
    return sides.select(*by, "slot", "q", "value", *counts)


# ---- ranks with a deterministic tie order --------------------------------------------------


CELL = "__cell"
_LEVELS = 4  # ordering columns that take part in splitting
_LEVEL_SIZE = 16384  # more than twice the largest number of ranges


def _order_key(df: DataFrame, name: str) -> Column:
    """Ordering column as a number, or as text, with the order of its values."""
    kind, c = df.select(col(name)).schema[0].dataType.simpleString(), col(name)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "string") or kind.startswith("decimal"):
        return c
    if kind == "date":
        return F.unix_date(c)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "boolean":
        return c.cast("int")
    raise TypeError(f"ties cannot be ordered by {name}, which is {kind}")


def rank_keys(df: DataFrame, score: str, order: Sequence[str]) -> list[Column]:
    """Ascending sort keys, NULL last: score descending, non-finite scores last, ties by ``order``."""
    ok = finite(score)
    # + 0.0 folds a negative zero into zero.
    falling = F.when(ok, -col(score).cast("double")).otherwise(F.lit(0.0)) + F.lit(0.0)
    return [F.when(ok, F.lit(0)).otherwise(F.lit(1)), falling, *[_order_key(df, c) for c in order]]


def _split_key(df: DataFrame, key: Column) -> tuple[Column, Column]:
    """A key as a number that rises with it, for cutting ranges, and whether the number stands for one key.

    Only rows of one key may be split by the next one.  A text's number is its first six bytes.
    """
    kind = df.select(key).schema[0].dataType
    if kind.simpleString() == "string":
        head = F.rpad(F.hex(F.substring(key.cast("binary"), 1, 6)), 12, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(math.inf)), F.lit(False)
    if kind.simpleString() in ("float", "double"):
        return F.coalesce(key.cast("double"), F.lit(math.nan)), F.lit(True)
    number = F.coalesce(key.cast("double"), F.lit(math.inf))
    digits = 10.0 ** kind.scale if hasattr(kind, "scale") else 1.0
    return number, (F.abs(number) < F.lit(1e15 / digits)) | (number == F.lit(math.inf))


class RankPlan:
    """Cells that cut a total order into ranges of similar size.

    A cell is a number that rises along the order.  Rows of a hot score are split by the ranges of
    the next ordering column, and so on, so that ties do not pile up in one cell.
    """

    def __init__(
        self, keys: Sequence[Column], split: Sequence[tuple[Column, Column]], bounds: Sequence[Sequence[float]]
    ):
        self.keys, self.split, self.single = list(keys), [s for s, _ in split], [one for _, one in split]
        self.bounds = {f"__k{i}": list(b) for i, b in enumerate(bounds)}
        self.small = not any(self.bounds.values())

    @classmethod
    def of(
        cls, df: DataFrame, scores: Sequence[str], order: Sequence[str], buckets: int | None = None
    ) -> list[RankPlan]:
        """Plans of several scores under the same tie order, from one sketch of all their columns."""
        if not order:
            raise ValueError("at least one ordering column is needed to break ties")
        keys = [rank_keys(df, score, order) for score in scores]
        ties = [_split_key(df, k) for k in keys[0][2 : 1 + _LEVELS]]
        columns = {f"__score{i}": _split_key(df, k[1]) for i, k in enumerate(keys)}
        columns |= {f"__tie{i}": k for i, k in enumerate(ties)}
        found = sketch_bounds(df, {name: number for name, (number, _) in columns.items()}, buckets)
        shared = [found[f"__tie{i}"] for i in range(len(ties))]
        return [
            cls(k, [columns[f"__score{i}"], *ties], [found[f"__score{i}"], *shared]) for i, k in enumerate(keys)
        ]

    def with_cell(self, df: DataFrame, name: str | None = None) -> DataFrame:
        levels = []
        for i in range(len(self.bounds)):
            levels.append(i)
            if not hot_values(self.bounds[f"__k{i}"]):
                break
        ranged = with_ranges(
            df, {f"__r{i}": (self.split[i], self.bounds[f"__k{i}"]) for i in levels}
        )
        cell, open_ = self.keys[0].cast("long"), F.lit(True)
        for i in levels:
            hot = open_ & is_hot(self.split[i], self.bounds[f"__k{i}"])
            # A range is [bound, next bound): its hot value, the bound itself, comes first.  The last range is
            # open above; what stands for no finite value comes after its others.
            place = F.when(self.split[i] == math.inf, F.lit(2)).when(hot, F.lit(0)).otherwise(F.lit(1))
            inside = F.when(F.isnan(self.split[i]), F.lit(_LEVEL_SIZE - 1)).otherwise(F.col(f"__r{i}") * 2 + place)
            cell = cell * F.lit(_LEVEL_SIZE) + F.when(open_, inside).otherwise(F.lit(0))
            open_ = hot & self.single[i]
        return ranged.withColumn(name or CELL, cell).drop(*[f"__r{i}" for i in levels])

    def named_keys(self) -> list[Column]:
        return [k.alias(f"__s{i}") for i, k in enumerate(self.keys)]

    def sort_names(self) -> list[str]:
        return [f"__s{i}" for i in range(len(self.keys))]

    def sort_order(self) -> list[Column]:
        return [F.asc_nulls_last(n) for n in self.sort_names()]


def _cell_offsets(cells: DataFrame) -> DataFrame:
    """Rows in all cells before a cell; one row per non-empty cell, so a short table."""
    counts = cells.groupBy(CELL).agg(F.count("*").alias("m"))
    before = (
        Window.partitionBy(F.lit(0)).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.select(
        CELL, "m", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("cell_before")
    )


def accept_rank(
    df: DataFrame,
    score: str,
    order: Sequence[str],
    rank: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """Exact global row number by score descending, ties broken by ``order``; one shuffle of rows.

    ``order`` columns may be numbers, dates, times, booleans or texts (NULL last) and must make the
    order total.
    """
    df, buckets = settle(df, buckets)
    (plan,) = RankPlan.of(df, [score], order, buckets)
    if plan.small:
        whole = Window.partitionBy(F.lit(0)).orderBy(*[k.asc_nulls_last() for k in plan.keys])
        return df.withColumn(rank, F.row_number().over(whole).cast("long"))
    celled = plan.with_cell(df)
    offsets = _cell_offsets(celled.select(CELL))
    inside = Window.partitionBy(CELL).orderBy(*plan.sort_order())
    rows = celled.select("*", *plan.named_keys()).withColumn(
        "__local", F.row_number().over(inside)
    )
    return rows.join(offsets, CELL).select(
        *df.columns, (F.col("cell_before") + F.col("__local")).alias(rank)
    )


def accepted_count(rate: float, n: int) -> int:
    """Rows kept at an abort rate: half-even rounding of (1 - rate) * n, clamped to [0, n]."""
    return max(0, min(n, int(round((1.0 - rate) * n))))


def rank_cutoffs(
    df: DataFrame,
    scores: Sequence[str],
    order: Sequence[str],
    ranks: Sequence[int],
    buckets: int | None = None,
) -> list[dict[int, tuple]]:
    """Sort keys of the rows at the given one-based ranks, for each score.

    Two jobs whatever the number of scores and ranks: one sketch of all scores and tie columns, and
    one query that counts the cells of all scores, keeps those that hold a requested rank, and sorts the rows
    of these only.  ``df`` should be a scan or settled before.  The answer has one row per score and
    requested rank, so it is returned to the driver.
    """
    wanted = sorted({int(r) for r in ranks if r >= 1})
    if not wanted or not scores:
        return [{} for _ in scores]
    plans = RankPlan.of(df, scores, order, buckets)
    celled = df.select(*dict.fromkeys([*scores, *order]))
    for i, plan in enumerate(plans):
        celled = plan.with_cell(celled, f"__cell{i}")
    entries = [
        F.struct(F.lit(i).alias("i"), F.col(f"__cell{i}").alias("cell"), *plan.named_keys())
        for i, plan in enumerate(plans)
    ]
    rows = celled.select(F.explode(F.array(*entries)).alias("__e")).select("__e.*")
    whole = Window.partitionBy("i").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("i", "cell").agg(F.count("*").alias("m"))
    cells = cells.select("i", "cell", "m", F.coalesce(F.sum("m").over(whole), F.lit(0)).alias("cell_before"))
    held = F.filter(
        F.array(*[F.lit(r).cast("long") for r in wanted]),
        lambda r: (r > F.col("cell_before")) & (r <= F.col("cell_before") + F.col("m")),
    )
    cells = cells.withColumn("held", held)
    # One row per score and requested rank at most, so safe to broadcast.
    cells = F.broadcast(cells.where(F.size("held") > 0).select("i", "cell", "cell_before", "held"))
    inside = Window.partitionBy("i", "cell").orderBy(*plans[0].sort_order())
    position = (F.col("cell_before") + F.row_number().over(inside)).cast("long")
    names = plans[0].sort_names()
    found = rows.join(cells, ["i", "cell"]).withColumn("rank", position)
    found = found.where(F.array_contains("held", F.col("rank"))).select("i", "rank", *names)
    out: list[dict[int, tuple]] = [{} for _ in scores]
    for r in found.collect():
        out[r["i"]][int(r["rank"])] = tuple(r[n] for n in names)
    return out


def _sql_literal(value) -> str:
    """A key's value as a literal of its own type."""
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value!r}')"
    if isinstance(value, Decimal):
        digits = max(0, -int(value.as_tuple().exponent))
        return f"CAST('{value:f}' AS DECIMAL(38, {digits}))"
    if isinstance(value, str):
        # Spelled by its bytes, so that no character needs an escape.
        return f"decode(X'{value.encode().hex()}', 'UTF-8')"
    return f"{int(value)}L"


def _level_text(keys: Sequence[str], cutoffs: Sequence[tuple]) -> str:
    """Number of cutoffs at or after a row in the order, as plain comparisons of columns.

    NULL keys come last: they equal each other and follow every value.
    """

    def upto(key: str, bound) -> str:
        return "true" if bound is None else f"{key} <= {_sql_literal(bound)}"

    def at_or_before(cutoff: tuple) -> str:
        text = upto(keys[-1], cutoff[-1])
        for key, bound in zip(reversed(keys[:-1]), reversed(cutoff[:-1])):
            if bound is None:
                text = f"({key} IS NOT NULL OR {text})"
            else:
                b = _sql_literal(bound)
                text = f"({key} < {b} OR ({key} = {b} AND {text}))"
        return f"IF({text}, 1, 0)"

    return " + ".join(["0", *[at_or_before(c) for c in cutoffs]])


def summed(cells: Column | str, field: str) -> Column:
    """Sum of a long field over an array of structs."""
    return F.aggregate(cells, F.lit(0).cast("long"), lambda total, c: total + c[field])


class NestedSets:
    """The nested accepted sets of several abort rates over ``n_total`` rows.

    All sets are prefixes of one order.  The level of a row is the number of distinct set sizes it
    is accepted in, and a row belongs to the set of a rate when its level reaches ``need(rate)``.
    """

    def __init__(self, rates: Sequence[float], n_total: int):
        self.n_total = n_total
        self.rates = [(float(r), accepted_count(float(r), n_total)) for r in rates]
        self.sizes = sorted({k for _, k in self.rates if k > 0}, reverse=True)

    def with_levels(
        self,
        df: DataFrame,
        scores: Mapping[str, str],
        order: Sequence[str],
        buckets: int | None = None,
    ) -> DataFrame:
        """Add one level column per score (name -> score column), in one scan of ``df``.

        The sort keys become columns first, so that the comparisons stay small enough to compile.
        """
        inner = [k for k in self.sizes if k < self.n_total]
        whole = len(self.sizes) - len(inner)
        columns, levels = [], {}
        found = rank_cutoffs(df, list(scores.values()), order, inner, buckets)
        for i, ((name, score), cutoffs) in enumerate(zip(scores.items(), found)):
            keys = rank_keys(df, score, order)
            named = [f"__key{i}_{j}" for j in range(len(keys))]
            columns += [k.alias(n) for k, n in zip(keys, named)]
            levels[name] = F.lit(whole) + F.expr(_level_text(named, [cutoffs[k] for k in inner]))
        keyed = df.select("*", *columns)
        return keyed.select(*df.columns, *[c.alias(name) for name, c in levels.items()])

    def need(self, kept: int) -> int:
        return self.sizes.index(kept) + 1 if kept > 0 else len(self.sizes) + 1

    def points(self) -> Column:
        """Literal array of (rate, kept, need), one entry per rate."""
        return F.array(
            *[
                F.struct(
                    F.lit(r).alias("rate"),
                    F.lit(k).cast("long").alias("kept"),
                    F.lit(self.need(k)).alias("need"),
                )
                for r, k in self.rates
            ]
        )

    def totals(self, cells: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
        """Per rate, the sums of ``measures`` over the accepted rows.

        ``cells`` holds one row per group and level, so each group is a short list here.
        """
        listed = cells.groupBy(*by).agg(
            F.collect_list(F.struct("level", *measures)).alias("__cells")
        )
        exploded = listed.withColumn("__p", F.explode(self.points()))
        inside = F.filter("__cells", lambda c: c["level"] >= F.col("__p.need"))
        return exploded.select(
            *by,
            F.col("__p.rate").alias("abort_rate"),
            F.col("__p.kept").alias("kept"),
            *[summed(inside, m).alias(m) for m in measures],
        )


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"):
    """Equi-join on group keys where NULL is a group like any other."""
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    named = right.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], *rest)
    same = F.lit(True)
    for i, k in enumerate(keys):
        equal = F.col(k).eqNullSafe(F.col(f"__g{i}"))
        same = equal if i == 0 else same & equal
    return left.join(named, same, how).drop(*[f"__g{i}" for i in range(len(keys))])


def attach(df: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join one row per group of ``by`` onto ``df``.

    Without grouping the table has a single row, which is broadcast.  With grouping, a table made by
    joins or aggregations is written once: the optimizer then knows its true size and broadcasts it only
    below its own limit, and otherwise takes a shuffle join whose skewed groups are split.
    """
    if not by:
        one = F.lit(1).alias("__one")
        return (
            df.select("*", one).join(F.broadcast(table.select("*", one)), "__one").drop("__one")
        )
    return join_groups(df, settle_table(table), by)


def neighbours(
    df: DataFrame, x: str, by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Distinct values of ``x`` per group with the ``previous`` and the ``next`` one.

    Inside a value range a window looks one row back and ahead; at its ends the nearest values come
    from a table of one row per range.
    """
    by = list(by)
    rows, buckets = settle(df.where(known(x)).select(*by, x).distinct(), buckets)
    bounds = sketch_bounds(rows, {"x": x}, buckets)["x"]
    rows = with_ranges(rows, {BUCKET: (x, bounds)})
    group = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(BUCKET)
    ends = rows.groupBy(*by, BUCKET).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    ends = ends.select(
        *by, BUCKET, F.lag("hi").over(group).alias("__before"), F.lead("lo").over(group).alias("__after")
    )
    inside = Window.partitionBy(*by, BUCKET).orderBy(x)
    local = rows.select(
        *by, BUCKET, x, F.lag(x).over(inside).alias("__p"), F.lead(x).over(inside).alias("__n")
    )
    if not by:
        ends = F.broadcast(ends)  # one row per range
    return join_groups(local, ends, [*by, BUCKET]).select(
        *by,
        x,
        F.coalesce("__p", "__before").alias("previous"),
        F.coalesce("__n", "__after").alias("next"),
    )
