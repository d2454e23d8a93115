"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, but at most ``max_epochs`` times its own
words; what is over goes to the other sources by weight, until nobody is above.  A source first
gives complete epochs; the rest is drawn without replacement: a document has the key
``-ln(u) / weight`` with ``u`` a hash of its id, documents are taken in the order of their keys, and
the running sum of words stops at the rest.

The order of a source is not found in one task: keys are cut into slices of equal probability,
slices are counted, and only rows of one slice are ordered together, shifted by the sums of the slices before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.llm.common import WORD, fresh, hashable, others, quoted
from trialsift.session import cut_lineage

OUTPUTS = ("size", "source_size", "target", "taken")
_COLUMNS = ("id", "source", "text")
MAX_EPOCHS = 3
SLICE_ROWS = 20_000  # rows of a source that are ordered together, about


def word_count(text: Column) -> Column:
    """Words of a whole text; none for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Sampling weight of a document: its share of letters and digits, from 0.1 to 1."""
    plain = F.length(F.regexp_replace(text, r"[#*$%&|<>@=_~^{}\[\]\\\x00-\x1F]", ""))
    return F.coalesce(F.greatest(F.lit(0.1), plain / F.greatest(F.length(text), F.lit(1))), F.lit(0.1))


def source_targets(sized: DataFrame, source: str, size: str, cycle: Sequence[float]) -> DataFrame:
    """``source``, its number of words and rows, and its target, as expressions over the sources.

    A source is capped as soon as its weight per word is above a limit that only falls as others
    are capped, so the capped ones are a prefix of the sources by weight per word, and the target
    follows from running sums over one row per source.
    """
    totals = sized.groupBy(source).agg(F.sum(size).alias("words"), F.count("*").alias("rows"))
    everyone = Window.partitionBy(F.lit(0))
    by_name = everyone.orderBy(quoted(source).asc_nulls_last())
    weights = F.expr(f"array({','.join(f'{float(w)!r}D' for w in cycle)})")
    rows = totals.select(
        "*",
        F.get(weights, (F.row_number().over(by_name) - 1) % len(cycle)).alias("weight"),
        F.sum("words").over(everyone).cast("double").alias("total"),
    )
    ratio = F.when(F.col("words") > 0, F.col("weight") / F.col("words"))
    order = everyone.orderBy(ratio.desc_nulls_last(), quoted(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    real = F.when(F.col("words") > 0, F.col("weight")).otherwise(0.0)
    rows = rows.select(
        "*",
        real.alias("real"),
        (F.sum(real).over(everyone) - F.coalesce(F.sum(real).over(before), F.lit(0.0))).alias("open"),
        (F.col("total") - MAX_EPOCHS * F.coalesce(F.sum("words").over(before), F.lit(0))).alias("left"),
    )
    unit = F.when(F.col("open") > 0, F.col("left") / F.col("open"))
    over = (F.col("real") > 0) & (unit * F.col("real") > MAX_EPOCHS * F.col("words"))
    rows = rows.select("*", unit.alias("unit"), F.coalesce(over, F.lit(False)).alias("over"))
    shared = F.min(F.when(~F.col("over") & (F.col("real") > 0), F.struct(-F.col("open"), "unit"))).over(everyone)
    target = (
        F.when(F.col("real") == 0, 0.0)
        .when(F.col("over"), (MAX_EPOCHS * F.col("words")).cast("double"))
        .otherwise(shared["unit"] * F.col("real"))
    )
    return rows.select(source, F.col("words").alias("source_size"), "rows", target.alias("target"))


def _planned(
    docs: DataFrame,
    copies: str,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    cycle: Sequence[float] = (1, 2, 3),
    seed: int = 0,
) -> DataFrame:
    """The plan of :func:`plan_mix` and the number of times each row is taken, as ``copies``."""
    plain = docs.select(*others(docs, (*OUTPUTS, copies)))
    u, weight, slot, where_, begun, ran, rows, at, epochs, owner, part, tie = fresh(
        plain, "u", "weight", "slot", "where", "begun", "ran", "rows", "at", "epochs", "owner", "part", "tie"
    )
    own_id = F.coalesce(quoted(id).cast("string"), F.lit("-"))
    noise = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), own_id)), 1, 13), 16, 10)
    sized = plain.select(
        "*",
        word_count(quoted(text)).alias("size"),
        ((noise.cast("double") + 0.5) / float(1 << 52)).alias(u),
        quality_weight(quoted(text)).alias(weight),
        # Hashed before rows travel, so that texts travel only where the caller keeps them.
        F.xxhash64(*hashable(plain)).alias(tie),
    )
    # Texts are read once for the sums, as a narrow table, and once for the rows themselves.
    narrow = cut_lineage(sized.select(quoted(source).alias(where_), "size", u, weight))
    targets = source_targets(narrow, where_, "size", cycle).withColumnRenamed("rows", rows)

    def placed(frame: DataFrame, name: str) -> DataFrame:
        """Rows with their source's sums, sampling key and slice of the order."""
        # One row per source; Spark broadcasts it if it is small and splits hot sources otherwise.
        known = frame.join(
            targets.withColumnRenamed(where_, owner), quoted(name).eqNullSafe(quoted(owner))
        ).drop(owner)
        # exp(-key) is a uniform number to the power 1 / weight: slices of it are slices of the order.
        slices = F.ceil(quoted(rows) / SLICE_ROWS)
        key = F.log(quoted(u)) / quoted(weight)
        return known.select("*", (-key).alias(at), F.floor((1 - F.exp(key)) * slices).alias(slot))

    sums = placed(narrow, where_).groupBy(quoted(where_).alias(owner), quoted(slot).alias(part))
    sums = sums.agg(F.sum("size").alias(ran))
    earlier = Window.partitionBy(owner).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(owner, part, F.coalesce(F.sum(ran).over(earlier), F.lit(0)).alias(begun))
    inside = Window.partitionBy(quoted(source), quoted(slot)).orderBy(
        quoted(at), quoted(id), quoted(tie)
    )
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    run = placed(sized, source).withColumn(ran, before)
    run = run.join(
        sums, quoted(source).eqNullSafe(quoted(owner)) & (quoted(slot) == quoted(part))
    )
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    run = run.withColumn(epochs, F.least(full, F.lit(MAX_EPOCHS)))
    rest = F.col("target") - quoted(epochs) * F.col("source_size")
    start = quoted(begun) + F.coalesce(quoted(ran), F.lit(0))
    once_more = (quoted(epochs) < MAX_EPOCHS) & (start + F.col("size") / 2 < rest)
    times = (quoted(epochs) + F.when(once_more, 1).otherwise(0)).cast("long")
    return run.select(
        *others(plain, ()),
        "size",
        "source_size",
        "target",
        (F.col("size") * times).alias("taken"),
        F.when(F.col("size") > 0, times).otherwise(F.lit(0).cast("long")).alias(copies),
    )


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """All columns of ``docs`` and ``size``, ``source_size``, ``target``, ``taken`` (words).

    Sources by code point, NULL last, weigh ``cycle`` in turn.  ``taken`` is a whole multiple of
    ``size``: complete epochs and possibly one more.  The document on which the rest of a source
    ends is taken if that comes nearer to the target.  Texts that are NULL, empty or without words
    have size 0 and are never taken; an empty table gives an empty table.  Equal keys, which only equal
    ids have, are taken in the order of a hash of the row; rows that repeat in full are drawn one by one.
    Columns with the names of outputs are replaced.  Texts do not travel unless the caller keeps them.
    Options: ``id``, ``source``, ``text``, ``cycle`` and ``seed``.
    """
    (copies,) = fresh(docs, "copies")
    return _planned(docs, copies, **options).drop(copies)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with their own columns, each as often as it is taken.

    Rows whose text is NULL, empty or without words have no size and are never taken.  Everything
    else is as in :func:`plan_mix`, also the options.
    """
    clashes = [c for c in docs.columns if c.lower() in OUTPUTS]
    copies, copy, *aside = fresh(docs, "copies", "copy", *[f"own_{c}" for c in clashes])
    names = dict(zip(clashes, aside))
    plain = docs.select(*[quoted(c).alias(names.get(c, c)) for c in docs.columns])
    planned = _planned(plain, copies, **{k: names.get(v, v) if k in _COLUMNS else v for k, v in options.items()})
    repeated = F.explode(F.array_repeat(F.lit(True), quoted(copies).cast("int")))
    return planned.withColumn(copy, repeated).select(*[quoted(names.get(c, c)).alias(c) for c in docs.columns])
