"""Interaction of filters: what each removes, in every order, and its share over all orders.

The counts behind the filters come from one byte transducer pass (``transducer.py``).  A document
then is a set of failed filters, a number from 0 to 31.  All figures of all 120 orders follow from
``alive(P)``, the number of documents of a part that fail none of the filters P: what filter f removes
after the filters P is ``alive(P) - alive(P + f)``.  So documents are reduced to one small table of
counts per part and set of failures, and orders are never run over documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.llm.common import quoted
from trialsift.llm.transducer import text_counts

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
TEXT_FAILURES = (
    lambda c: c["n_words"] < 200,
    lambda c: 100 * c["n_distinct"] < 50 * c["n_words"],
    lambda c: 100 * c["n_capitals"] > 2 * c["n_points"],
    lambda c: c["n_symbols"] > 0,
)


def failure_counts(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    quality: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """``part, failed, good, toxic, n``: documents per part, set of failed filters and labels.

    Bit i of ``failed`` is the i-th of ``FILTERS``.  Equal texts are told by their SHA-256.  Copies are
    counted before they meet: one row per id, text and part, then one per text, set, part and labels,
    with the smallest id and how many rows have it.  A NULL id fails no E and makes no other
    row fail it.  A NULL text is an empty one, a NULL source an empty part.  Labels of one id that
    repeat are joined by "or"; a label of NULL is none.  Rows that repeat with their id count
    each, none of them smaller than the other.  Other columns do not matter, whatever their names.
    """
    counted = text_counts(
        docs.select(
            quoted(id).alias("id"),
            F.coalesce(quoted(source).cast("string"), F.lit("")).alias("part"),
            F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"),
        )
    )
    bits = [F.when(rule(F.col("counts")), 1 << i).otherwise(0) for i, rule in enumerate(TEXT_FAILURES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed + bit
    rows = counted.select("id", "part", failed.alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.groupBy("id", "part", "failed", "digest").agg(F.count("*").alias("n"))

    def known(c: str) -> Column:
        return F.max(F.coalesce(quoted(c) == 1, F.lit(False)))

    marks = labels.where(quoted(id).isNotNull()).groupBy(quoted(id).cast("string").alias("key"))
    marks = marks.agg(known(quality).alias("good"), known(toxic).alias("toxic"))
    # Rows without an id meet no label; their keys differ, so that they do not meet in one task.
    key = F.coalesce(quoted("id").cast("string"), F.concat(F.lit("\x00"), F.hex("digest")))
    rows = rows.withColumn("key", key).join(marks, "key", "left").drop("key")
    rows = rows.fillna(False, ["good", "toxic"])
    kind = ["digest", "part", "failed", "good", "toxic"]
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    unnamed = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    copies = rows.groupBy(*kind).agg(F.sum("n").alias("n"), first.alias("first"), unnamed.alias("unnamed"))
    # At most one row per part, set and labels is left of the copies of a text.
    lowest = F.min("first.id").over(Window.partitionBy("digest"))
    leads = F.when(F.col("first.id") == lowest, F.col("first.n")).otherwise(0)
    copies = copies.withColumn("passes", (leads + F.col("unnamed")).cast("long"))
    e = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("failed").alias("failed"), F.col("passes").alias("n")),
        F.struct((F.col("failed") + e).alias("failed"), (F.col("n") - F.col("passes")).alias("n")),
    )
    split = copies.select("part", "good", "toxic", F.explode(both).alias("b"))
    split = split.select("part", F.col("b.failed").cast("int").alias("failed"), "good", "toxic", "b.n")
    return split.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step, as described in :func:`failure_counts`.

    Columns: ``part, filter_order, step``; documents ``kept`` after the step, ``removed`` in it,
    ``redundant`` (failing its filter, removed before), ``unique_fails`` (failing its filter only);
    ``good_lost`` and ``toxic_lost`` (removed here); ``shapley`` (removed by its filter, summed over all
    orders).  A part with any row has all its 600 rows; an empty table has none.
    """
    counts = failure_counts(docs, labels, **columns)

    def alive(where: str) -> Column:
        """Documents per set P that fail nothing of P, as an array over P."""
        own = F.filter("held", lambda h: h[where])
        return F.transform(
            F.sequence(F.lit(0), F.lit(SETS - 1)),
            lambda p: F.aggregate(
                F.filter(own, lambda h: h["failed"].bitwiseAND(p) == 0),
                F.lit(0).cast("long"),
                lambda total, h: total + h["n"],
            ),
        )

    cell = F.struct("failed", "n", "good", "toxic", F.lit(True).alias("every"))
    parts = counts.groupBy("part").agg(F.collect_list(cell).alias("held"))
    parts = parts.select("part", *[alive(w).alias(w) for w in ("every", "good", "toxic")])

    def over_all_orders(letter: int) -> Column:
        """Removed by one filter in all orders: |P|! (4 - |P|)! orders put exactly P before it."""
        total = F.lit(0).cast("long")
        for p in range(SETS):
            if not p >> letter & 1:
                orders = factorial(p.bit_count()) * factorial(len(FILTERS) - 1 - p.bit_count())
                total = total + orders * (F.col("every")[p] - F.col("every")[p | 1 << letter])
        return total

    shares = F.array(*[over_all_orders(i) for i in range(len(FILTERS))])
    parts = parts.withColumn("shares", shares)
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    own = before = F.lit(0)
    for i, name in enumerate(FILTERS):
        own = own + F.when(letter == name, 1 << i).otherwise(0)
        before = before + F.when(F.instr("filter_order", name) < F.col("step"), 1 << i).otherwise(0)
    steps = steps.withColumn("own", own).withColumn("before", before)
    after = F.col("before") + F.col("own")

    def removed(where: str) -> Column:
        return F.get(where, F.col("before")) - F.get(where, after)

    every = F.col("every")
    failing = every[0] - F.get(every, F.col("own"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get(every, after).alias("kept"),
        removed("every").alias("removed"),
        (failing - removed("every")).alias("redundant"),
        (F.get(every, (SETS - 1) - F.col("own")) - every[SETS - 1]).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.get("shares", F.ascii(letter) - ord(FILTERS[0])).alias("shapley"),
    )
