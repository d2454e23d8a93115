"""Packing documents into sequences by best-two-fit.

A bin is filled greedily, largest document that fits first; then its smallest document gives way to
two unpacked ones that together fit the gap more tightly, if there are any.  What a bin becomes
depends on the unpacked lengths alone, and a length is a number up to the size of a sequence.  So the plan is
made from one count per length: a bin is found once, with the number of times in a row that the same steps
find the same bin again.  Its size depends on the size of a sequence, not on the number of documents.

Pieces then find their places by themselves: the r-th piece of a length takes the r-th place for that length.
Ranks are counted in slices of a hash, so that a length of a third of all pieces is no single task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialsift.llm.byte_bpe import pieces_of
from trialsift.llm.common import fresh, hashable, others, quoted
from trialsift.session import cut_lineage

SLICE_ROWS = 20_000  # pieces of one length that are ranked together, about


def _below(free: np.ndarray) -> np.ndarray:
    """Largest length that is free at or below each length; 0 if there is none."""
    return np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))


def _better_pair(free: np.ndarray, room: int, least: int, reserve: int, even: bool) -> tuple[int, int] | None:
    """Two free lengths, not under ``reserve``, of the largest sum over ``least`` and at most ``room``.

    Of equal sums the one with the longest document wins, or the most even one.
    """
    free = np.where(np.arange(len(free)) < reserve, 0, free)
    small = np.flatnonzero(free[: room // 2 + 1] > 0)
    if not len(small):
        return None
    below = _below(free)
    partner = below[room - small]
    alone = (partner == small) & (free[small] < 2)
    partner = np.where(alone, below[small - 1], partner)
    sums = np.where(partner > 0, small + partner, 0)
    best = len(sums) - 1 - int(sums[::-1].argmax()) if even else int(sums.argmax())
    return (int(partner[best]), int(small[best])) if sums[best] > least else None


Bins = list[tuple[int, list[tuple[int, int]]]]


def plan_bins(counts: np.ndarray, cap: int, reserve: int = 1, even: bool = False) -> Bins:
    """``(times, [(length, how many), ...])`` of all bins for ``counts[length]`` documents of each length.

    A bin is repeated while every document that its steps touched is still there, which gives the
    same bins as one by one: lengths that were not there do not come back.  Documents under ``reserve``
    only fill gaps and never replace another.
    """
    left = counts.astype(np.int64).copy()
    bins = []
    below = _below(left)
    while below[cap]:
        used: dict[int, int] = {}
        room = cap
        at = int(below[room])
        while at:
            take = min(room // at, int(left[at]) - used.get(at, 0))
            used[at] = used.get(at, 0) + take
            room -= take * at
            at = int(below[min(room, at - 1)])
        held = dict(used)
        smallest = min(held)
        if room and sum(held.values()) > 1:
            free = left.copy()
            for size, n in used.items():
                free[size] -= n
            pair = _better_pair(free, room + smallest, smallest, reserve, even)
            if pair:
                held[smallest] -= 1
                for size in pair:
                    held[size] = held.get(size, 0) + 1
                    used[size] = used.get(size, 0) + 1
        held = {size: n for size, n in held.items() if n}
        times = min((int(left[size]) - used[size]) // n + 1 for size, n in held.items())
        bins.append((times, sorted(held.items(), reverse=True)))
        gone = False
        for size, n in held.items():
            left[size] -= n * times
            gone |= not left[size]
        if gone:
            below = _below(left)
    return bins


def best_plan(counts: np.ndarray, cap: int) -> Bins:
    """The plan of fewest bins: short documents reserved or not, both ways of breaking ties."""
    plans = [
        plan_bins(counts, cap, max(1, cap // part), even) for part in (cap, 16, 8, 4) for even in (True, False)
    ]
    return min(plans, key=lambda bins: sum(times for times, _ in bins))


class Places:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, bins: Bins, cap: int):
        taken = np.zeros(cap + 1, dtype=np.int64)
        rows, base = [], 0
        for times, held in bins:
            offset = 0
            for size, n in held:
                rows.append((size, taken[size], n, base, offset))
                taken[size] += times * n
                offset += size * n
            base += times
        rows.sort()
        self.size, self.first, self.per, self.base, self.offset = (
            np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else [[]] * 5)
        )
        self.bounds = np.searchsorted(self.size, np.arange(cap + 2))
        self.total = base

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            low, high = self.bounds[s], self.bounds[s + 1]
            row = low + np.searchsorted(self.first[low:high], rank[own], side="right") - 1
            within = rank[own] - self.first[row]
            sequence[own] = self.base[row] + within // self.per[row]
            offset[own] = self.offset[row] + within % self.per[row] * s
        return sequence, offset


def encode_pieces(docs: DataFrame, tokenizer: str, cap: int = 1024, end: int = 2, text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, and ``piece, start, length, ids`` of every piece.

    ``ids`` are little-endian unsigned 32-bit integers.  A NULL or empty text has the end id alone.  Only a
    document of more than ``cap`` ids is cut, whatever its size; its first piece may be shorter.
    Repeated rows have pieces each; an empty table has none; columns with the names of outputs are replaced.
    """
    outputs = ("piece", "start", "length", "ids")
    (cell,) = fresh(docs, "cell")
    cut = F.arrow_udf(
        pieces_of(tokenizer, cap, end), "array<struct<piece: int, start: bigint, length: bigint, ids: binary>>"
    )
    kept = others(docs, (*outputs, text))
    rows = docs.select(*kept, F.explode(cut(quoted(text).cast("string"))).alias(cell))
    return rows.select(*others(rows, (cell,)), *[quoted(cell)[c].alias(c) for c in outputs])


def pack_pieces(pieces: DataFrame, cap: int = 1024, length: str = "length") -> DataFrame:
    """All columns of ``pieces`` and ``sequence_id``, ``offset``: the place of each piece.

    Pieces of one length are equal for the packing; which takes which place follows from a hash of the row, so
    reruns agree.  Rows that repeat in full take places of their own in any order.  A length that is NULL, under 1
    or over ``cap`` is an error.  An empty table gives an empty table; columns with the names of
    outputs are replaced.
    """
    plain = pieces.select(*others(pieces, ("sequence_id", "offset")))
    size = quoted(length).cast("int")
    sound = F.coalesce((size >= 1) & (size <= cap), F.lit(False))
    checked = F.when(sound, size).otherwise(F.raise_error(F.lit(f"a length is not from 1 to {cap}")).cast("int"))
    # At most ``cap`` rows, whatever the number of pieces.
    held = plain.groupBy(checked.alias("s")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros(cap + 1, dtype=np.int64)
    for row in held:
        counts[row["s"]] = row["n"]
    places = Places(best_plan(counts, cap), cap)

    hashed, part, own, s, rank, begun, place = fresh(plain, "hashed", "part", "own", "s", "rank", "begun", "place")
    slices = F.expr("array(" + ",".join(str(int(-(-n // SLICE_ROWS) or 1)) for n in counts) + ")")
    rows = plain.select("*", size.alias(s), F.xxhash64(*hashable(plain)).alias(hashed))
    rows = rows.withColumn(part, F.pmod(quoted(hashed), F.get(slices, quoted(s))).cast("int"))
    sums = rows.groupBy(quoted(s).alias("a"), quoted(part).alias("b")).agg(F.count("*").alias(own))
    earlier = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("a", "b", F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias(begun))
    inside = Window.partitionBy(quoted(s), quoted(part)).orderBy(quoted(hashed))
    rows = rows.withColumn(rank, F.row_number().over(inside) - 1)
    rows = rows.join(sums, (quoted(s) == F.col("a")) & (quoted(part) == F.col("b"))).drop("a", "b")

    def find(sizes: pa.Array, ranks: pa.Array) -> pa.Array:
        at = places.of(sizes.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(c) for c in at], ["sequence_id", "offset"])

    found = F.arrow_udf(find, "struct<sequence_id: bigint, offset: bigint>")
    rows = rows.withColumn(place, found(quoted(s), (quoted(begun) + quoted(rank)).cast("long")))
    return rows.select(
        *others(plain, ()), quoted(place)["sequence_id"].alias("sequence_id"), quoted(place)["offset"].alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, cap: int = 1024, end: int = 2, text: str = "text") -> DataFrame:
    """Pieces of all documents with their ids and places; texts are encoded once, into a written table."""
    return pack_pieces(cut_lineage(encode_pieces(docs, tokenizer, cap, end, text)), cap)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, starts``: the ids of every sequence, and where its pieces begin."""
    cells = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(cells.alias("cells"))
    joined = F.aggregate("cells", F.lit(b""), lambda all, c: F.concat(all, c["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("cells.offset").alias("starts"))
