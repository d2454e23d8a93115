"""Exact nearest vectors by inner product, with a pivot table.

Distances of every vector to a few pivots are computed once and kept with the packed vectors.  For
a query the triangle inequality gives ``d(q, x) >= max |d(q, p) - d(x, p)|`` and so an upper bound of the
inner product ``(|q|^2 + |x|^2 - d(q, x)^2) / 2``.  Candidates are evaluated in the order of their bounds
until the next bound is below the k-th score found; the scores of a bounded sample give a first
value of it.  Scores are whole numbers and bounds are rounded up, so the result is exact, ties
included.

Vectors are packed in blocks.  Every block of queries meets every block of candidates once (a
stated query set against all rows), and only the best ``k`` of each meeting are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.llm.common import partitions, quoted
from trialsift.session import cut_lineage

PIVOTS = 24
SAMPLE = 2048  # rows from which pivots and first thresholds are taken
QUERY_BLOCK = 512
ROW_BLOCK = 8192
STEP = 128  # candidates evaluated before the first look at the bounds


def whole_numbers(vector: Column, factor: int = 256) -> Column:
    """``floor(factor * x)`` of every component, or NULL if the vector takes no part."""
    x = vector.cast("array<double>")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(ok & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * factor).cast("long")))


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    limit = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if limit < 2**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return np.array([sum(a * b for a, b in zip(r, query.tolist())) for r in rows.tolist()], dtype=object)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(
        np.stack([np.square(rows.astype(np.float64) - p.astype(np.float64)).sum(axis=1) for p in pivots], axis=1)
    )


def choose_pivots(rows: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first choice among a few rows."""
    chosen = [0]
    near = _distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(count, len(rows)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


class Block:
    """A block of rows, made ready once for all its queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, table: np.ndarray, norms: np.ndarray):
        self.ids, self.rows, self.norms = ids, rows, norms
        self.to_pivots = np.ascontiguousarray(table.T)  # a row for each pivot
        self.largest = float(np.abs(rows).max(initial=0))
        self.plain = rows.astype(np.float64)

    def apart(self, to_pivots: np.ndarray) -> np.ndarray:
        """Least distance of every row to a query, by the pivots."""
        out = np.abs(self.to_pivots[0] - to_pivots[0])
        step = np.empty_like(out)
        for own, other in zip(self.to_pivots[1:], to_pivots[1:]):
            np.subtract(own, other, out=step)
            np.maximum(out, np.abs(step, out=step), out=out)
        return out

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows."""
        if self.largest * float(np.abs(query).max(initial=0)) * len(query) < 2**53:
            return (self.plain[at] @ query.astype(np.float64)).astype(np.int64)
        return inner(self.rows[at], query)


def best_of(query: np.ndarray, own: int, to_pivots: np.ndarray, floor: float, block: Block, k: int) -> list[tuple[int, int]]:
    """Best ``k`` (score, id) of a block for a query, none below ``floor`` needed.

    Candidates come in the order of their bounds, each time twice as many, until no bound is left that
    reaches the k-th score.
    """
    apart = block.apart(to_pivots)
    square = float(query.astype(np.float64) @ query.astype(np.float64))
    bound = (square + block.norms - np.square(apart)) / 2
    bound += 1e-6 * (1 + np.abs(bound) + np.square(apart))  # rounding errors only widen it
    live = np.flatnonzero((bound >= floor) & (block.ids != own))
    found: list[tuple[int, int]] = []
    size = STEP
    while len(live):
        if size < len(live):
            # The next ones by bound, in no order among themselves; all of them are evaluated.
            cut = np.argpartition(-bound[live], size - 1)
            some, live = live[cut[:size]], live[cut[size:]]
        else:
            some, live = live, live[:0]
        scores, ids = block.scores(some, query), block.ids[some]
        if len(some) > k:
            # Those below the k-th score of their own are none of the best; ties stay.
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        found = sorted([*found, *zip(scores.tolist(), ids.tolist())], key=lambda f: (-f[0], f[1]))[:k]
        if len(found) >= k:
            live = live[bound[live] >= max(floor, found[-1][0])]
        size *= 2
    return found


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", factor: int = 256
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the best rows for each query row.

    ``queries`` selects the query rows; candidates are all rows of the same length whose id is
    another.  Rows without an id and vectors that are NULL, empty or hold NULL or non-finite
    components take no part.  Repeated rows are candidates each; of query rows with one id the
    first by value asks.  Fewer candidates than ``k`` give all; an empty table gives none.
    """
    spark = vectors.sparkSession
    valid = vectors.where(quoted(id).isNotNull()).select(
        quoted(id).cast("long").alias("id"), whole_numbers(quoted(vector), factor).alias("v"), queries.alias("asks")
    )
    valid = valid.where(F.col("v").isNotNull()).withColumn("dim", F.size("v"))
    # A bounded sample: pivots and first thresholds steer the work, not the result.
    sample = valid.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "dim", "v").collect()
    by_dim: dict[int, tuple] = {}
    for dim in {r["dim"] for r in sample}:
        rows = np.array([r["v"] for r in sample if r["dim"] == dim], dtype=np.int64)
        ids = np.array([r["id"] for r in sample if r["dim"] == dim], dtype=np.int64)
        by_dim[dim] = (choose_pivots(rows), ids, rows)
    shared = spark.sparkContext.broadcast(by_dim)

    def setup(dim: int, rows: np.ndarray) -> tuple:
        """Pivots of a length of vectors; one that the sample misses has the zero vector."""
        none = np.zeros((1, dim), dtype=np.int64)
        return shared.value.get(dim, (none, np.array([], dtype=np.int64), none[:0]))

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(dim: int, parts: list) -> pa.RecordBatch:
            ids = np.concatenate([p[0] for p in parts])
            rows = np.concatenate([p[1] for p in parts])
            table = _distances(rows, setup(dim, rows)[0])
            norms = np.square(rows.astype(np.float64)).sum(axis=1)
            return pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()),
                    "ids": [ids.tobytes()],
                    "rows": [rows.tobytes()],
                    "table": [table.tobytes()],
                    "norms": [norms.tobytes()],
                }
            )

        for batch in batches:
            dims = batch.column(2).to_numpy()
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                rows = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                parts = held.setdefault(dim, [])
                parts.append((ids[at], rows))
                if sum(len(p[0]) for p in parts) >= ROW_BLOCK:
                    yield packed(dim, held.pop(dim))
        for dim, parts in held.items():
            yield packed(dim, parts)

    blocks = valid.select("id", "v", "dim").mapInArrow(
        pack_rows, "dim int, ids binary, rows binary, table binary, norms binary"
    )
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))
    asking = valid.where("asks").groupBy("id", "dim").agg(F.min("v").alias("v"))
    asking = asking.groupBy("id").agg(F.min_by(F.struct("dim", "v"), "dim").alias("q")).select("id", "q.*")
    asking = cut_lineage(asking)
    groups = max(1, -(-asking.count() // QUERY_BLOCK))

    def pack_queries(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        frame = frame.sort_values("id")
        ids = frame["id"].to_numpy(dtype=np.int64)
        rows = np.stack(frame["v"].to_numpy()).astype(np.int64)
        pivots, known_ids, known = setup(dim, rows)
        table = _distances(rows, pivots)
        floors = np.full(len(ids), -np.inf)
        for i, (own, query) in enumerate(zip(ids.tolist(), rows)):
            scores = inner(known[known_ids != own], query) if len(known) else []
            if len(scores) >= k:
                floors[i] = float(np.sort(scores)[-k])
        return pd.DataFrame(
            {
                "dim": [dim],
                "q_ids": [ids.tobytes()],
                "q_rows": [rows.tobytes()],
                "q_table": [table.tobytes()],
                "floors": [floors.tobytes()],
            }
        )

    spread = asking.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
    packed_queries = cut_lineage(
        spread.groupBy("g", "dim").applyInPandas(
            pack_queries, "dim int, q_ids binary, q_rows binary, q_table binary, floors binary"
        )
    )

    # Which blocks meet is decided on their numbers; packed vectors travel once to each meeting.
    meetings = packed_queries.join(blocks.select("dim", "block"), "dim").repartition(
        max(partitions(spark), 2 * groups), "block", "q_ids"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                load = lambda name, kind, wide: np.frombuffer(row[name], dtype=kind).reshape(-1, wide)
                ids, norms = load("ids", np.int64, 1)[:, 0], load("norms", np.float64, 1)[:, 0]
                rows = load("rows", np.int64, dim)
                block = Block(ids, rows, np.frombuffer(row["table"], dtype=np.float64).reshape(len(ids), -1), norms)
                q_ids = load("q_ids", np.int64, 1)[:, 0]
                q_table = np.frombuffer(row["q_table"], dtype=np.float64).reshape(len(q_ids), -1)
                floors = load("floors", np.float64, 1)[:, 0]
                out = []
                for i, query in enumerate(load("q_rows", np.int64, dim)):
                    own = int(q_ids[i])
                    best = best_of(query, own, q_table[i], floors[i], block, k)
                    out += [(own, other, score) for score, other in best]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"]
                )

    full = meetings.join(blocks.drop("dim"), "block")
    found = full.drop("block").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
