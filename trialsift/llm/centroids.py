"""Lloyd's clustering over shards of dimensions.

Vectors are cut into blocks of ``WIDTH`` columns.  A row of the tile table is one block of up to
``CHUNK`` vectors.  A task over tiles knows only its slices of the centroids and gives the exact partial
squared distances of its tile; blocks of one chunk are added by a shuffle on the chunk, where every vector takes
the nearest centroid.  The assignment goes back to the tiles, and each block sums and divides its own
slice of the centroids.

Tiles are written once, bucketed and sorted by block and chunk, so no round moves a vector: what moves
is one number per vector, centroid and block (two bytes where they suffice), and two bytes per vector and
block on the way back.  The driver sees the centroids only, ``k`` times the number of components.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialsift.llm.common import partitions, quoted
from trialsift.session import cut_lineage, scratch_path

WIDTH = 32
CHUNK = 2048
LIMIT = 1 << 27  # of a component's size: squared distances of 64 components then fit a long
IDS = -1  # block number of the rows that hold the ids of a chunk


def _narrow(x: np.ndarray, kinds: tuple[str, ...]) -> tuple[bytes, str]:
    """The numbers in the first of some types that holds them all."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    for kind in kinds:
        info = np.iinfo(kind)
        if info.min <= low and high <= info.max:
            return x.astype(kind).tobytes(), kind
    raise OverflowError("a number does not fit the widest type")


def _planes(raw: bytes, kind: str) -> bytes:
    """Numbers with all their first bytes together, then all second ones: high bytes compress well."""
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(planes, dtype=np.uint8).reshape(size, -1).T.copy().view(kind).ravel().astype(np.int64)


def _tiles(vectors: DataFrame, dims: int) -> DataFrame:
    """``block, chunk, n, kind, data, ids``: the blocks of every chunk, and a row with its ids."""
    id_type = vectors.dtypes[0][1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                n = part.num_rows
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
                ids = part.column(0)
                chunk = (TaskContext.get().partitionId() << 32) + made
                made += 1
                blocks, kinds, data = [IDS], [""], [b""]
                for b, at in enumerate(range(0, dims, WIDTH)):
                    raw, kind = _narrow(x[:, at : at + WIDTH], ("<i2", "<i4", "<i8"))
                    blocks.append(b)
                    kinds.append(kind)
                    data.append(raw)
                rows = len(blocks)
                lists = pa.ListArray.from_arrays(pa.array([0] + [n] * rows, pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks, pa.int32()),
                        pa.array([chunk] * rows, pa.int64()),
                        pa.array([n] * rows, pa.int32()),
                        pa.array(kinds, pa.string()),
                        pa.array(data, pa.binary()),
                        lists,
                    ],
                    ["block", "chunk", "n", "kind", "data", "ids"],
                )

    schema = f"block int, chunk long, n int, kind string, data binary, ids array<{id_type}>"
    return vectors.mapInArrow(cut, schema)


def _bucketed(tiles: DataFrame) -> tuple[DataFrame, str]:
    """The tiles as a table whose buckets hold whole blocks of chunks in order."""
    spark, n = tiles.sparkSession, partitions(tiles.sparkSession)
    name = f"tiles_{uuid.uuid4().hex}"
    (
        tiles.repartition(n, "block", "chunk")
        .write.bucketBy(n, "block", "chunk")
        .sortBy("block", "chunk")
        .option("path", scratch_path(spark, "tiles"))
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    return spark.table(name), name


def _partial(slices: list[np.ndarray]):
    """Map of tiles to their exact partial squared distances to all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["data"], dtype=row["kind"]).astype(np.int64).reshape(row["n"], -1)
                c = slices[row["block"]]
                if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 23:
                    # Sums of products stay below 2^53: double precision is exact.
                    product = np.rint(x.astype(float) @ c.T.astype(float)).astype(np.int64)
                else:
                    product = x @ c.T
                d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * product
                raw, kind = _narrow(d, ("<u2", "<u4", "<i8"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk"]], pa.int64()),
                        pa.array([row["n"]], pa.int32()),
                        pa.array([kind], pa.string()),
                        pa.array([_planes(raw, kind)], pa.binary()),
                    ],
                    ["chunk", "n", "kind", "data"],
                )

    return run


_PARTIAL = "chunk long, n int, kind string, data binary"


def _nearest(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of one chunk added; nearest centroid, the smaller number in ties, and its distance."""
    total = 0
    for row in table.to_pylist():
        if row["kind"]:
            total = total + _numbers(row["data"], row["kind"]).reshape(row["n"], k)
    label = total.argmin(axis=1)
    return label, total[np.arange(len(label)), label]


def _labels(tiles: DataFrame, slices: list[np.ndarray]) -> DataFrame:
    k = len(slices[0])

    def reduce(table: pa.Table) -> pa.Table:
        label, _ = _nearest(table, k)
        return pa.table(
            {
                "chunk": pa.array([table["chunk"][0].as_py()], pa.int64()),
                "labels": pa.array([label.astype("<i4").tobytes()], pa.binary()),
            }
        )

    blocks = tiles.where(F.col("block") >= 0).select("block", "chunk", "n", "kind", "data")
    return blocks.mapInArrow(_partial(slices), _PARTIAL).groupBy("chunk").applyInArrow(
        reduce, "chunk long, labels binary"
    )


def _sums(k: int):
    """Map of tiles with labels to one row per block and cluster of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                b = row["block"]
                x = np.frombuffer(row["data"], dtype=row["kind"]).astype(np.int64).reshape(row["n"], -1)
                label = np.frombuffer(row["labels"], dtype="<i4")
                if b not in sums:
                    sums[b] = np.zeros((k, x.shape[1]), dtype=np.int64)
                    counts[b] = np.zeros(k, dtype=np.int64)
                np.add.at(sums[b], label, x)
                counts[b] += np.bincount(label, minlength=k)
        for b, total in sums.items():
            held = np.flatnonzero(counts[b])
            padded = np.zeros((len(held), WIDTH), dtype=np.int64)
            padded[:, : total.shape[1]] = total[held]
            arrays = [pa.array(np.full(len(held), b, dtype=np.int32)), pa.array(held.astype(np.int32))]
            arrays += [pa.array(counts[b][held])] + [pa.array(np.ascontiguousarray(c)) for c in padded.T]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "cluster", "n", *[f"s{i}" for i in range(WIDTH)]])

    return run


def _moved(tiles: DataFrame, labels: DataFrame, slices: list[np.ndarray]) -> list[np.ndarray]:
    """Slices of the centroids after one round; every block finds its own floor(sum / count)."""
    k = len(slices[0])
    each = F.explode(F.sequence(F.lit(0), F.lit(len(slices) - 1))).alias("block")
    blocks = tiles.where(F.col("block") >= 0).select("block", "chunk", "n", "kind", "data")
    joined = blocks.join(labels.select(each, "chunk", "labels"), ["block", "chunk"])
    columns = [f"s{i}" for i in range(WIDTH)]
    schema = "block int, cluster int, n long, " + ", ".join(f"{c} long" for c in columns)
    sums = joined.mapInArrow(_sums(k), schema).groupBy("block", "cluster").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]
    )
    # At most k rows per block, whatever the number of vectors.
    floors = [F.expr(f"({c} - pmod({c}, n)) div n").alias(c) for c in columns]
    out = [s.copy() for s in slices]
    for row in sums.select("block", "cluster", *floors).collect():
        width = out[row["block"]].shape[1]
        out[row["block"]][row["cluster"]] = [row[c] for c in columns[:width]]
    return out


def cluster(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5,
    dims: int = 64, scale: int = 256, salt: str = "2:",
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of exactly ``dims`` components, none NULL or non-finite; a component x becomes
    floor(``scale`` * x), and one beyond 2^27 in size is an error.  The first centroids are the ``k`` kept
    vectors with the smallest hex SHA-256 of ``salt`` and id, equal ids by their components, NULL ids last; with
    fewer vectors there are fewer centroids.  Each round assigns all vectors (ties to the smaller number) and
    moves every non-empty centroid to the floor of its mean; rounds after one that moves nothing would
    repeat it and are left out.  Repeated rows count each; an empty table gives an empty table.  Other columns
    do not matter, whatever their names.  ``k`` and ``dims`` bound what the driver holds.
    """
    spark = vectors.sparkSession
    id_type = vectors.select(quoted(id)).dtypes[0][1]
    raw = quoted(vector)
    sound = raw.isNotNull() & (F.size(raw) == dims) & F.forall(
        raw, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )

    def whole(x):
        value = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(x.cast("double")) * scale < LIMIT, value).otherwise(
            F.raise_error(F.lit(f"a component is beyond {LIMIT} / {scale}")).cast("long")
        )

    kept = vectors.where(sound).select(quoted(id).alias("id"), F.transform(raw, whole).alias("x"))
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()
    empty = spark.createDataFrame(
        [], f"id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    ).withColumnRenamed("id", id)
    if not first:
        return empty
    start = np.array([r["x"] for r in first], dtype=np.int64)
    slices = [start[:, at : at + WIDTH] for at in range(0, dims, WIDTH)]
    k = len(start)
    tiles, name = _bucketed(_tiles(kept, dims))
    for _ in range(rounds):
        moved = _moved(tiles, _labels(tiles, slices), slices)
        same = all(np.array_equal(a, b) for a, b in zip(moved, slices))
        slices = moved
        if same:
            break

    def assign(table: pa.Table) -> pa.Table:
        label, distance = _nearest(table, k)
        ids = table["ids"].combine_chunks()
        return pa.table({"id": ids.flatten(), "cluster": pa.array(label.astype(np.int32)), "distance": pa.array(distance)})

    blocks = tiles.where(F.col("block") >= 0).select("block", "chunk", "n", "kind", "data")
    named = tiles.where(F.col("block") == IDS).select("chunk", "n", "kind", "data", "ids")
    parts = blocks.mapInArrow(_partial(slices), _PARTIAL).unionByName(named, allowMissingColumns=True)
    assigned = cut_lineage(
        parts.groupBy("chunk").applyInArrow(assign, f"id {id_type}, cluster int, distance long")
    )
    spark.sql(f"DROP TABLE {name}")
    final = np.concatenate(slices, axis=1)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in final.tolist()]
    known = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    # One row per centroid.
    return assigned.join(F.broadcast(per.join(F.broadcast(known), "cluster")), "cluster").select(
        F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
