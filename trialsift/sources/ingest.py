"""Readers and writers of the binary trial formats: flip-index sets and bit-packed shots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialsift.plans.ranges import cumulative
from trialsift.session import ship_self
from trialsift.sources.files import escape_glob, glob, open_for_writing

_BATCH = r"_batch=(\d+)\.bin$"
_STEP = 100_000  # trials of one output batch


# ---- flip-index sets -------------------------------------------------------------------------


def _numbers(raw: np.ndarray) -> np.ndarray:
    """All variable-length numbers of a byte run: the high bit of a byte says that more follow."""
    ends = np.flatnonzero(raw < 128)
    if len(raw) and (not len(ends) or ends[-1] != len(raw) - 1):
        raise ValueError("unexpected end of data")
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else np.zeros(0, dtype=int)
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    bits = (raw & 127).astype(np.int64) << shift
    return np.add.reduceat(bits, starts) if len(ends) else np.zeros(0, dtype=np.int64)


def _varints(numbers: np.ndarray) -> np.ndarray:
    """Bytes of the numbers, seven bits each, low ones first."""
    numbers = numbers.astype(np.uint64)
    sizes = np.ones(len(numbers), dtype=np.int64)
    for k in range(1, 10):
        sizes += numbers >= np.uint64(1) << np.uint64(7 * k)
    owner = np.repeat(np.arange(len(numbers)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    low = (numbers[owner] >> (7 * place).astype(np.uint64)) & np.uint64(127)
    return (low + np.where(place < sizes[owner] - 1, 128, 0).astype(np.uint64)).astype(np.uint8)


def decode_flips(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all trials of one file and where each trial ends among them.

    A file holds a u64 count, then per trial a length and the differences of its rising indices.
    """
    if len(data) < 8:
        raise ValueError("file is too short for its header")
    n = int.from_bytes(data[:8], "little")
    numbers = _numbers(np.frombuffer(data, dtype=np.uint8, offset=8))
    heads, at, size = np.zeros(min(n, len(numbers)), dtype=np.int64), 0, len(numbers)
    for i in range(n):
        if at >= size:
            raise ValueError("unexpected end of data")
        heads[i] = at
        at += 1 + int(numbers[at])
        if at > size:
            raise ValueError("unexpected end of data")
    if at != size:
        raise ValueError("trailing data after the last trial")
    lengths = numbers[heads]
    deltas = np.delete(numbers, heads)
    ends = np.cumsum(lengths)
    sums = np.r_[0, np.cumsum(deltas)]
    return sums[1:] - np.repeat(sums[ends - lengths], lengths), ends


def encode_flips(flat: np.ndarray, lengths: np.ndarray) -> bytes:
    """Trials of rising indices, given one after another, without the file's header."""
    starts = np.cumsum(lengths) - lengths
    deltas = np.diff(flat, prepend=0)
    first = starts[lengths > 0]
    deltas[first] = flat[first]
    return _varints(np.insert(deltas, starts, lengths)).tobytes()


def decode_flip_blob(data: bytes) -> list[np.ndarray]:
    """Index sets of one file."""
    flat, ends = decode_flips(data)
    return np.split(flat, ends[:-1]) if len(ends) else []


def read_flip_sets(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, pos, flips)`` of all flip-index files below a path, one file per row of work."""
    ship_self(spark)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*_batch=*.bin")
        .load(path)
        .select(F.regexp_extract("path", _BATCH, 1).cast("int").alias("batch"), "content")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for batch, content in zip(part.column(0).to_pylist(), part.column(1)):
                flat, ends = decode_flips(content.as_py())
                bounds = np.r_[0, ends]
                for start in range(0, len(ends), _STEP):
                    own = bounds[start : start + _STEP + 1]
                    flips = pa.array(flat[own[0] : own[-1]].astype(np.int32))
                    lists = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), flips)
                    n = len(own) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, batch, dtype=np.int32)), pa.array(np.arange(start, start + n)), lists],
                        ["batch", "pos", "flips"],
                    )

    return files.mapInArrow(decode, "batch int, pos long, flips array<int>")


def _write_streams(
    rows: DataFrame, key: str, order: str, name: Callable[[int], str], head: Callable[[int], bytes],
    encode: Callable[[pa.RecordBatch], bytes],
) -> int:
    """Write the rows of each key to a file of its own, in ``order``; returns the number of rows.

    A key's rows are sorted by Spark and stream through a task in batches.  Their number comes first, from a
    window, which also keeps a key in one task: an exchange before a join on the same key may be dropped, and
    the join's own be read in pieces.  A file appears under its name only when it is complete.
    """
    ship_self(rows.sparkSession)
    rest = [c for c in rows.columns if c not in (key, order)]
    kept = rows.where(F.col(key).isNotNull())
    sorted_ = kept.select(key, F.count("*").over(Window.partitionBy(key)).alias("__n"), order, *rest)
    sorted_ = sorted_.sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, written = None, None, 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if keys[low] != current:
                    if out:
                        out.close()
                    current = keys[low]
                    out = open_for_writing(name(int(current)))
                    out.write(head(batch.column(1)[low].as_py()))
                out.write(encode(batch.slice(low, high - low)))
                written += high - low
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    return sorted_.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_flip_sets(
    rows: DataFrame, path: str, batch: str = "batch", order: str = "shot_id", flips: str = "flips",
    stem: str = "obs_flip_idx",
) -> int:
    """One file per batch, trials in ``order``; returns the number of trials.

    Index sets are written rising and without repetition.  Batches are written by different tasks at once.
    """
    sets = rows.select(
        F.col(batch).cast("long").alias("k"), F.col(order).alias("o"), F.array_sort(F.array_distinct(flips)).alias("f")
    )

    def encode(part: pa.RecordBatch) -> bytes:
        lists = part.column(3)
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        return encode_flips(lists.flatten().to_numpy().astype(np.int64), lengths)

    base = path.rstrip("/")
    return _write_streams(
        sets, "k", "o", lambda k: f"{base}/{stem}_batch={k}.bin", lambda n: int(n).to_bytes(8, "little"), encode
    )


def join_flip_labels(flips: DataFrame, labels: DataFrame, buckets: int | None = None) -> DataFrame:
    """Give each flip set the trial at its position once the trials are sorted by id.

    ``labels``: ``batch``, ``shot_id``, ``is_logical_error``.  Different counts in a batch are an
    error, raised before the join.
    """
    positions = cumulative(
        labels.select("batch", "shot_id"), "shot_id", by=["batch"], buckets=buckets
    ).select("batch", "shot_id", F.col("n_before").alias("pos"))
    a = flips.groupBy("batch").agg(F.count("*").alias("n_flips"))
    b = labels.groupBy("batch").agg(F.count("*").alias("n_labels"))
    unequal = a.join(b, "batch", "full").where(~F.col("n_flips").eqNullSafe(F.col("n_labels")))
    bad = unequal.limit(1).collect()
    if bad:
        raise ValueError(f"flip sets and labels differ in number: {bad[0].asDict()}")
    return (
        flips.join(positions, ["batch", "pos"])
        .join(labels, ["batch", "shot_id"])
        .select("batch", "shot_id", "flips", "is_logical_error")
    )


# ---- bit-packed shots ------------------------------------------------------------------------


def record_length(n_detectors: int, n_observables: int) -> int:
    """Bytes per trial."""
    return (n_detectors + n_observables + 7) // 8


_BLOCK = 8192  # records that are unpacked together


def _blocks(records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytearray]]:
    """Runs of consecutive records as one block each, with the number of its first record."""
    first, held, n = 0, bytearray(), 0
    for index, raw in records:
        if not n:
            first = index
        held += raw
        n += 1
        if n == _BLOCK:
            yield first, held
            held, n = bytearray(), 0
    if n:
        yield first, held


def read_bit_shots(
    spark: SparkSession, path: str, n_detectors: int, n_observables: int, offset: int = 0
) -> DataFrame:
    """``(file, shot_id, detectors, observables)`` from fixed-length little-endian bit records.

    All files are one scan over a list of paths, which Hadoop splits at record borders; so one large
    file is read by many tasks, and the plan is the same for any number of files.  A record's number
    is its id within the file, shifted by ``offset``.  ``detectors`` holds the set positions.
    """
    ship_self(spark)
    size = record_length(n_detectors, n_observables)
    found = glob(spark, path)
    if not found:
        raise FileNotFoundError(path)
    for name, length in found:
        if length % size:
            raise ValueError(f"{name} is not a multiple of {size} bytes")

    def listed(name: str) -> str:
        return escape_glob(name).replace("\\", "\\\\").replace(",", "\\,")

    records = spark.sparkContext.newAPIHadoopRDD(
        "org.apache.spark.input.FixedLengthBinaryInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={
            "org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(size),
            "mapreduce.input.fileinputformat.inputdir": ",".join(listed(name) for name, _ in found),
        },
    )
    blocks = records.mapPartitions(_blocks).toDF("first long, raw binary")
    # A split belongs to one file, whose name the task knows.
    named = blocks.select(F.input_file_name().alias("file"), (F.col("first") + offset).alias("first"), "raw")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, raw in zip(*(c.to_pylist() for c in batch.columns)):
                bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, size), axis=1, bitorder="little")
                n = len(bits)
                row, where = np.nonzero(bits[:, :n_detectors])
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)
                flags = bits[:, n_detectors : n_detectors + n_observables].astype(bool).ravel()
                borders = np.arange(0, n * n_observables + 1, n_observables) if n_observables else np.zeros(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * n, pa.string()),
                        pa.array(np.arange(first, first + n)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(where.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(flags, pa.bool_())),
                    ],
                    ["file", "shot_id", "detectors", "observables"],
                )

    return named.mapInArrow(
        unpack, "file string, shot_id long, detectors array<int>, observables array<boolean>"
    )


def write_bit_shots(
    rows: DataFrame, path: str, n_detectors: int, n_observables: int, file: str = "file", order: str = "shot_id",
    detectors: str = "detectors", observables: str = "observables",
) -> int:
    """One file of bit records per value of the whole number ``file``, trials in ``order``.

    Files are ``part=<file>.b8`` below ``path``; returns the number of trials.  A detector outside the
    record or another number of observables is an error.
    """
    size = record_length(n_detectors, n_observables)
    shots = rows.select(
        F.col(file).cast("long").alias("k"), F.col(order).alias("o"), F.col(detectors).alias("d"),
        F.col(observables).alias("b"),
    )

    def encode(part: pa.RecordBatch) -> bytes:
        lists, flags = part.column(3), part.column(4)
        n = part.num_rows
        bits = np.zeros((n, 8 * size), dtype=np.uint8)
        owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        where = lists.flatten().to_numpy()
        if len(where) and (where.min() < 0 or where.max() >= n_detectors):
            raise ValueError("a detector is outside the record")
        if (np.diff(flags.offsets.to_numpy()) != n_observables).any():
            raise ValueError("the number of observables is not that of the record")
        bits[owner, where] = 1
        bits[:, n_detectors : n_detectors + n_observables] = (
            flags.flatten().to_numpy(zero_copy_only=False).reshape(n, n_observables)
        )
        return np.packbits(bits, axis=1, bitorder="little").tobytes()

    base = path.rstrip("/")
    return _write_streams(shots, "k", "o", lambda k: f"{base}/part={k}.b8", lambda n: b"", encode)


def dense_bits(positions: str, n: int):
    """Array of booleans from an array of set positions."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(positions, i)
    )
