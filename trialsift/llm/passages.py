"""Passages that documents share, exactly or nearly, by collinear chaining of shared seeds.

1. Seeds are hashes of ``K`` words at every place.  Of 50 words of which ten differ, a run of ``K``
   agrees at least.  Work is on distinct texts.
2. A seed in several texts links each of its places to its first and its last place (by document and
   position) and to the places beside it, of the next lower and the next higher document: four
   anchors for each place at most, however common the seed is.
3. Per document and partner, runs of anchors are chained in order: the best chain ending in a run is
   its own worth plus the best chain before it in both texts, less the cost of the gap.  With gap costs
   linear in both distances the best predecessor is a prefix maximum, kept in a Fenwick tree.
4. Chains are aligned on the words of both texts, a little beyond their ends: along the diagonals of
   the chain, changing from one to the next where most words agree.  Stretches are kept where four
   of five words agree.
5. The aligned stretches of a document that overlap, whichever partner they come from, are united; what
   has ``MIN_WORDS`` words or more is a passage.  Stretches that only touch stay two.

A document's anchors are bounded by its own length, and every step is keyed by document; texts are
joined only for documents with a chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialsift.llm.common import partitions, quoted, text_slices
from trialsift.llm.idsets import marked
from trialsift.llm.shingles import mix, seed, windows, word_hashes, words_of
from trialsift.session import cut_lineage

K = 4
MIN_WORDS = 50
MIN_OPEN = 8  # words a chain spans at least to be aligned
MIN_CHAIN = 20  # words of the shortest stretch that is kept
GAP_COST = 0.1  # per word of a gap, in either text
MARGIN = 48  # words aligned beyond both ends of a chain
AGREE = 0.6  # alignment score per word: matches less differences; four of five words agree


def grams(hashes: np.ndarray) -> np.ndarray:
    """Seeds of a text, given its words' hashes: one for each place."""
    if len(hashes) < K:
        return np.array([], dtype=np.int64)
    return mix(windows(hashes, K) ^ seed(7)).view(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of texts and 32 bits of the hash of every word."""
    for batch in batches:
        for part in text_slices(batch, 1, rows=500):
            digests, counts, hashes = [], [], []
            for text in part.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                words = words_of(text)
                counts.append(len(words))
                hashes.append(word_hashes(words).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), pa.array(hashes, pa.binary())],
                ["id", "digest", "n_words", "words"],
            )


SLICE = 1 << 16  # rows of one output batch
HELD = 1 << 20  # places or anchors that a task collects before it packs them
SEED_BYTES = 5  # of a seed's hash that travel, beside the number of its bucket
LEAST, MOST = 1 << 14, 1 << 20  # places of a bucket on average
PER_PARTITION = 8  # buckets of a shuffle partition, if they have ``LEAST`` places


def packed(values: np.ndarray) -> bytes:
    """Differences of whole numbers, byte by byte (all lowest bytes first), compressed."""
    steps = np.diff(values.astype("<i8"), prepend=np.int64(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * count, codec="zstd"), dtype=np.uint8).reshape(8, count)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8")[:, 0])


def packed_hashes(rest: np.ndarray) -> bytes:
    """The low ``SEED_BYTES`` bytes of each."""
    return rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SEED_BYTES].tobytes()


def unpacked_hashes(raw: bytes, count: int) -> np.ndarray:
    wide = np.zeros((count, 8), dtype=np.uint8)
    wide[:, :SEED_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(count, SEED_BYTES)
    return wide.view("<i8")[:, 0]


def bucket_count(words: int, parts: int) -> int:
    """Buckets follow the words, so that packs stay large however many tasks write them."""
    return max(1, min(PER_PARTITION * parts, words // LEAST), -(-words // MOST))


def bucket_bounds(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Buckets with the begin and end of their rows, which are sorted by bucket."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    yield from zip(bucket[starts].tolist(), starts.tolist(), np.append(starts[1:], len(bucket)).tolist())


_SEEDS = "bucket int, n int, h binary, node binary, p binary"
_ANCHORS = "bucket int, n int, x binary, y binary, d binary, a binary"


def _packs(names: list[str], bucket: np.ndarray, columns: list[np.ndarray], encoders: list) -> Iterator[pa.RecordBatch]:
    """One row per bucket, its columns packed; rows are sorted by bucket."""
    rows = [
        (number, end - start, *(encode(c[start:end]) for encode, c in zip(encoders, columns)))
        for number, start, end in bucket_bounds(bucket)
    ]
    if rows:
        kinds = [pa.int32()] * 2 + [pa.binary()] * len(columns)
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", "n", *names])


def _by_bucket(batches: Iterator[pa.RecordBatch], decoders: list) -> Iterator[list[np.ndarray]]:
    """Columns of one bucket after another, from packs sorted by bucket."""
    number: int | None = None
    held: list[list[np.ndarray]] = []
    for batch in batches:
        buckets, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, (bucket, count) in enumerate(zip(buckets, counts)):
            if bucket != number and held:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            number = bucket
            held.append([decode(batch.column(j + 2)[i].as_py(), count) for j, decode in enumerate(decoders)])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _places(buckets: int):
    """Every seed of every text with its place, packed by the bucket of the seed."""

    def pack(found: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        counts = [len(g) for g in found]
        h = np.concatenate(found).view(np.uint64)
        bucket = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        node = np.repeat(np.array(nodes, dtype=np.int64), counts)[order]
        p = np.concatenate([np.arange(n, dtype=np.int64) for n in counts])[order]
        rest = (h // np.uint64(buckets))[order]
        yield from _packs(["h", "node", "p"], bucket[order], [rest, node, p], [packed_hashes, packed, packed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        nodes: list[int] = []
        held = 0
        for batch in batches:
            for i, node in enumerate(batch.column(0).to_pylist()):
                words = np.frombuffer(batch.column(1)[i].as_py(), dtype=np.uint32)
                found.append(grams(words.astype(np.uint64)))
                nodes.append(node)
                held += len(found[-1])
                if held >= HELD:
                    yield from pack(found, nodes)
                    found, nodes, held = [], [], 0
        if held:
            yield from pack(found, nodes)

    return run


def links(h: np.ndarray, node: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and the rows they are linked to; rows are sorted by seed, document and place.

    ``at`` are the rows that are wanted.  Each is linked to the first and the last place of its seed
    and to the places beside it that are of the next lower and the next higher document.
    """
    new_seed = np.concatenate([[True], h[1:] != h[:-1]])
    new_node = new_seed | np.concatenate([[True], node[1:] != node[:-1]])
    first, begins = np.flatnonzero(new_seed), np.flatnonzero(new_node)
    last, ends = np.append(first[1:], len(h)) - 1, np.append(begins[1:], len(h))
    group, own = np.cumsum(new_seed)[at] - 1, np.cumsum(new_node)[at] - 1
    low, high = first[group], last[group]
    several = node[low] < node[high]
    at, own, low, high = at[several], own[several], low[several], high[several]
    yield at[node[low] != node[at]], low[node[low] != node[at]]
    yield at[node[high] != node[at]], high[node[high] != node[at]]
    before, after = begins[own] - 1, ends[own]
    there = before >= low
    there[there] = node[before[there]] != node[low[there]]
    yield at[there], before[there]
    there = after <= high
    there[there] = node[after[there]] != node[high[there]]
    yield at[there], after[there]


def _linked(buckets: int):
    """Anchors of packed places, packed by the bucket of their document."""

    def pack(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x, y, d, a = (np.concatenate(c) for c in zip(*found))
        bucket = (mix(x.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((a, d, y, x, bucket))
        columns = [c[order] for c in (x, y, d, a)]
        yield from _packs(["x", "y", "d", "a"], bucket[order], columns, [packed] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        held = 0
        for h, node, p in _by_bucket(batches, [unpacked_hashes, unpacked, unpacked]):
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            # A seed with a single place links nothing.
            order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            h, node, p = h[order], node[order], p[order]
            order = np.lexsort((p, node, h))
            h, node, p = h[order], node[order], p[order]
            for start in range(0, len(h), SLICE):
                for u, v in links(h, node, np.arange(start, min(start + SLICE, len(h)))):
                    found.append([node[u], node[v], p[v] - p[u], p[u]])
                    held += len(u)
                if held >= HELD:
                    yield from pack(found)
                    found, held = [], 0
        if held:
            yield from pack(found)

    return run


class Fenwick:
    """Prefix maxima of values that only grow, with the place each comes from."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, owner: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, owner)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Best among places before ``i``."""
        found = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > found[0]:
                found = self.best[i]
            i -= i & -i
        return found


def chains_of_runs(xs: list[int], ys: list[int], sizes: list[int]) -> list[list[int]]:
    """Chains of runs of anchors (their numbers) in falling order of scores, each run in one chain at most.

    A run begins at an anchor and goes on with ``sizes`` anchors, one word apart in both texts.
    """
    order = sorted(range(len(xs)), key=lambda i: (xs[i], -ys[i]))
    ending = sorted(order, key=lambda i: xs[i] + sizes[i])
    rank = {y: r for r, y in enumerate(sorted({*ys, *(y + n - 1 for y, n in zip(ys, sizes))}))}
    tree = Fenwick(len(rank))
    score, back = [0.0] * len(xs), [-1] * len(xs)
    done = 0
    for i in order:
        # Only runs that end before this one begins, in both texts.
        while xs[ending[done]] + sizes[ending[done]] <= xs[i]:
            j = ending[done]
            x, y = xs[j] + sizes[j] - 1, ys[j] + sizes[j] - 1
            tree.put(rank[y], score[j] + GAP_COST * (x + y), j)
            done += 1
        found, j = tree.upto(rank[ys[i]])
        gain = found - GAP_COST * (xs[i] + ys[i])
        worth = K * sizes[i] - 2 * GAP_COST * (sizes[i] - 1)
        score[i], back[i] = (worth + gain, j) if gain > 0 else (worth, -1)
    used, out = [False] * len(xs), []
    for end in sorted(order, key=lambda i: -score[i]):
        path, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(path[::-1])
    return out


def chains(xs: list[int], ys: list[int]) -> list[list[tuple[int, int]]]:
    """Chains of single anchors."""
    return [[(xs[i], ys[i]) for i in path] for path in chains_of_runs(xs, ys, [1] * len(xs))]


def diagonal_runs(path: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Begins, ends and diagonals (y - x) of the stretches of a chain on one diagonal."""
    begins: list[int] = []
    ends: list[int] = []
    diagonals: list[int] = []
    for x, y, n in path:
        if diagonals and diagonals[-1] == y - x:
            ends[-1] = x + n - 1 + K
        else:
            begins.append(x)
            ends.append(x + n - 1 + K)
            diagonals.append(y - x)
    return begins, ends, diagonals


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed anchors to chains; in a bucket they are taken by (x, y, diagonal, place in x)."""
    key: tuple[int, int] | None = None
    xs: list[int] = []
    ys: list[int] = []
    sizes: list[int] = []
    out: list[tuple] = []

    def close() -> None:
        if key is not None:
            for found in chains_of_runs(xs, ys, sizes):
                path = [(xs[i], ys[i], sizes[i]) for i in found]
                (a, c, _), (b, d, n) = path[0], path[-1]
                if b + n - 1 - a + K >= MIN_OPEN:
                    out.append((*key, a, b + n - 1 + K, c, d + n - 1 + K, *diagonal_runs(path)))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 9
        kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["x", "y", "x0", "x1", "y0", "y1", "begins", "ends", "diagonals"],
        )

    for columns in _by_bucket(batches, [unpacked] * 4):
        order = np.lexsort(columns[::-1])
        x, y, d, a = (c[order] for c in columns)
        apart = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)
        starts = np.concatenate([[0], np.flatnonzero(apart) + 1])
        lengths = np.diff(np.append(starts, len(x)))
        # Pairs of texts whose anchors all lie within a few words have no chain to be aligned.
        u, v, begin = x[starts], y[starts], a[starts]
        pairs = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
        reach = np.maximum.reduceat(begin + lengths - 1, pairs) - np.minimum.reduceat(begin, pairs) + K
        wide = np.repeat(reach >= MIN_OPEN, np.diff(np.append(pairs, len(starts))))
        starts, lengths = starts[wide], lengths[wide]
        rows = zip(*(c[starts].tolist() for c in (x, y, a, a + d)), lengths.tolist())
        for u, v, begin, other, n in rows:
            if (u, v) != key:
                close()
                key, xs, ys, sizes = (u, v), [], [], []
            xs.append(begin)
            ys.append(other)
            sizes.append(n)
        yield batch_of()
        out.clear()
    close()
    yield batch_of()


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of stretches of texts, with margins."""
    for batch in batches:
        owners, begins, ends, slices = [], [], [], []
        for node, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            hashes = word_hashes(words_of(text))
            for span in spans:
                a, b = span["a"], span["b"]
                owners.append(node)
                begins.append(a)
                ends.append(b)
                slices.append(hashes[max(0, a - MARGIN) : b + MARGIN].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(owners, pa.int64()),
                pa.array(begins, pa.int32()),
                pa.array(ends, pa.int32()),
                pa.array(slices, pa.binary()),
            ],
            ["node", "a", "b", "words"],
        )


def align(
    x: np.ndarray, y: np.ndarray, first_x: int, first_y: int, runs: tuple[list[int], list[int], list[int]]
) -> list[tuple[int, int, int, int]]:
    """Stretches (x begin, x end, y begin, y end) that agree, along the diagonals of a chain.

    ``x`` and ``y`` are the words from ``first_x`` and ``first_y`` on.  Between two diagonals the change is
    made where most words agree; it costs the difference of the diagonals.
    """
    begins, ends, diagonals = runs
    places = first_x + np.arange(len(x))

    def agree(diagonal: np.ndarray | int, at: np.ndarray) -> np.ndarray:
        other = at + diagonal - first_y
        inside = (other >= 0) & (other < len(y))
        return inside & (x[at - first_x] == y[np.clip(other, 0, len(y) - 1)])

    changes = [first_x]
    for k in range(1, len(begins)):
        low = max(min(ends[k - 1], begins[k]), changes[-1])
        gap = np.arange(low, max(begins[k], low))
        before = np.concatenate([[0], np.cumsum(agree(diagonals[k - 1], gap))])
        after = np.concatenate([[0], np.cumsum(agree(diagonals[k], gap))])
        changes.append(low + int(np.argmax(before + after[-1] - after)))
    lengths = np.diff([*changes, first_x + len(x)])
    diagonal = np.repeat(np.array(diagonals), lengths)
    step = np.where(agree(diagonal, places), 1, -1)
    for k in range(1, len(changes)):
        if changes[k] - first_x < len(step):
            step[changes[k] - first_x] -= abs(diagonals[k] - diagonals[k - 1])
    out, parts = [], [(0, len(step))]
    while parts:
        a, b = parts.pop()
        if b - a < MIN_CHAIN:
            continue
        total = np.concatenate([[0], np.cumsum(step[a:b])])
        least = np.minimum.accumulate(total)
        gain = total[1:] - least[:-1]
        end = int(np.argmax(gain)) + 1
        begin = int(np.flatnonzero(total[:end] == least[end - 1])[-1])
        if end - begin < MIN_CHAIN:
            continue
        i, j = a + begin, a + end
        if gain[end - 1] < AGREE * (end - begin):
            # Stretches joined over words that differ: parted at the worst run inside, which may hold others.
            inner = total[begin : end + 1]
            fall = np.maximum.accumulate(inner)[:-1] - inner[1:]
            v = int(np.argmax(fall)) + 1
            u = int(np.argmax(inner[:v]))
            parts += [(a, i), (i, i + u), (i + u, i + v), (i + v, j), (j, b)]
            continue
        out.append((first_x + i, first_x + j, int(places[i] + diagonal[i]), int(places[j - 1] + diagonal[j - 1]) + 1))
        parts += [(a, i), (j, b)]
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            x = np.frombuffer(r["x_words"], dtype=np.uint64)
            y = np.frombuffer(r["y_words"], dtype=np.uint64)
            first_x, first_y = max(0, r["x0"] - MARGIN), max(0, r["y0"] - MARGIN)
            for a, b, c, d in align(x, y, first_x, first_y, (r["begins"], r["ends"], r["diagonals"])):
                rows.append((r["x"], a, b, r["y"], c, d))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["x", "x0", "x1", "y", "y0", "y1"]
        )


def shared_stretches(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Aligned stretches between distinct texts, and the classes of equal texts.

    The first has ``x``, ``x0``, ``x1``, ``y``, ``y0``, ``y1`` (documents and word ranges, ends exclusive), where
    ``x`` and ``y`` are the smallest ids of their texts; the second ``node``, ``digest``, ``n_words`` and
    ``members``.
    """
    plain = docs.where(quoted(id).isNotNull()).select(
        quoted(id).cast("long").alias("id"), quoted(text).cast("string").alias("text")
    )
    hashed = plain.mapInArrow(_words, "id long, digest binary, n_words int, words binary")
    classes = cut_lineage(
        hashed.groupBy("digest").agg(
            F.min("id").alias("node"),
            F.max("id").alias("other"),
            F.count("*").alias("members"),
            F.first("n_words").alias("n_words"),
            F.first("words").alias("words"),
        ),
        free=True,
    )
    parts = partitions(docs.sparkSession)
    words = classes.agg(F.sum(F.col("n_words").cast("long"))).first()[0] or 0
    buckets = bucket_count(words, parts)
    places = classes.select("node", "words").mapInArrow(_places(buckets), _SEEDS)
    by_seed = places.repartition(parts, "bucket").sortWithinPartitions("bucket")
    anchors = by_seed.mapInArrow(_linked(buckets), _ANCHORS)
    by_document = anchors.repartition(parts, "bucket").sortWithinPartitions("bucket")
    chained = cut_lineage(
        by_document.mapInArrow(
            _chained,
            "x long, y long, x0 int, x1 int, y0 int, y1 int, begins array<int>, ends array<int>, diagonals array<int>",
        ),
        free=True,
    )
    # Stretches whose words are needed: those of a document are bounded by its length.
    spans = chained.select(F.col("x").alias("node"), F.col("x0").alias("a"), F.col("x1").alias("b")).union(
        chained.select("y", "y0", "y1")
    )
    per_node = spans.distinct().groupBy("node").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    # Texts without a chain stay where they are.
    likely = marked(plain, F.col("id"), spans.select("node"), "likely").where("likely")
    one_text = likely.join(per_node, F.col("id") == F.col("node")).select("node", "text", "spans")
    slices = one_text.mapInArrow(_sliced, "node long, a int, b int, words binary")
    slices = cut_lineage(slices.groupBy("node", "a", "b").agg(F.first("words").alias("words")), free=True)
    x_side = slices.select(
        F.col("node").alias("x"), F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("words").alias("x_words")
    )
    y_side = slices.select(
        F.col("node").alias("y"), F.col("a").alias("y0"), F.col("b").alias("y1"), F.col("words").alias("y_words")
    )
    both = chained.join(x_side, ["x", "x0", "x1"]).join(y_side, ["y", "y0", "y1"])
    found = cut_lineage(
        both.mapInArrow(_aligned, "x long, x0 int, x1 int, y long, y0 int, y1 int"), free=True
    )
    return found, classes.drop("words")


def repeated_passages(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per document and passage of ``min_words`` or more that another document has too.

    ``doc_id``, ``start_word``, ``end_word`` (exclusive, words between ASCII white space, A-Z lower-cased),
    ``partner_id`` (a document with part of the passage), ``class_id`` (smallest id with the same
    text).  Copies have the passages of their class, and the whole text as one more if it is long
    enough.  Rows without an id, NULL and short texts have none; rows that repeat an id and a text
    are one document.  An empty table gives none.
    """
    found, classes = shared_stretches(docs, id, text)
    ordered = Window.partitionBy("x").orderBy("x0", "x1")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("x1").over(before)
    begins = found.withColumn("new", F.when(reach.isNull() | (F.col("x0") >= reach), 1).otherwise(0))
    islands = begins.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("x", "island").agg(
        F.min("x0").alias("start_word"), F.max("x1").alias("end_word"), F.min("y").alias("partner_id")
    )
    passages = merged.where(F.col("end_word") - F.col("start_word") >= min_words).drop("island")
    whole = classes.where((F.col("other") > F.col("node")) & (F.col("n_words") >= min_words))
    whole = whole.select(
        F.col("node").alias("x"),
        F.lit(0).alias("start_word"),
        F.col("n_words").alias("end_word"),
        F.lit(None).cast("long").alias("partner_id"),
    )
    per_class = passages.select("x", "start_word", "end_word", "partner_id").unionByName(whole)
    members = docs.where(quoted(id).isNotNull()).select(
        quoted(id).cast("long").alias("doc_id"),
        F.md5(F.coalesce(quoted(text).cast("string"), F.lit("")).cast("binary")).alias("m"),
    ).distinct()
    nodes = members.groupBy("m").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("last"))
    named = members.join(nodes, "m").drop("m")
    # A whole text's partner is the class's first document, or its last for the first itself.
    partner = F.coalesce(
        F.col("partner_id"), F.when(F.col("doc_id") == F.col("class_id"), F.col("last")).otherwise(F.col("class_id"))
    )
    return named.join(per_class, F.col("class_id") == F.col("x")).select(
        F.col("doc_id").alias(id), "start_word", "end_word", partner.alias("partner_id"), "class_id"
    )
