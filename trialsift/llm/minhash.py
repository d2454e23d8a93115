"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

A sketch has ``BANDS * ROWS`` coordinates.  In each round every shingle throws its value of that round into one hashed bin;
rounds go on until all bins are filled, and from round ``t`` on a round serves one bin alone, so
that every coordinate fills however small the set (Dahlgaard, Knudsen and Thorup, 2017).  Documents
that agree in all rows of a band meet in a bucket.

Work is on distinct shingle sets; copies only carry a class number.  In a bucket every member is
paired with its smallest and its largest document and the pairs are verified on full sets.  Where
a bucket still holds several components, the members outside the largest one are compared with all
others, again on full sets, in blocks of bounded size; a block gives back only the links that join
components, never all pairs.  So no link between components is lost to the pairing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialsift.llm.common import fresh, quoted, text_slices
from trialsift.llm.components import connected_components
from trialsift.llm.idsets import marked
from trialsift.llm.shingles import mix, seed, shingle_sets
from trialsift.session import cut_lineage

BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
BLOCK = 512  # members of a bucket compared in one block
PAIRED = 3  # in a bucket of so many members the pairs with the ends are all pairs


def fill_bins(values: np.ndarray, owner: np.ndarray, count: int, bins: int = BINS) -> np.ndarray:
    """Sketches of ``count`` sets, given their elements and the set each belongs to.

    Every set must have an element.  A coordinate holds ``round << 48 | hash``, so earlier rounds
    win; a set leaves when all its coordinates are filled.
    """
    empty = np.uint64(_EMPTY)
    sketch = np.full(count * bins, empty, dtype=np.uint64)
    held = np.arange(count)
    for r in range(2 * bins):
        hashed = mix(values ^ seed(1000 + r))
        worth = (hashed & np.uint64(0xFFFFFFFFFFFF)) | np.uint64(r << 48)
        if r < bins:
            at = ((hashed >> np.uint64(48)) * np.uint64(bins) >> np.uint64(16)).astype(np.int64)
        else:
            at = np.full(len(values), r - bins, dtype=np.int64)
        np.minimum.at(sketch, owner * bins + at, worth)
        open_ = (sketch.reshape(count, bins)[held] == empty).any(axis=1)
        if not open_.any():
            break
        if not open_.all():
            held = held[open_]
            stays = np.zeros(count, dtype=bool)
            stays[held] = True
            kept = stays[owner]
            values, owner = values[kept], owner[kept]
    return sketch.reshape(count, bins)


_EMPTY = (1 << 64) - 1


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    total = np.zeros((len(sketch), BANDS), dtype=np.uint64)
    for i in range(ROWS):
        total = mix(total ^ parts[:, :, i]) + seed(i)
    return mix(total ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, rows=1000):
                sets = list(shingle_sets(part.column(1).to_pylist(), words))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                filled = np.flatnonzero(sizes)
                digest = np.zeros((len(sets), 2), dtype=np.int64)
                for i in filled.tolist():
                    raw = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    digest[i] = np.frombuffer(raw, dtype=np.int64)
                bands: list = [None] * len(sets)
                if len(filled):
                    owner = np.repeat(np.arange(len(filled)), sizes[filled])
                    sketch = fill_bins(np.concatenate([sets[i] for i in filled]), owner, len(filled))
                    for i, keys in zip(filled.tolist(), band_keys(sketch)):
                        bands[i] = keys
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _verified(words: int, percent: int):
    """Pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[str, np.ndarray]] = {}

        def set_of(side: int, text: str) -> np.ndarray:
            # Rows arrive sorted by the second document, so its set is often the one just made.
            if side not in last or last[side][0] != text:
                last[side] = (text, next(shingle_sets([text], words)))
            return last[side][1]

        for batch in batches:
            keep = []
            texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for i, (left, right) in enumerate(texts):
                x, y = set_of(0, left), set_of(1, right)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``x``, ``y`` that reach the similarity, by the documents' whole texts."""
    pairs = cut_lineage(pairs)
    wanted = _texts_of(texts, pairs.select("x").union(pairs.select("y")))
    left = pairs.join(wanted.select(F.col("id").alias("x"), F.col("text").alias("a")), "x")
    both = left.join(wanted.select(F.col("id").alias("y"), F.col("text").alias("b")), "y")
    kept = both.select("x", "y", "a", "b").mapInArrow(
        _verified(words, percent), both.select("x", "y").schema
    )
    return cut_lineage(kept.distinct())


def _joining(words: int, percent: int):
    """Links that join components, of a block's strays (``side`` 0) to its members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        strays, members = group[group.side == 0], group[group.side == 1]
        out: list[tuple[int, int]] = []
        if len(strays) and len(members):
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.setdefault(c, c) != c:
                    root[c] = c = root[root[c]]
                return c

            sets = list(shingle_sets(members.text.tolist(), words))
            sizes = np.array([len(s) for s in sets])
            all_shingles, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            ids, components = members.node.tolist(), members.component.to_numpy()
            marked = np.zeros(len(all_shingles), dtype=np.int32)
            own_sets = shingle_sets(strays.text.tolist(), words)
            for node, component, own in zip(strays.node.tolist(), strays.component.tolist(), own_sets):
                at = np.searchsorted(all_shingles, own)
                at = at[at < len(all_shingles)]
                at = at[np.isin(all_shingles[at], own)]
                marked[at] = 1
                shared = np.add.reduceat(marked[numbers], starts)
                marked[at] = 0
                linked = 100 * shared >= percent * (sizes + len(own) - shared)
                for i in np.flatnonzero(linked & (components != component)).tolist():
                    x, y = find(component), find(int(components[i]))
                    if x != y:
                        root[x] = y
                        out.append((min(node, ids[i]), max(node, ids[i])))
        return pd.DataFrame(out, columns=["x", "y"]).astype("int64")

    return run


def across_components(buckets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links across components within buckets (``key``, ``node``, ``component``).

    In each bucket the members outside its largest component are compared with all members;
    both sides are cut into blocks, so a group of the comparison is of bounded size.
    """
    sizes = buckets.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = (
        sizes.groupBy("key")
        .agg(
            F.sum("n").alias("members"),
            F.max(F.struct("n", "component")).alias("top"),
            F.count("*").alias("parts"),
        )
        .where((F.col("parts") > 1) & (F.col("members") > PAIRED))
    )
    split = split.select(
        F.col("key"),
        F.col("top.component").alias("main"),
        F.ceil(F.col("members") / BLOCK).alias("cols"),
        F.ceil((F.col("members") - F.col("top.n")) / BLOCK).alias("rows"),
    )
    rows = buckets.join(split, "key")
    spot, none = F.xxhash64("node"), F.lit(0).cast("long")
    strays = rows.where(F.col("component") != F.col("main")).select(
        "key",
        F.pmod(spot, F.col("rows")).alias("i"),
        F.explode(F.sequence(none, F.col("cols") - 1)).alias("j"),
        F.lit(0).alias("side"), "node", "component",
    )
    members = rows.select(
        "key",
        F.explode(F.sequence(none, F.col("rows") - 1)).alias("i"),
        F.pmod(spot, F.col("cols")).alias("j"),
        F.lit(1).alias("side"), "node", "component",
    )
    blocks = cut_lineage(strays.unionByName(members))
    full = blocks.join(_texts_of(texts, blocks.select("node")), F.col("node") == F.col("id"))
    found = full.select("key", "i", "j", "side", "node", "component", "text").groupBy("key", "i", "j")
    return cut_lineage(found.applyInPandas(_joining(words, percent), "x long, y long").distinct())


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct texts (``id``, ``text``) of some documents; other texts stay where they are."""
    needed = nodes.toDF("n").distinct()
    likely = marked(texts, F.col("id"), needed, "likely").where("likely").drop("likely")
    wanted = likely.join(needed, F.col("id") == F.col("n"), "left_semi")
    return wanted.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 85
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when ``100 * |intersection| >= percent * |union|`` of their sets of
    distinct ``words``-word shingles (A-Z lower-cased; a shorter text is one shingle).  A component
    is named by its smallest id, and ``kept`` says that a document is that one.  Texts that are
    NULL, empty or without words have no shingles and are components of their own.  Rows with
    the same id are one document: they share a component.  A row without an id is linked with
    nothing, has no component and is kept.  An empty table gives an empty table.
    """
    plain = docs.select(quoted(id).cast("long").alias("id"), quoted(text).cast("string").alias("text"))
    sketches = cut_lineage(
        plain.mapInArrow(
            _sketches(words),
            "id long, n_shingles long, set_a long, set_b long, bands array<long>",
        )
    )
    counted = sketches.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = cut_lineage(
        counted.groupBy("set_a", "set_b").agg(
            F.min("id").alias("node"),
            F.first("bands").alias("bands"),
        )
    )
    banded = classes.select(F.explode("bands").alias("key"), "node")
    buckets = banded.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")
    )
    buckets = buckets.where((F.col("n") > 1) & (F.col("low") < F.col("high"))).drop("n")
    members = cut_lineage(banded.join(buckets, "key"))
    ends = members.select(
        F.explode(
            F.array(
                F.struct(F.col("low").alias("x"), F.col("node").alias("y")),
                F.struct(F.col("node").alias("x"), F.col("high").alias("y")),
            )
        ).alias("p")
    ).select("p.x", "p.y")
    first = ends.where(F.col("x") < F.col("y")).distinct()
    links = verify(first, plain, words, percent)
    # The rows of one id are linked, whatever their texts.
    same = counted.join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"])
    own = same.where(F.col("id") != F.col("node")).select(F.col("id").alias("x"), F.col("node").alias("y"))
    found = connected_components(links.unionByName(_repeated(counted, own)), "x", "y")

    labelled = members.join(found, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    more = across_components(labelled.distinct(), plain, words, percent)
    if not more.isEmpty():
        found = connected_components(
            links.unionByName(more).unionByName(_repeated(counted, own)), "x", "y"
        )
    of_class = classes.select("set_a", "set_b", "node").join(found, "node", "left").select(
        "set_a", "set_b", F.coalesce("component", "node").alias("component_id")
    )
    linked = sketches.join(of_class, ["set_a", "set_b"], "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return linked.select(
        F.col("id").alias(id),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document of its smallest id.

    Of rows that repeat an id one stays, that with the smallest hash of its text.  Rows without an
    id all stay.  Columns are those of ``docs``.
    """
    found = near_duplicates(docs, id, text, words, percent).where(quoted(id).isNotNull())
    several = found.groupBy(quoted(id)).count().where("count > 1").select(quoted(id))
    gone, held, spot = fresh(docs, "gone", "held", "spot")
    # Only rows whose id may be dropped or repeated are brought together by id.
    unsure = cut_lineage(found.where(~F.col("kept")).select(quoted(id)).union(several).toDF(gone).distinct())
    both = marked(docs, quoted(id), unsure, held)
    plain = both.where(~quoted(held)).drop(held)
    dropped = cut_lineage(found.where(~F.col("kept")).select(quoted(id).alias(gone)).distinct())
    rows = both.where(quoted(held)).drop(held)
    rows = rows.join(dropped, quoted(id).cast("long") == quoted(gone), "left_anti")
    # The join has brought the rows of an id together, so the window needs no further exchange.
    first = Window.partitionBy(quoted(id)).orderBy(F.xxhash64(quoted(text)))
    one = rows.withColumn(spot, F.row_number().over(first)).where(quoted(spot) == 1).drop(spot)
    return plain.unionByName(one)


def _repeated(counted: DataFrame, own: DataFrame) -> DataFrame:
    """Links of ids that stand in several rows with different sets to the nodes of those sets."""
    ids = counted.groupBy("id").agg(F.min(F.struct("set_a", "set_b")).alias("a"), F.max(F.struct("set_a", "set_b")).alias("b"))
    several = ids.where(F.col("a") != F.col("b")).select(F.col("id").alias("x"))
    return own.join(several, "x", "left_semi").distinct()
