"""Sparse bipartite error models as tables.

A mechanism table has ``ord`` (order of appearance), ``prob`` and ``components``, an array of
structs with the arrays ``detectors`` and ``observables``.  Merged models are edge tables: ``(error_id,
detector_id)``, ``(error_id, observable_id)`` and ``(error_id, prior)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift.functions.exprs import xor_of_components
from trialsift.operators.idranges import dense_ids
from trialsift.plans.ranges import attach, cumulative
from trialsift.session import cut_lineage, settle, settle_table

# Basis by the fourth detector coordinate.
BASIS_BY_COORDINATE = {0: "X", 1: "X", 2: "X", 3: "Z", 4: "Z", 5: "Z"}


def combine_probabilities(p: str | Column) -> Column:
    """Probability that an odd number of independent events occurs: (1 - prod(1 - 2p)) / 2."""
    p_ = F.col(p) if isinstance(p, str) else p
    return (F.lit(1.0) - F.product(F.lit(1.0) - F.lit(2.0) * p_)) / F.lit(2.0)


def _merged(rows: DataFrame, buckets: int | None) -> DataFrame:
    grouped = rows.groupBy("detectors").agg(
        combine_probabilities("prob").alias("prior"),
        F.max_by("observables", "ord").alias("observables"),
        F.min("ord").alias("first_ord"),
    )
    # Read twice: to number the sets and to carry them.
    grouped, _ = settle(grouped, buckets)
    ids = dense_ids(grouped, "first_ord", "error_id", buckets)
    return grouped.join(ids, "first_ord").select(
        "error_id", "detectors", "observables", "prior", "first_ord"
    )


def merge_mechanisms(mechanisms: DataFrame, buckets: int | None = None) -> DataFrame:
    """Merge mechanisms with the same XOR-ed detector set; the last observable set wins.

    Ids follow the first appearance.
    """
    rows = mechanisms.select(
        "ord",
        "prob",
        xor_of_components("components.detectors").alias("detectors"),
        xor_of_components("components.observables").alias("observables"),
    )
    return _merged(rows, buckets)


def merge_edges(
    mechanisms: DataFrame, allow_hyperedges: bool = True, buckets: int | None = None
) -> DataFrame:
    """The same over single components of at most two detectors; larger ones are skipped or fail."""
    parts = mechanisms.select("ord", "prob", F.posexplode("components").alias("part", "c")).select(
        F.struct("ord", "part").alias("pair"),
        "ord",
        "part",
        "prob",
        F.array_sort(F.array_distinct("c.detectors")).alias("detectors"),
        F.array_sort(F.array_distinct("c.observables")).alias("observables"),
    )
    large = F.size("detectors") > 2
    if allow_hyperedges:
        parts = parts.where(~large)
    else:
        failed = F.raise_error(F.lit("a component has more than two detectors")).cast("double")
        parts = parts.withColumn("prob", F.when(large, failed).otherwise(F.col("prob")))
    # One number per component that rises with (mechanism, component).
    width = parts.agg((F.coalesce(F.max("part"), F.lit(0)) + 1).alias("__width"))
    rows = attach(parts, width, []).select(
        (F.col("ord") * F.col("__width") + F.col("part")).alias("ord"),
        "prob",
        "detectors",
        "observables",
    )
    return _merged(rows, buckets)


def check_edges(merged: DataFrame) -> DataFrame:
    return merged.select("error_id", F.explode("detectors").alias("detector_id"))


def observable_edges(merged: DataFrame) -> DataFrame:
    return merged.select("error_id", F.explode("observables").alias("observable_id"))


def detectors_to_drop(
    detectors: DataFrame, basis: str, basis_map: Mapping[int, str] | None = None
) -> DataFrame:
    """Ids of detectors of a basis, by the integer part of their fourth coordinate."""
    if basis not in ("X", "Z"):
        raise ValueError("basis must be 'X' or 'Z'")
    table = BASIS_BY_COORDINATE if basis_map is None else basis_map
    chosen = [int(c) for c, b in table.items() if b == basis]
    fourth = F.get("coords", F.lit(3)).cast("int")
    return detectors.where((F.size("coords") >= 4) & fourth.isin(chosen)).select("detector_id")


def drop_basis(
    mechanisms: DataFrame,
    detectors: DataFrame,
    basis: str,
    basis_map: Mapping[int, str] | None = None,
    buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Remove a basis from a model: (mechanisms with new detector ids, id mapping).

    A mechanism goes if its first component loses everything; later components that become empty
    are left out.  ``undetected`` marks a component that flips an observable without a detector.
    """
    removed = detectors_to_drop(detectors, basis, basis_map)
    kept = detectors.join(removed, "detector_id", "left_anti")
    mapping = dense_ids(kept, "detector_id", "new_detector_id", buckets)
    parts = mechanisms.select("ord", "prob", F.posexplode("components").alias("part", "c"))
    parts = parts.select("ord", "prob", "part", "c.detectors", "c.observables")
    slots = parts.select("ord", "part", F.posexplode("detectors").alias("place", "detector_id"))
    renamed = (
        slots.join(settle_table(mapping), "detector_id")
        .groupBy("ord", "part")
        .agg(F.array_sort(F.collect_list(F.struct("place", "new_detector_id"))).alias("d"))
        .select("ord", "part", F.col("d.new_detector_id").cast("array<int>").alias("new_detectors"))
    )
    nothing = F.array().cast("array<int>")
    rebuilt = parts.join(renamed, ["ord", "part"], "left").select(
        "ord", "prob", "part", "observables",
        F.coalesce("new_detectors", nothing).alias("detectors"),
    )
    empty = (F.size("detectors") == 0) & (F.size("observables") == 0)
    component = F.struct("part", "detectors", "observables")
    regrouped = (
        rebuilt.where(~empty)
        .groupBy("ord", "prob")
        .agg(F.array_sort(F.collect_list(component)).alias("cs"))
        # The first component must have survived.
        .where(F.get(F.col("cs.part"), F.lit(0)) == 0)
    )
    lone = F.exists(
        "cs", lambda c: (F.size(c["detectors"]) == 0) & (F.size(c["observables"]) > 0)
    )
    cleaned = regrouped.select(
        "ord",
        "prob",
        F.transform(
            "cs",
            lambda c: F.struct(
                c["detectors"].alias("detectors"), c["observables"].alias("observables")
            ),
        ).alias("components"),
        lone.alias("undetected"),
    )
    return cleaned, mapping


def hyperedges(mechanisms: DataFrame, min_size: int = 0) -> DataFrame:
    """Component sizes and XOR-ed sets of mechanisms with at least ``min_size`` detectors."""
    return mechanisms.select(
        "ord",
        "prob",
        F.size("components").alias("n_components"),
        F.transform("components.detectors", lambda d: F.size(d)).alias("component_sizes"),
        xor_of_components("components.detectors").alias("detectors"),
        xor_of_components("components.observables").alias("observables"),
    ).withColumn("n_detectors", F.size("detectors")).where(F.col("n_detectors") >= min_size)


def supports(obs_edges: DataFrame) -> DataFrame:
    """Number of error mechanisms touched by each observable."""
    edges = obs_edges.select("observable_id", "error_id").distinct()
    return edges.groupBy("observable_id").agg(F.count("*").alias("support_size"))


SIDE = 1000  # checks, or observables, of one mechanism that a task pairs together, about


def deal_pairs(
    checks: DataFrame, obs_edges: DataFrame, extra: Sequence[str] = (), side: int = SIDE
) -> tuple[DataFrame, DataFrame]:
    """Distinct edges of both kinds with the block columns ``__a`` and ``__b``.

    Edges of one mechanism meet where both columns are equal.  A mechanism of low degree has one block; one
    with more than ``side`` edges of a kind is cut by a hash into blocks of about ``side``, and every block
    of its checks meets every block of its observables once.  So a product of high degrees is
    spread over as many keys as it needs.
    """
    c = checks.select("detector_id", "error_id").distinct()
    o = obs_edges.select("observable_id", *extra, "error_id").distinct()

    def parts(edges: DataFrame, name: str) -> DataFrame:
        count = F.ceil(F.count("*") / F.lit(side)).cast("int")
        return edges.groupBy("error_id").agg(count.alias(name))

    both = parts(c, "__na").join(parts(o, "__nb").hint("merge"), "error_id")
    # At most one row per ``side`` edges of a kind; most models have none.
    heavy = both.where((F.col("__na") > 1) | (F.col("__nb") > 1))

    def dealt(edges: DataFrame, key: Column, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        rows = edges.join(heavy, "error_id", "left").fillna(1, ["__na", "__nb"])
        rows = rows.withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        return rows.drop("__na", "__nb")

    return (
        dealt(c, F.col("detector_id"), "__a", "__b", "__na", "__nb"),
        dealt(o, F.struct("observable_id", *extra), "__b", "__a", "__nb", "__na"),
    )


def _together(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, before they are counted.

    Counted where they arise, nearly every task would hold nearly every pair of keys; here a task holds its
    share of them.
    """
    return rows.repartition(*keys)


def overlaps(
    checks: DataFrame, obs_edges: DataFrame, extra: Sequence[str] = (), side: int = SIDE
) -> DataFrame:
    """Shared error mechanisms per observable and check (only pairs that share any)."""
    c, o = deal_pairs(checks, obs_edges, extra, side)
    keys = ["observable_id", *extra, "detector_id"]
    met = c.join(o.hint("merge"), ["error_id", "__a", "__b"]).select(*keys)
    return _together(met, *keys).groupBy(*keys).agg(F.count("*").alias("overlap"))


def _pairs(n: str) -> Column:
    # Integer halves: n * (n - 1) is even.
    return F.floor(F.col(n) * (F.col(n) - 1) / 2).cast("long")


def new_cycles(checks: DataFrame, obs_edges: DataFrame) -> DataFrame:
    """Length-4 cycles added by one constraint per observable: sum over checks of C(overlap, 2)."""
    found = (
        overlaps(checks, obs_edges)
        .groupBy("observable_id")
        .agg(F.sum(_pairs("overlap")).alias("cycles"))
    )
    return supports(obs_edges).join(found, "observable_id", "left").select(
        "observable_id", "support_size", F.coalesce("cycles", F.lit(0)).alias("cycles")
    )


def overlap_summary(checks: DataFrame, obs_edges: DataFrame) -> DataFrame:
    """Largest overlap, checks with at least two, cycles, and the histogram with zero overlaps."""
    n_checks = checks.agg(F.count_distinct("detector_id").alias("n_checks"))
    hist = overlaps(checks, obs_edges).groupBy("observable_id", "overlap").agg(
        F.count("*").alias("n")
    )
    stats = hist.groupBy("observable_id").agg(
        F.max("overlap").alias("max_overlap"),
        F.sum(F.when(F.col("overlap") >= 2, F.col("n")).otherwise(0)).alias("checks_ge_2"),
        F.sum(_pairs("overlap") * F.col("n")).alias("cycles"),
        F.sum("n").alias("touched"),
        F.array_sort(F.collect_list(F.struct("overlap", "n"))).alias("hist"),
    )
    joined = attach(supports(obs_edges).join(stats, "observable_id", "left"), n_checks, [])
    zero = F.col("n_checks") - F.coalesce("touched", F.lit(0))
    head = F.when(
        zero > 0, F.array(F.struct(F.lit(0).cast("long").alias("overlap"), zero.alias("n")))
    )
    empty = F.array().cast("array<struct<overlap:bigint,n:bigint>>")
    whole = F.concat(F.coalesce(head, empty), F.coalesce("hist", empty))
    return joined.select(
        "observable_id",
        "support_size",
        F.coalesce("max_overlap", F.lit(0)).alias("max_overlap"),
        F.coalesce("checks_ge_2", F.lit(0)).alias("checks_ge_2"),
        F.coalesce("cycles", F.lit(0)).alias("cycles"),
        whole.alias("distribution"),
    )


def split_hash(seed: str | Column, error_id: str | Column) -> Column:
    """52-bit hash of a seed and an id, the same in every engine that has md5."""
    text = F.concat_ws("-", F.col(seed) if isinstance(seed, str) else seed, F.col(error_id))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


FEW_ROWS = 10_000  # rows of a table that may be broadcast


def _sized(edges: DataFrame) -> DataFrame:
    """Edges with the support size of their observable.

    Few observables are broadcast, counted and not estimated; many are merged.
    """
    sizes = settle_table(supports(edges))
    few = len(sizes.select("observable_id").take(FEW_ROWS + 1)) <= FEW_ROWS
    return edges.join(sizes.hint("broadcast" if few else "merge"), "observable_id")


def _blocks(
    obs_edges: DataFrame, m: int, seeds: Sequence[int], balanced: bool, buckets: int | None
) -> DataFrame:
    """Observable edges with the array ``__blocks``: a block number per seed, in the order of the seeds.

    A support of one item is not split.
    """
    edges = obs_edges.select("observable_id", "error_id").distinct()
    sized = _sized(edges).withColumn(
        "m",
        F.when(F.col("support_size") < 2, F.lit(1)).otherwise(
            F.least(F.lit(max(int(m), 2)).cast("long"), F.col("support_size"))
        ),
    )
    hashes = F.array(*[split_hash(F.lit(str(int(s))), "error_id") for s in seeds])
    keys = ["observable_id", "error_id"]
    if not balanced:
        found = F.transform(hashes, lambda h: (h % F.col("m")).cast("int"))
        return cut_lineage(sized.select(*keys, found.alias("__blocks")))
    seeded = cut_lineage(sized.select("*", F.posexplode(hashes).alias("at", "h")))
    by = ["at", "observable_id"]
    place = cumulative(seeded, "h", by=by, buckets=buckets).select(*by, "h", F.col("n_before").alias("place"))
    size = F.floor(F.col("support_size") / F.col("m")).cast("long")
    extra = F.col("support_size") % F.col("m")
    head = extra * (size + 1)
    block = F.when(F.col("place") < head, F.floor(F.col("place") / (size + 1))).otherwise(
        extra + F.floor((F.col("place") - head) / size)
    )
    placed = seeded.join(place.hint("merge"), [*by, "h"]).select(
        *keys, F.struct("at", block.cast("int").alias("block")).alias("b")
    )
    packed = placed.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("b"))
    return cut_lineage(packed.select(*keys, F.col("b.block").alias("__blocks")))


def split_cycles(
    checks: DataFrame,
    obs_edges: DataFrame,
    m: int = 3,
    seeds: Sequence[int] = (0,),
    balanced: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """New cycles when each observable's support is split into blocks by a seeded hash.

    Random numbers of other engines cannot be reproduced; the split has the same distribution and
    is a pure function of seed and id.
    """
    seeds = list(dict.fromkeys(int(s) for s in seeds))
    blocks = _blocks(obs_edges, m, seeds, balanced, buckets)
    sizes = (
        blocks.select("observable_id", F.posexplode("__blocks").alias("at", "block"))
        .groupBy("observable_id", "at", "block")
        .agg(F.count("*").alias("n"))
        .groupBy("observable_id", "at")
        .agg(
            F.sum("n").alias("support_size"),
            F.count("*").alias("actual_splits"),
            F.array_sort(F.collect_list("n")).alias("block_sizes"),
        )
    )
    # Checks meet each observable edge once, with the blocks of all seeds; the seeds are spread after.
    c = checks.select("detector_id", "error_id").distinct()
    met = _together(
        c.join(blocks.hint("merge"), "error_id").select("observable_id", "detector_id", "__blocks"),
        "observable_id", "detector_id",
    )
    spread = met.select("observable_id", "detector_id", F.posexplode("__blocks").alias("at", "block"))
    overlap = spread.groupBy("observable_id", "detector_id", "at", "block").agg(
        F.count("*").alias("overlap")
    )
    found = overlap.groupBy("observable_id", "at").agg(F.sum(_pairs("overlap")).alias("cycles"))
    seed = F.element_at(F.array(*[F.lit(s) for s in seeds]), F.col("at") + 1)
    return sizes.join(found, ["observable_id", "at"], "left").select(
        "observable_id", seed.alias("seed"), "support_size", "actual_splits", "block_sizes",
        F.coalesce("cycles", F.lit(0)).alias("cycles"),
    )


def monte_carlo_cycles(
    checks: DataFrame,
    obs_edges: DataFrame,
    m: int = 3,
    samples: int = 100,
    seed: int = 0,
    balanced: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Mean, population deviation and extremes of the split cycle count over many seeds."""
    if samples < 1:
        raise ValueError("samples must be at least 1")
    runs = split_cycles(checks, obs_edges, m, range(seed, seed + samples), balanced, buckets)
    return runs.groupBy("observable_id").agg(
        F.count("*").alias("samples"),
        F.avg("cycles").alias("mean"),
        F.stddev_pop("cycles").alias("std"),
        F.min("cycles").alias("min"),
        F.max("cycles").alias("max"),
    )


def compare_split(
    checks: DataFrame, obs_edges: DataFrame, m: int = 3, seed: int = 0, balanced: bool = False
) -> DataFrame:
    """Unsplit and once-split cycle counts side by side."""
    one = split_cycles(checks, obs_edges, m, [seed], balanced)
    return new_cycles(checks, obs_edges).withColumnRenamed("cycles", "unsplit_cycles").join(
        one.select(
            "observable_id",
            F.col("cycles").alias("split_cycles"),
            F.lit(int(m)).alias("requested_splits"),
            "actual_splits",
            "block_sizes",
            F.col("seed").alias("split_seed"),
        ),
        "observable_id",
    )


def compare_monte_carlo(
    checks: DataFrame, obs_edges: DataFrame, m: int = 3, samples: int = 100, seed: int = 0,
    balanced: bool = False,
) -> DataFrame:
    """Unsplit counts, the same over ``m``, and the expectation over seeds."""
    mc = monte_carlo_cycles(checks, obs_edges, m, samples, seed, balanced)
    unsplit = new_cycles(checks, obs_edges).withColumnRenamed("cycles", "unsplit_cycles")
    return (
        unsplit.withColumn("unsplit_over_m", F.col("unsplit_cycles") / F.lit(float(m)))
        .join(mc, "observable_id")
        .withColumn("n_splits", F.lit(int(m)))
    )


def model_size(checks: DataFrame, obs_edges: DataFrame) -> DataFrame:
    """Numbers of checks, mechanisms and observables, as one row."""
    c = checks.agg(F.count_distinct("detector_id").alias("n_checks"))
    both = checks.select("error_id").union(obs_edges.select("error_id"))
    e = both.agg(F.count_distinct("error_id").alias("n_errors"))
    o = obs_edges.agg(F.count_distinct("observable_id").alias("n_observables"))
    return attach(attach(c, e, []), o, [])
