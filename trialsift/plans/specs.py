"""Declarative specs: which part of a lake, which score, which curve.

A spec is checked when it is made and turned into one lazy query by ``run``.  Several specs are one
union with their labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.functions.registry import FORCED_METRICS, check_gap_metric, direction_of
from trialsift.operators import bins, curves, pairs, ranking
from trialsift.sources import lake


@dataclass(frozen=True)
class PostSelectSpec:
    """One post-selection curve over a lake."""

    metric: str
    decoders: Sequence[str] | None = None
    circuit: Mapping[str, Any] = field(default_factory=dict)
    by: Sequence[str] = ()
    batches: Sequence[int] | None = None
    direction: str | None = None
    label: str | None = None
    digits: int | None = None
    mode: str = "continuous"
    scale: str = "linear"
    num_points: int = 50
    alpha: float = 0.05
    labels_from: str | None = None
    detail: bool | None = None
    random_split: bool | None = None
    n_splits: int | None = None
    split_seed: int | None = None
    separate_unconverged: bool = False
    exact_ranking: bool = False
    exact_decoders: Sequence[str] | None = None
    second_solution_threshold: float | None = None

    def __post_init__(self) -> None:
        staged = self.metric in FORCED_METRICS

        def need(condition: bool, message: str) -> None:
            if not condition:
                raise ValueError(message)

        need(self.mode in ("continuous", "unique"), "mode must be 'continuous' or 'unique'")
        split = self.random_split is not None or self.n_splits is not None
        need(staged or not split, "split options need a two-stage metric")
        need(self.n_splits is None or self.random_split is not None, "n_splits needs random_split")
        need(not self.random_split or self.n_splits is not None, "random_split=True needs n_splits")
        need(staged or not self.separate_unconverged, "separate_unconverged needs a two-stage metric")
        need(staged or not self.exact_ranking, "exact_ranking needs a two-stage metric")
        need(self.exact_decoders is None or self.exact_ranking, "exact_decoders needs exact_ranking")
        need(
            self.labels_from is None or self.metric == "forced_gap_ml",
            "labels_from needs forced_gap_ml",
        )
        if self.second_solution_threshold is not None:
            need(self.metric == "linearize_logicalgap", "second solutions need linearize_logicalgap")
            need(self.second_solution_threshold < 0, "second_solution_threshold must be negative")
            need(not self.separate_unconverged, "second solutions exclude separate_unconverged")
        direction_of(self.metric, self.direction)

    def directories(self) -> dict[str, Any]:
        """Directory filters of the split configuration."""
        if self.metric not in FORCED_METRICS:
            return {}
        return lake.split_filters(self.random_split, self.n_splits, self.split_seed, self.detail)

    def trials(self, spark: SparkSession, catalog: DataFrame) -> DataFrame:
        """Trials of the spec with every column its curve needs."""
        extra: dict[str, list[str]] = {}
        if self.separate_unconverged:
            extra["decoder_stat"] = ["baseline_iteration"]
        if self.second_solution_threshold is not None:
            extra["detailed_stats"] = ["forced_logical_error"]
        where = {"circuit": self.circuit, "batches": self.batches}
        df = lake.read_lake(
            spark, catalog, self.metric, extra=extra, decoders=self.decoders,
            labels_from=self.labels_from, **where, **self.directories(),
        )
        if self.exact_ranking:
            exact = lake.read_lake(
                spark, catalog, "logical_gap", decoders=self.exact_decoders, **where
            )
            df = pairs.rerank(df, exact, self.metric, "logical_gap")
        return df

    def run(self, spark: SparkSession, catalog: DataFrame) -> DataFrame:
        df, direction = self.trials(spark, catalog), direction_of(self.metric, self.direction)
        by, error = list(self.by), "is_logical_error"
        if direction == "boolean":
            curve = curves.postselect_sweep(df, self.metric, error, "b", by, self.alpha)
        elif self.separate_unconverged:
            curve = curves.postselect_separate(
                df, self.metric, error, "baseline_iteration", direction, self.mode, by,
                self.num_points, self.scale, self.alpha, self.digits,
            )
        else:
            if self.second_solution_threshold is not None:
                df = curves.with_second_solution(
                    df, self.metric, error, "forced_logical_error", self.second_solution_threshold
                )
            if self.mode == "unique":
                curve = curves.postselect_unique(
                    df, self.metric, error, direction, by, self.alpha, self.digits
                )
            else:
                curve = curves.postselect_quantiles(
                    df, self.metric, error, direction, by, self.num_points, self.scale, self.alpha,
                    self.digits,
                )
        return curve.withColumn("spec", F.lit(self.name()))

    def name(self) -> str:
        head = f"{self.label} " if self.label else ""
        tail = " (exact gap ranking)" if self.exact_ranking and not self.label else ""
        return f"{head}{self.metric}{tail}"


def run_specs(
    spark: SparkSession, catalog: DataFrame, specs: Sequence[PostSelectSpec]
) -> DataFrame:
    """Curves of several specs in one table."""
    out = None
    for spec in specs:
        curve = spec.run(spark, catalog)
        out = curve if out is None else out.unionByName(curve, allowMissingColumns=True)
    if out is None:
        raise ValueError("at least one spec is needed")
    return out


def split_specs(
    spec: PostSelectSpec, counts: Sequence[int], seeds: Sequence[int | None] = (None,)
) -> list[PostSelectSpec]:
    """The ordinary spec and one spec per split count and seed."""
    plain = replace(spec, random_split=None, n_splits=None, split_seed=None)
    varied = [
        replace(spec, random_split=True, n_splits=n, split_seed=s, label=f"n_splits={n}")
        for n in counts
        for s in seeds
    ]
    return [plain, *varied]


def relative_improvement(
    spark: SparkSession,
    catalog: DataFrame,
    base: PostSelectSpec,
    others: Sequence[PostSelectSpec],
    num_points: int = 200,
) -> DataFrame:
    """Relative improvement of each spec over the base spec."""
    reference = replace(base, num_points=num_points, by=()).run(spark, catalog)
    out = None
    for spec in others:
        curve = replace(spec, num_points=num_points).run(spark, catalog)
        part = curves.relative_improvement(reference, curve, spec.by)
        part = part.withColumn("spec", F.lit(spec.name()))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("at least one other spec is needed")
    return out


@dataclass(frozen=True)
class PairSpec:
    """Two metrics of the same trials."""

    x: str
    y: str
    circuit: Mapping[str, Any] = field(default_factory=dict)
    x_decoders: Sequence[str] | None = None
    y_decoders: Sequence[str] | None = None
    batches: Sequence[int] | None = None
    negative: bool = False
    allow_fanout: bool = False

    def trials(self, spark: SparkSession, catalog: DataFrame) -> DataFrame:
        """Joined trials; ``negative`` flips each axis by its own label where it is a gap."""
        where = {"circuit": self.circuit, "batches": self.batches}
        left = lake.read_lake(spark, catalog, self.x, decoders=self.x_decoders, **where)
        right = lake.read_lake(spark, catalog, self.y, decoders=self.y_decoders, **where)
        keys = pairs.shared_keys(left, right)
        error = "is_logical_error"
        df = pairs.join_scores(
            left, right.select(*keys, self.y, error), keys, error, self.allow_fanout
        )
        if self.negative:
            check_gap_metric(self.x, "negative")
            check_gap_metric(self.y, "negative")
            df = df.withColumns(
                {
                    self.x: bins.prepared_score(self.x, f"{error}_x", negative=True),
                    self.y: bins.prepared_score(self.y, f"{error}_y", negative=True),
                }
            )
        return df

    def heatmap(
        self, spark: SparkSession, catalog: DataFrame, shape: tuple[int, int] = (60, 60),
        error_source: str = "x", **ranges,
    ) -> DataFrame:
        """2-D histogram; the label of either metric may decide what an error is."""
        if error_source not in ("x", "y"):
            raise ValueError("error_source must be 'x' or 'y'")
        df = self.trials(spark, catalog)
        error = f"is_logical_error_{error_source}"
        return bins.histogram2d(df, self.x, self.y, error, shape, **ranges)


@dataclass(frozen=True)
class RankingSpec:
    """Exact and forced detail data of the same trials, with ranking scores."""

    circuit: Mapping[str, Any] = field(default_factory=dict)
    exact_decoders: Sequence[str] | None = None
    forced_decoders: Sequence[str] | None = None
    batches: Sequence[int] | None = None
    case: str = "same"
    digits: int | None = None
    tolerance: float = 1e-9
    penalty: float = 1.0

    def trials(self, spark: SparkSession, catalog: DataFrame) -> DataFrame:
        df = lake.read_detail_pair(
            spark, catalog, left_decoders=self.exact_decoders,
            right_decoders=self.forced_decoders, circuit=self.circuit, batches=self.batches,
        )
        df = pairs.with_pair_columns(df, tol=self.tolerance, digits=self.digits)
        return ranking.with_ranking_scores(pairs.stage1_case(df, self.case), self.penalty)
