"""Small tables with known answers; inputs and published results are fixed values."""

import math

import pytest
from pyspark.sql import functions as F

from trialsift.functions import exprs as E
from trialsift.functions import registry as G
from trialsift.operators import bins as B
from trialsift.operators import curves as C
from trialsift.operators import decide as D
from trialsift.operators import model as M
from trialsift.operators import pairs as P
from trialsift.operators import stats as S

INF = math.inf


def test_wilson_golden_numbers(spark):
    row = spark.range(1).select(
        E.wilson_low(F.lit(25060), F.lit(1_000_000)).alias("lo"),
        E.wilson_high(F.lit(25060), F.lit(1_000_000)).alias("hi"),
        E.wilson_low(F.lit(0), F.lit(0)).alias("none"),
    ).first()
    assert row.lo == pytest.approx(0.024755462780003134, rel=1e-13)
    assert row.hi == pytest.approx(0.02536818613088433, rel=1e-13)
    assert row.none is None


def test_conditional_block_golden_numbers(spark):
    """Counts of a published run: 1 000 000 trials, rebuilt as weighted groups."""
    groups = [
        # gap, first error, second error, trials
        (-1.0, True, True, 8000), (-1.0, True, False, 6775), (-1.0, False, True, 5396),
        (-1.0, False, False, 4889), (0.0, True, False, 61), (0.0, False, False, 1200),
        (1.0, True, False, 2972), (1.0, False, False, 970707),
    ]
    df = spark.createDataFrame(groups, "gap double, y0 boolean, y2 boolean, n int")
    df = df.select("*", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        F.lit(2.0).alias("w0"), (F.col("gap") + 2.0).alias("w2"), "y0", "y2"
    )
    r = P.conditional_block(df, "w0", "w2", "y0", "y2").first()
    assert (r.n_total, r.n_neg, r.n_zero, r.n_pos, r.n_excluded) == (10**6, 25060, 1261, 974940, 0)
    golden = {
        "q": (0.02506, 0.024755462780003134, 0.02536818613088433),
        "eps": (0.017808, 0.017550634934684006, 0.018069069692508162),
        "eps_minus": (0.589584996009577, 0.5834813649962236, 0.5956611661826847),
        "eps_plus": (0.003110960674503046, 0.0030023587542066695, 0.0032234782639935927),
        "concentration": (0.8296832884097035, 0.8240912272531423, 0.8351331447550187),
        "p_y2_given_neg": (0.5345570630486831, 0.5283765144982031, 0.5407270186870683),
    }
    for name, (value, low, high) in golden.items():
        assert r[name] == pytest.approx(value, rel=1e-12)
        assert r[f"{name}_ci_low"] == pytest.approx(low, rel=1e-12)
        assert r[f"{name}_ci_high"] == pytest.approx(high, rel=1e-12)
    assert r.consistency_ok


def test_zero_threshold_point(spark):
    schema = "score double, err boolean"
    a = spark.createDataFrame([(-1.0, False), (0.0, False), (1.0, True), (2.0, False)], schema)
    r = C.zero_point(a, "score", "err").first()
    assert (r.abort_rate, r.post_ler, r.shown_ler) == (0.5, 0.5, 0.5)
    b = spark.createDataFrame([(-1.0, True), (0.0, False), (1.0, False), (2.0, False)], schema)
    assert C.zero_point(b, "score", "err").first().shown_ler is None


def test_threshold_guards_nan(spark):
    df = spark.createDataFrame([(float("nan"), True), (1.0, False)], "score double, err boolean")
    r = C.postselect_at(df, "score", "err", 0.0).first()
    assert (r.accepted, r.errors, r.n_total) == (1, 0, 2)


def test_over_and_under_confidence(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, True), (1.0, 0.5, True), (2.0, 2.0, False), (2.0, 3.0, False)],
        "a double, b double, e boolean",
    )
    got = {r.subset: tuple(r)[1:] for r in P.over_under(df, "a", "b", "e").collect()}
    assert got == {
        "overall": (4, 0.5, 0.25, 0.25),
        "logical_error": (2, 0.5, 0.5, 0.0),
        "non_logical_error": (2, 0.5, 0.0, 0.5),
    }


@pytest.mark.parametrize(
    "lin, inclusive, exact, forced",
    [
        ([-1.0, -1.0, 1.0, 1.0], True, {0: 1.0, 1: 0.0}, {0: 1.0, 1: 0.5, 2: 0.0}),
        ([0.0, -1.0, 1.0, 0.0], False, {0: 0.5, 1: 0.0}, {0: 0.0, 1: 0.5, 2: 0.0}),
    ],
)
def test_override_probability(spark, lin, inclusive, exact, forced):
    rows = list(zip(lin, [0.0, 0.0, 1.0, 1.0], [0.0, 1.0, 1.0, 2.0]))
    df = spark.createDataFrame(rows, "lin double, ex double, fg double")
    got = B.override_probability(df, "lin", ["ex", "fg"], inclusive=inclusive).collect()
    assert {r.value: r.rate for r in got if r.gap == "ex"} == exact
    assert {r.value: r.rate for r in got if r.gap == "fg"} == forced


def test_distribution_by_error(spark):
    df = spark.createDataFrame([(1.0, False), (1.0, False), (2.0, True), (2.0, True)], "m double, e boolean")
    got = B.score_distribution(df, ["m"], "e", separate_error=True).collect()
    assert {(r.e, r.value): r["count"] for r in got} == {(False, 1.0): 2, (True, 2.0): 2}


def test_degenerate_and_clamped_bins(spark):
    one = spark.createDataFrame([(3.0, True)] * 4, "x double, s boolean")
    got = B.bin_rate(one, "x", "s", 3).orderBy("bin").collect()
    assert [r.total for r in got] == [0, 0, 4]
    df = spark.createDataFrame([(-5.0, True), (0.5, True), (9.0, False)], "x double, s boolean")
    got = B.bin_rate(df, "x", "s", 2, x_range=(0.0, 2.0)).orderBy("bin").collect()
    assert [(r["count"], r.total) for r in got] == [(2, 2), (0, 1)]
    cells = B.histogram2d(df.withColumn("y", F.lit(1.0)), "x", "y", "s", (2, 2), x_range=(0.0, 2.0))
    assert [r.n for r in cells.collect()] == [1]


def test_descriptive_statistics_use_nearest_values(spark):
    df = spark.createDataFrame(
        [(0, False, 1.0, 1.5, 2, 4), (1, True, 2.0, 3.0, 5, 6), (2, False, 1.0, 1.5, 2, 4)],
        "shot_id long, logicalerror boolean, baseline_weight double, forced_weight double, "
        "baseline_iteration long, forced_iteration long",
    )
    got = {r["column"]: r for r in S.describe(df).collect()}
    assert list(G.stage_values(df.columns)) == [
        "baseline_weight", "forced_weight", "baseline_iteration", "forced_iteration"]
    assert got["baseline_iteration"].q50 == 2.0 and got["baseline_iteration"]["mean"] == 3.0
    assert got["forced_weight"]["max"] == 3.0 and got["forced_weight"]["count"] == 3


# ---- decisions ------------------------------------------------------------------------------------

CAND = "shot_id long, stage int, obs_idx int, weight double, logical array<boolean>, converged boolean, stat double"


def cands(spark, *rows):
    return spark.createDataFrame(
        [(0, s, i, w, [bool(b) for b in c], ok, None) for s, i, w, c, ok in rows], CAND
    )


def test_anchored_and_reselecting_gap(spark):
    a = cands(spark, (0, 0, 1.0, [1, 0], True), (1, 0, 0.0, [0, 0], True), (1, 1, 3.0, [1, 1], True))
    truth = spark.createDataFrame([(0, [False, False])], "shot_id long, truth array<boolean>")
    r = D.anchored_gap(a).first()
    assert (r.gap, r.logical, r.flips) == (-1.0, [True, False], [0])
    s = D.candidate_summary(a, truth).first()
    assert (s.stage1_obs_flip, s.stage2_obs_flip, s.stage2_weight) == (True, False, 0.0)
    b = cands(spark, (0, 0, 0.0, [0, 0], True), (1, 0, 1.0, [1, 0], True), (1, 1, 2.0, [0, 1], True))
    assert D.reselect_gap(b).first().gap == 1.0
    assert D.candidate_summary(b, truth).first().stage2_2ndbest_weight == 2.0


def test_unconverged_baseline(spark):
    a = cands(spark, (0, 0, 1.0, [0], False), (1, 0, 2.0, [1], True))
    r, s = D.anchored_gap(a, unconverged="positive").first(), D.reselect_gap(a, unconverged="positive").first()
    assert (r.gap, r.forced_error, r.flips) == (-INF, True, [])
    assert (s.gap, s.forced_error, s.flips) == (0.0, True, [])


@pytest.mark.parametrize("option, anchored, reselect", [("positive", INF, INF), ("negative", -INF, 0.0), (None, -INF, 0.0)])
def test_no_converged_alternative(spark, option, anchored, reselect):
    a = cands(spark, (0, 0, 1.0, [0], True), (1, 0, 2.0, [1], False))
    r, s = D.anchored_gap(a, unconverged=option).first(), D.reselect_gap(a, unconverged=option).first()
    assert (r.gap, r.forced_error) == (anchored, False)
    assert (s.gap, s.forced_error) == (reselect, False)


def test_no_rival_class(spark):
    a = cands(spark, (0, 0, 1.0, [0], True), (1, 0, 2.0, [0], True))
    assert math.isnan(D.reselect_gap(a).first().gap)
    assert D.fixed_gap(a).first().gap == INF


def test_fixed_convention(spark):
    g = 2 * math.log(9)
    r = D.fixed_gap(cands(spark, (0, 0, 0.0, [0], True), (1, 0, g, [1], True))).first()
    assert (r.gap, r.logical, r.flips) == (g, [False], [])


def test_reweighted_gap(spark):
    g = 2 * math.log(9)
    r = D.reweighted_gap(
        cands(spark, (0, 0, 0.0, [0], True), (1, 0, 5.0, [1], False), (2, 0, g, [1], True))
    ).first()
    assert (r.gap, r.flips) == (g, [0])
    r = D.reweighted_gap(
        cands(spark, (0, 0, 1.0, [0], True), (1, 0, 5.0, [1], False), (2, 0, 0.5, [0], True)),
        unconverged="negative",
    ).first()
    assert (r.gap, r.flips) == (-INF, [])
    r = D.reweighted_gap(
        cands(spark, (0, 0, 1.0, [0], True), (1, 0, 5.0, [1], True), (2, 0, 0.5, [0], True))
    ).first()
    assert r.gap == 4.5


@pytest.mark.parametrize(
    "rounds, criterion, accepted",
    [
        ([([], [0], True), ([1], [1], True)], "PEC", True),
        ([([2, 1], [0], True), ([1, 2], [0], True)], "PEC", True),
        ([([1], [0], True), ([2], [0], True)], "PEC", False),
        ([([1], [0], True), ([2], [0], True)], "LEC", True),
        ([([1], [0], True), ([2], [1], True)], "LEC", False),
        ([([1], [0], False), ([1], [0], True)], "PEC", False),
    ],
)
def test_agreement(spark, rounds, criterion, accepted):
    df = spark.createDataFrame(
        [(0, i, c, [bool(b) for b in l], ok) for i, (c, l, ok) in enumerate(rounds)],
        "shot_id long, round int, correction array<int>, logical array<boolean>, converged boolean",
    )
    r = D.agreement_accept(df, criterion).first()
    assert r.accept == accepted and r.forced_error == (not rounds[0][2])


def test_reweight_rejects_certain_items(spark):
    df = spark.createDataFrame([(0, 1, 1.0)], "shot_id long, error_id int, prior double")
    with pytest.raises(Exception, match="zero"):
        D.reweight_priors(df, 1.0, "Gap").collect()


def test_consistency_violation_is_raised(spark):
    df = spark.createDataFrame(
        [(True, True, [True], [False])],
        "baseline_converged boolean, forced_converged boolean, baseline_logical array<boolean>, "
        "forced_logical array<boolean>",
    )
    with pytest.raises(Exception, match="differs"):
        D.check_consistency(df).collect()
    assert D.check_consistency(df, strict=False).first().violation


# ---- model ----------------------------------------------------------------------------------------


def edge_rows(spark, matrix, column):
    rows = [(r, c) for r, line in enumerate(matrix) for c, bit in enumerate(line) if bit]
    return spark.createDataFrame(rows, f"{column} int, error_id int")


def test_cycles(spark):
    checks = edge_rows(spark, [[1, 1, 0, 0], [1, 0, 1, 1], [0, 0, 1, 0]], "detector_id")
    obs = edge_rows(spark, [[1, 1, 1, 0]], "observable_id")
    r = M.new_cycles(checks, obs).first()
    assert (r.support_size, r.cycles) == (3, 2)
    full = edge_rows(spark, [[1, 1, 1, 1]], "detector_id"), edge_rows(spark, [[1, 1, 1, 1]], "observable_id")
    assert M.new_cycles(*full).first().cycles == 6
    for seed in range(5):
        r = M.split_cycles(*full, 2, [seed], balanced=True).first()
        assert (r.block_sizes, r.cycles) == ([2, 2], 2)
    with pytest.raises(ValueError):
        M.monte_carlo_cycles(*full, samples=0)


MECH = "ord long, prob double, components array<struct<detectors:array<int>,observables:array<int>>>"


def test_merge_mechanisms(spark):
    df = spark.createDataFrame(
        [
            (0, 0.1, [([3, 1], [0])]),
            (1, 0.2, [([1, 2], []), ([2, 3], [1])]),
            (2, 0.3, [([5], [])]),
        ],
        MECH,
    )
    a, b = M.merge_mechanisms(df).orderBy("error_id").collect()
    assert (a.detectors, a.observables) == ([1, 3], [1])
    assert a.prior == pytest.approx(0.1 * 0.8 + 0.2 * 0.9)
    assert (b.error_id, b.detectors) == (1, [5])
    assert M.merge_edges(df).count() == 4
    hyper = spark.createDataFrame([(0, 0.1, [([1, 2, 3], [])])], MECH)
    assert M.merge_edges(hyper).count() == 0
    with pytest.raises(Exception, match="more than two"):
        M.merge_edges(hyper, allow_hyperedges=False).collect()


def test_drop_basis(spark):
    coords = spark.createDataFrame(
        [(i, [0.0, 0.0, 0.0, float(c)]) for i, c in enumerate([0, 3, 1, 4])] + [(4, [0.0])],
        "detector_id int, coords array<double>",
    )
    df = spark.createDataFrame(
        [
            (0, 0.1, [([0, 1], [0]), ([2], []), ([3], [])]),
            (1, 0.1, [([0, 2], []), ([1], [])]),
            (2, 0.1, [([2], [1])]),
            (3, 0.1, [([4, 3], [])]),
        ],
        MECH,
    )
    out, mapping = M.drop_basis(df, coords, "X")
    got = {r.ord: (r.components, r.undetected) for r in out.collect()}
    assert set(got) == {0, 2, 3}
    assert [(c.detectors, c.observables) for c in got[0][0]] == [([0], [0]), ([1], [])]
    assert got[2][1] and not got[0][1]
    assert [c.detectors for c in got[3][0]] == [[2, 1]]
    assert {r.detector_id: r.new_detector_id for r in mapping.collect()} == {1: 0, 3: 1, 4: 2}


def test_option_checks():
    assert G.metric_options("ar-pec", {"b": 2, "test_type": "ratio", "num_decoding_rounds": 2})["test_type"] == "Ratio"
    for bad in ({"b": 1, "test_type": "Ratio", "num_decoding_rounds": 2}, {"b": 2}, {"x": 1}):
        with pytest.raises(ValueError):
            G.metric_options("ar-pec", bad)
    assert G.metric_options("forced_gap_ml", {"alpha": "inf"})["cluster_llr_alpha"] == INF
    with pytest.raises(ValueError):
        G.check_rates([1.0])
    with pytest.raises(ValueError):
        G.direction_of("unknown")
    assert G.bin_count(True) is None and G.bin_count(4.0) == 4
    with pytest.raises(ValueError):
        G.whole_number(0, "per_round", 1)


def test_solver_without_convergence(spark):
    lone = cands(spark, (0, 0, 1.0, [0], True))
    assert math.isnan(D.anchored_gap(lone, convergence_aware=False).first().gap)
    assert math.isnan(D.reweighted_gap(lone, convergence_aware=False).first().gap)
    assert math.isnan(D.reselect_gap(lone, convergence_aware=False).first().gap)


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "s double, e boolean, a boolean, g int")
    assert C.error_rate(df, "e").first().ler == 0.0
    assert B.accept_rate(df, "a").first().rate == 0.0
    assert C.postselect_unique(df, "s", "e").count() == 0
    assert C.postselect_quantiles(df, "s", "e", buckets=8).count() == 0
    assert C.postselect_at(df, "s", "e", 0.0).first().abort_rate is None
    assert B.bin_rate(df, "s", "e", 5).count() == 0
    assert C.postselect_ranked(df.withColumn("i", F.lit(1)), {"s": "e"}, [0.0, 0.5], ["i"]).where(
        "n_accepted > 0").count() == 0


def test_one_mechanism_in_very_many_checks(spark):
    n, m = 100_000, 40
    checks = spark.range(n).select(F.col("id").alias("detector_id"), F.lit(1).alias("error_id"))
    checks = checks.unionByName(spark.range(50).select(F.col("id").alias("detector_id"), F.lit(2).alias("error_id")))
    obs = spark.range(m).select(F.col("id").alias("observable_id"), F.lit(1).alias("error_id"))
    obs = obs.unionByName(spark.range(3).select(F.col("id").alias("observable_id"), F.lit(2).alias("error_id")))
    c, o = M.deal_pairs(checks, obs, side=500)
    blocks = {tuple(r)[:2]: r["count"] for r in c.where("error_id = 1").groupBy("__a", "__b").count().collect()}
    # The checks are spread evenly, and each of them meets every observable once.
    assert len(blocks) == 200 and max(blocks.values()) < 2 * 500 and sum(blocks.values()) == n
    assert o.where("error_id = 1").groupBy("observable_id").count().where("count != 200").count() == 0
    shares = M.overlaps(checks, obs, side=500).groupBy("overlap").count().collect()
    assert {r["overlap"]: r["count"] for r in shares} == {1: n * m - 150, 2: 150}
    small = M.overlaps(checks.where("detector_id < 200"), obs, side=7)
    assert small.where("overlap = 2").count() == 150 and small.count() == 200 * m
    assert M.new_cycles(checks, obs).agg(F.sum("cycles")).first()[0] == 150


def test_curve_read_off_and_improvement(spark):
    rows = [(float(i), i < 3) for i in range(10)]
    df = spark.createDataFrame(rows, "s double, e boolean")
    curve = C.postselect_unique(df, "s", "e", "high")
    got = {r.target: (r.abort_rate, r.errors) for r in C.read_at(curve, [0.0, 0.25, 0.9]).collect()}
    # 0.25 lies between 0.2 and 0.3; the lower rate wins the tie.
    assert got[0.0] == (0.0, 3) and got[0.25][1] == 1 and got[0.9] == (pytest.approx(0.9), 0)
    same = C.relative_improvement(curve, curve).collect()
    assert same and all(abs(r.log_eta) < 1e-12 for r in same)


def test_logit_line(spark):
    df = spark.createDataFrame(
        [(g, 1.0 / (1.0 + math.exp(2.0 * g - 1.0))) for g in (-1.0, 0.0, 0.5, 2.0)], "bin_center double, rate double"
    ).withColumns({"ci_low": F.col("rate") / 2, "ci_high": (F.col("rate") + 1) / 2})
    fit = B.logit_fit(df).first()
    assert fit.slope == pytest.approx(2.0) and fit.intercept == pytest.approx(-1.0)
    assert (fit.g_low, fit.g_high) == (-1.0, 3.0)
    assert B.fit_line(B.logit_fit(df), 5).count() == 5


def test_join_guards(spark):
    left = spark.createDataFrame([(1, 1, 0.5, True), (1, 1, 0.7, True)], "shot_id int, batch int, a double, is_logical_error boolean")
    right = spark.createDataFrame([(1, 1, 0.1, False)], "shot_id int, batch int, b double, is_logical_error boolean")
    with pytest.raises(Exception, match="repeat"):
        P.join_scores(left, right).collect()
    assert P.join_scores(left, right, allow_fanout=True).count() == 2
    assert P.rerank(left, right.where("false"), "a", "b").count() == 0
