"""Distributed ordering against brute force, with ties, hot values, NaN and infinities."""

import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialsift.operators import curves as C
from trialsift.operators import dominance
from trialsift.operators import stats as S
from trialsift.plans import ranges as R


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 4000
    score = rng.normal(size=n).round(2)
    score[rng.random(n) < 0.4] = 0.25  # one value holds two fifths of the rows
    score[:20] = np.inf
    score[20:35] = -np.inf
    score[35:60] = np.nan
    pdf = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "batch": rng.integers(0, 3, n),
            "score": score,
            "err": rng.random(n) < 0.2,
            "g": rng.integers(0, 3, n),
        }
    )
    df = spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), list(pdf.columns))
    return df.repartition(7), pdf


@pytest.mark.parametrize("buckets", [1, 32])
@pytest.mark.parametrize("descending", [True, False])
def test_cumulative(frame, buckets, descending):
    df, pdf = frame
    got = R.cumulative(
        df, "score", {"e": F.col("err").cast("long")}, ["g"], descending=descending,
        buckets=buckets, nan_last=True,
    ).toPandas()
    for g, part in pdf.groupby("g"):
        rows = got[got.g == g]
        assert rows.n.sum() == len(part) and (rows.n_total == len(part)).all()
        for row in rows.itertuples():
            if row.score is None or math.isnan(row.score):
                before = part[~part.score.isna()]
            elif descending:
                before = part[part.score > row.score]
            else:
                before = part[part.score < row.score]
            assert (row.n_before, row.e_before) == (len(before), before.err.sum())


@pytest.mark.parametrize("buckets", [1, 32])
def test_order_statistics_match_numpy(frame, buckets):
    df, pdf = frame
    finite = pdf[np.isfinite(pdf.score)]
    qs = [0.0, 0.1, 0.333, 0.5, 0.77, 1.0]
    got = R.order_statistics(
        df.where("abs(score) < double('Infinity') and not isnan(score)"), "score", qs,
        buckets=buckets,
    ).toPandas().sort_values("slot")
    want = np.quantile(finite.score.to_numpy(), qs)
    assert np.allclose(got.value, want, rtol=0, atol=1e-15)
    for value, below, upto in zip(got.value, got.n_below, got.n_upto):
        assert below == (finite.score < value).sum() and upto == (finite.score <= value).sum()


def brute_rank(pdf):
    clean = np.where(np.isfinite(pdf.score), pdf.score, -np.inf)
    order = np.lexsort((pdf.id, pdf.batch, -clean))
    rank = np.empty(len(pdf), dtype=int)
    rank[order] = np.arange(1, len(pdf) + 1)
    return rank


@pytest.mark.parametrize("buckets", [1, 64])
def test_accept_rank_and_cutoffs(frame, buckets):
    df, pdf = frame
    want = pdf.assign(want=brute_rank(pdf))[["id", "want"]]
    got = R.accept_rank(df, "score", ["batch", "id"], buckets=buckets).select("id", "rank").toPandas()
    assert (got.merge(want, on="id").eval("rank == want")).all()
    cut, flat = R.rank_cutoffs(df, ["score", "g"], ["batch", "id"], [1, 17, 2000, 4000], buckets=buckets)
    by_group = pdf.sort_values(["g", "batch", "id"], ascending=[False, True, True]).id.to_numpy()
    assert {k: v[-1] for k, v in flat.items()} == {k: by_group[k - 1] for k in (1, 17, 2000, 4000)}
    ids = {k: v[-1] for k, v in cut.items()}
    assert ids == {k: want[want.want == k].id.item() for k in (1, 17, 2000, 4000)}


@pytest.mark.parametrize("buckets", [1, 64])
def test_ranked_curve(frame, buckets):
    df, pdf = frame
    rates = [0.0, 0.1, 0.5, 0.61, 0.9, 0.9999]
    got = C.postselect_ranked(df, {"score": "err"}, rates, ["batch", "id"], buckets=buckets)
    rank = brute_rank(pdf)
    for row in got.collect():
        kept = int(round((1 - row.abort_rate) * len(pdf)))
        assert row.n_accepted == kept
        assert row.n_error == pdf.err[rank <= kept].sum()


@pytest.mark.parametrize("direction", ["high", "low"])
@pytest.mark.parametrize("buckets", [1, 32])
def test_quantile_curve_keeps_nan_in_denominator(frame, direction, buckets):
    df, pdf = frame
    df = df.where("isnan(score) or abs(score) < double('Infinity')")
    pdf = pdf[~np.isinf(pdf.score)]
    got = C.postselect_quantiles(df, "score", "err", direction, num_points=10, buckets=buckets)
    known = pdf[~pdf.score.isna()]
    for row in got.collect():
        q = row.target if direction == "high" else 1 - row.target
        t = np.quantile(known.score, q)
        mask = known.score >= t if direction == "high" else known.score <= t
        assert (row.accepted, row.errors) == (mask.sum(), known.err[mask].sum())
        assert row.abort_rate == 1.0 - mask.sum() / len(pdf)


def test_infinite_scores_are_ordinary_thresholds(frame):
    df, pdf = frame
    got = {r.threshold: r.accepted for r in C.postselect_unique(df, "score", "err", "high", buckets=32).collect()}
    assert got[math.inf] == 20
    assert got[-math.inf] == (~pdf.score.isna()).sum()


def brute_excess(x, y):
    return int(sum(np.sign(x[i] - x) @ np.sign(y[i] - y) for i in range(len(x))) // 2)


@pytest.mark.parametrize("max_rows", [10**6, 100])
def test_kendall_excess(frame, max_rows):
    df, pdf = frame
    sub = pdf[np.isfinite(pdf.score)].head(1500)
    small = df.sparkSession.createDataFrame(
        [(float(a), float(b)) for a, b in zip(sub.score, sub.id % 40)], "x double, y double"
    )
    row = S.kendall(small, "x", "y", max_rows=max_rows).first()
    assert row.excess == brute_excess(sub.score.to_numpy(), (sub.id % 40).to_numpy())
    assert row.n == len(sub)


@pytest.mark.parametrize("strips,max_rows", [(4, 40), (8, 150), (128, 50)])
def test_excess_in_recursive_strips(spark, strips, max_rows):
    rng = np.random.default_rng(strips)
    n = 1500
    x = rng.normal(size=n).round(2)
    x[rng.random(n) < 0.4] = 0.25  # one value of x and one of y hold far more points than a task may
    y = (x + rng.normal(size=n)).round(1)
    y[rng.random(n) < 0.3] = -1.0
    w = rng.integers(1, 4, n)
    points = spark.createDataFrame(
        [(float(a), float(b), int(c)) for a, b, c in zip(x, y, w)], "x double, y double, w long"
    )
    want = sum(
        int(w[i]) * int((w * np.sign(x[i] - x) * np.sign(y[i] - y)).sum()) for i in range(n)
    ) // 2
    assert dominance.excess(points, max_rows, strips).first().excess == want
    assert dominance.count_excess(x, y, w) == want


def test_excess_of_degenerate_points(spark):
    schema = "x double, y double, w long"
    for rows, want in (
        ([], 0),
        ([(1.0, 2.0, 3)], 0),
        ([(1.0, float(i), 1) for i in range(300)], 0),
        ([(float(i), float(-i), 2) for i in range(300)], -4 * 300 * 299 // 2),
        ([(float(i % 2), float(i // 2), 1) for i in range(300)], 0),
    ):
        assert dominance.excess(spark.createDataFrame(rows, schema), 20, 4).first().excess == want


def test_published_correlation_examples(spark):
    a = spark.createDataFrame(
        list(zip([12.0, 2.0, 1.0, 12.0, 2.0], [1.0, 4.0, 7.0, 1.0, 0.0])), "x double, y double"
    )
    row = S.rank_correlations(a, [("x", "y")]).first()
    assert row.kendall_tau == pytest.approx(-0.47140452079103173)
    assert row.kendall_p == pytest.approx(0.2827454599327748)
    b = spark.createDataFrame(
        list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [5.0, 6.0, 7.0, 8.0, 7.0])), "x double, y double"
    )
    row = S.rank_correlations(b, [("x", "y")]).first()
    assert row.spearman_r == pytest.approx(0.8207826816681233)
    assert row.spearman_p == pytest.approx(0.08858700531354381)


@pytest.mark.parametrize("buckets", [1, 16])
def test_spearman_with_ties(frame, buckets):
    df, pdf = frame
    ok = pdf[np.isfinite(pdf.score)]
    want = np.corrcoef(ok.score.rank(), (ok.id % 50).rank())[0, 1]
    rows = S.spearman_matrix(
        df.withColumn("other", (F.col("id") % 50).cast("double")), ["score", "other"],
        negate=["other"], buckets=buckets,
    ).collect()
    got = {(r.left, r.right): r.rho for r in rows}
    assert got["score", "-other"] == pytest.approx(-want)
    assert got["score", "score"] == 1.0


@pytest.mark.parametrize("buckets", [1, 32])
def test_null_groups_are_kept(frame, buckets):
    df, pdf = frame
    holed = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    got = C.postselect_unique(holed, "score", "err", "low", ["g"], buckets=buckets)
    totals = {r.g: r.n for r in got.groupBy("g").agg(F.max("n_total").alias("n")).collect()}
    sizes = pdf.g.value_counts().to_dict()
    assert totals == {None: sizes[0], 1: sizes[1], 2: sizes[2]}
    from trialsift.operators import bins as B

    rates = B.bin_rate(holed.where("abs(score) < 5"), "score", "err", 4, ["g"])
    assert rates.select("g").distinct().count() == 3


@pytest.mark.parametrize("buckets", [1, 32])
def test_neighbours(frame, buckets):
    df, pdf = frame
    got = R.neighbours(df.where("abs(score) < 5"), "score", ["g"], buckets=buckets).collect()
    for g, part in pdf[np.abs(pdf.score) < 5].groupby("g"):
        values = np.unique(part.score)
        rows = sorted((r.score, r.previous, r.next) for r in got if r.g == g)
        assert [r[0] for r in rows] == list(values)
        assert [r[1] for r in rows][1:] == list(values[:-1]) and rows[0][1] is None
        assert [r[2] for r in rows][:-1] == list(values[1:]) and rows[-1][2] is None


def test_plans_stay_distributed(frame):
    """Large inputs: no window without a partition over rows, and filters reach the scan."""
    df, _ = frame
    plan = R.cumulative(df, "score", by=["g"], buckets=32)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


def test_ranks_with_a_text_before_other_keys(spark):
    rows = [(1.0, ("low", "lowest1", "lowest2", "top")[i % 4], None if i % 9 == 0 else Decimal(4000 - i) / 100, i) for i in range(4000)]
    rows += [(1.0, None, Decimal(0), 4000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "score double, word string, price decimal(12,2), id long").repartition(4)
    want = [r[3] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2] is None, r[2] or 0, r[3]))]
    order = ["word", "price", "id"]
    got = R.accept_rank(df, "score", order, buckets=32).orderBy("rank").collect()
    assert [r.id for r in got] == want and [r["rank"] for r in got] == list(range(1, 4501))
    cut = R.rank_cutoffs(df, ["score"], order, [1, 700, 1500, 4200], buckets=32)[0]
    assert {rank: key[4] for rank, key in cut.items()} == {r: want[r - 1] for r in (1, 700, 1500, 4200)}


def test_ranks_with_null_prices_and_odd_numbers(spark):
    rows = [(1.0, None if i % 4 == 0 else Decimal(4000 - i) / 100, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "score double, price decimal(12,2), id long").repartition(4)
    got = R.accept_rank(df, "score", ["price", "id"], buckets=32).orderBy("rank").collect()
    assert [r.id for r in got] == [r[2] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2]))]
    odd = [math.inf, math.nan, None, -math.inf, 0.5]
    rows = [(1.0, odd[i % 5] if i % 2 else float(i % 100), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "score double, x double, id long").repartition(4)
    got = R.accept_rank(df, "score", ["x", "id"], buckets=32).orderBy("rank").collect()
    key = lambda x: (3, 0) if x is None else (2, 0) if math.isnan(x) else (1, x)
    assert [r.id for r in got] == [r[2] for r in sorted(rows, key=lambda r: (key(r[1]), r[2]))]


def test_ranks_with_numbers_that_doubles_do_not_tell_apart(spark):
    rows = [(1.0, 2**60 + i % 3, 3000 - i) for i in range(3000)]
    df = spark.createDataFrame(rows, "score double, big long, id long").repartition(4)
    got = R.accept_rank(df, "score", ["big", "id"], buckets=32).orderBy("rank").collect()
    assert [r.id for r in got] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
