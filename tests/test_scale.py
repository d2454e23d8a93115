"""Plans that must not grow with the input in the driver or in one task, and their results."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from showcase import stats
from trialsift.operators import dominance
from trialsift.operators import model as M


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    """Edges in small files, as a large but well compressed model has."""
    rng = random.Random(5)
    checks = sorted({(rng.randrange(7), rng.randrange(40)) for _ in range(150)})
    obs = [(e % 3, e) for e in range(40)] + [(9, 3)]
    folder = tmp_path_factory.mktemp("model")
    spark.createDataFrame(checks, "detector_id long, error_id long").write.parquet(f"{folder}/c")
    spark.createDataFrame(obs, "observable_id int, error_id long").write.parquet(f"{folder}/o")
    return checks, obs, spark.read.parquet(f"{folder}/c"), spark.read.parquet(f"{folder}/o")


def _expected(checks, obs, m, seeds, balanced):
    out = {}
    for seed in seeds:
        for o in {o for o, _ in obs}:
            support = [e for p, e in obs if p == o]
            h = {e: int(hashlib.md5(f"{seed}-{e}".encode()).hexdigest()[:13], 16) for e in support}
            k = 1 if len(support) < 2 else min(max(m, 2), len(support))
            if balanced:
                cuts = np.array_split(sorted(support, key=h.get), k)
                block = {int(e): i for i, cut in enumerate(cuts) for e in cut}
            else:
                block = {e: h[e] % k for e in support}
            met = Counter((d, block[e]) for d, e in checks if e in block)
            out[o, seed] = (
                len(support), sorted(Counter(block.values()).values()), sum(n * (n - 1) // 2 for n in met.values())
            )
    return out


@pytest.mark.parametrize("balanced", [False, True])
@pytest.mark.parametrize("few", [10_000, 0])
def test_split_cycles_equal_brute_force(model, monkeypatch, balanced, few):
    monkeypatch.setattr(M, "FEW_ROWS", few, raising=False)
    checks, obs, c, o = model
    rows = M.split_cycles(c, o, 3, [4, 0, 11], balanced).collect()
    got = {(r.observable_id, r.seed): (r.support_size, list(r.block_sizes), r.cycles) for r in rows}
    assert got == _expected(checks, obs, 3, [4, 0, 11], balanced)
    assert all(r.actual_splits == len(r.block_sizes) for r in rows)


@pytest.mark.parametrize("balanced", [False, True])
def test_edges_of_a_model_are_not_broadcast(model, balanced):
    """the driver held every edge of the observables, because their file is small."""
    *_, c, o = model
    for df in (M.split_cycles(c, o, 3, range(2), balanced), M.overlaps(c, o)):
        joins = [line for line in _plan(df).splitlines() if "Join [error_id" in line and "Inner" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_overlaps_are_counted_where_their_keys_meet(model):
    """a task that counts its own share of the edges holds nearly every pair of keys."""
    *_, c, o = model
    for df in (M.split_cycles(c, o, 3, range(2)), M.overlaps(c, o)):
        lines = _plan(df).splitlines()
        counted = [i for i, line in enumerate(lines) if "partial_count(1)" in line and "detector_id" in line]
        assert counted
        for i in counted:
            below = next(line for line in lines[i + 1 :] if "Exchange" in line or "Join" in line)
            assert "Exchange hashpartitioning" in below and "REPARTITION_BY_COL" in below


def _signs(x, y, w, g):
    sign = np.sign(x[:, None] - x) * np.sign(y[:, None] - y) * (g[:, None] == g)
    return int((sign * w[:, None] * w).sum()) // 2


@pytest.mark.parametrize("size,together", [(7, 20), (1000, 20), (1, 1), (13, 10_000)])
def test_many_groups_are_counted_in_one_pass(monkeypatch, size, together):
    """every group was a call of its own, and a large input has hundreds of thousands."""
    pa = pytest.importorskip("pyarrow")
    rng = np.random.default_rng(3)
    g = np.sort(rng.choice([0, 5, 6, 7, 1024, 2**40], 300, p=[0.1, 0.02, 0.6, 0.08, 0.1, 0.1]))
    x, y, w = rng.integers(0, 9, 300) * 1.0, rng.normal(size=300).round(1), rng.integers(1, 4, 300)
    monkeypatch.setattr(dominance, "_TOGETHER", together, raising=False)
    batches = [
        pa.RecordBatch.from_pydict({"x": x[i : i + size], "y": y[i : i + size], "w": w[i : i + size], "g": g[i : i + size]})
        for i in range(0, 300, size)
    ]
    found = [int(b.column(0)[0].as_py()) for b in dominance._count_sorted(iter(batches))]
    assert sum(found) == _signs(x, y, w, g) == dominance.count_excess(x, y, w, g)


def test_small_groups_are_cut_into_few_strips(spark, monkeypatch):
    """70 points above a limit of 60 were cut into 128 strips a side, a grid of more cells than points."""
    grids = []
    real = dominance._grid
    monkeypatch.setattr(dominance, "_grid", lambda cells: grids.append(cells) or real(cells))
    rng = np.random.default_rng(4)
    x, y, w = rng.permutation(70) * 1.0, rng.permutation(70) * 1.0, rng.integers(1, 4, 70)
    points = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, w)], "x double, y double, w long")
    assert int(dominance.excess(points, 60).first()[0]) == _signs(x, y, w, np.zeros(70))
    assert grids and all(c.agg(F.max("sx")).first()[0] < 2 * dominance._FEWEST for c in grids)


def test_tie_sums_beyond_a_bigint_are_whole(spark):
    """at 6 GB sums over cubes of ties are larger than a bigint, and the cast of the inputs failed."""
    n = 3_000_000
    frame = spark.range(n).select((F.col("id") % 2).alias("a"), F.lit(7.0).alias("b"))
    row = stats._inputs(frame, "ties", "a", "b", 200).first()
    half = n // 2
    assert row.y5 == n * (n - 1) * (2 * n + 5) > 2**63
    assert row.y3 == n * (n - 1) * (n - 2) > 2**63
    assert (row.n, row.excess, row.rho) == (n, 0, None)
    assert (row.x2, row.x3) == (2 * half * (half - 1), 2 * half * (half - 1) * (half - 2))  # not a double
    small = stats._inputs(frame.limit(50), "ties", "a", "b", 200)
    assert {kind for c, kind in small.dtypes if c not in ("name", "tau", "rho")} == {"bigint"}


@pytest.mark.parametrize("seed", range(12))
def test_pieces_and_pairs_between_them(monkeypatch, seed):
    """strips of a strip doubled the points with every round."""
    pa = pytest.importorskip("pyarrow")
    rng = np.random.default_rng(seed)
    limit, size = int(rng.integers(1, 80)), int(rng.integers(1, 90))
    monkeypatch.setattr(dominance, "_TOGETHER", int(rng.integers(1, 120)))
    g = np.sort(rng.choice(4, 400, p=[0.1, 0.6, 0.05, 0.25]))
    x, y = (rng.integers(0, rng.choice([3, 20, 1000]), 400) * 1.0 for _ in range(2))
    x[rng.random(400) < 0.3] = 1.0  # more points than a piece may hold
    w = rng.integers(1, 4, 400)

    def batches(**columns):
        return iter([pa.RecordBatch.from_pydict({c: v[i : i + size] for c, v in columns.items()}) for i in range(0, len(columns["g"]), size)])

    o = np.lexsort((x, g))
    found = [row for b in dominance._cut_pieces(batches(g=g[o], x=x[o], y=y[o], w=w[o]), limit) for row in b.to_pylist()]
    total = sum(int(row["excess"]) for row in found if row["excess"])
    points = [row for row in found if row["excess"] is None]
    held = Counter((row["g"], row["x"]) for row in points)
    assert all(piece % 2 or n <= limit for (_, piece), n in held.items())
    if points:
        cut = {c: np.array([row[c] for row in points]) for c in "gxyw"}
        o = np.lexsort((cut["y"], cut["g"]))
        total += sum(int(b.column(0)[0].as_py()) for b in dominance._count_between(batches(**{c: v[o] for c, v in cut.items()})))
    assert total == _signs(x, y, w, g)


def test_points_are_written_once_however_often_they_are_cut(spark, monkeypatch):
    """three rounds of strips wrote two, four and eight times the points."""
    written = []
    real = dominance.cut_lineage
    monkeypatch.setattr(dominance, "cut_lineage", lambda df, *a, **k: written.append(real(df, *a, **k)) or written[-1])
    rng = np.random.default_rng(6)
    x, y = rng.permutation(3000) * 1.0, rng.permutation(3000) * 1.0
    points = spark.createDataFrame([(float(a), float(b), 1) for a, b in zip(x, y)], "x double, y double, w long")
    assert int(dominance.excess(points, 6, 8).first()[0]) == _signs(x, y, np.ones(3000, int), np.zeros(3000))
    assert sum(df.count() for df in written if "y" in df.columns) <= 3000 + 64
