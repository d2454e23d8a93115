"""Sharding, quality rules, mixing, personal data and near copies against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import (
    CLASHES, SCHEMA, clashing, components, edge_docs, edge_rows, edited, no_docs, prose, shingles, words,
)
from pyspark.sql import functions as F

from trialsift.llm import boosting, minhash, mixing, pii, quality, sharding
from trialsift.llm.components import connected_components

# ---- sharding ------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_reproducible(spark):
    docs = edge_docs(spark)
    first = sharding.assign_shards(docs, 7, seed=3).select("doc_id", "text", "shard", "slot").collect()
    again = sharding.assign_shards(docs.repartition(5), 7, seed=3).select("doc_id", "text", "shard", "slot").collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    per_shard: dict[int, list[int]] = {}
    for r in first:
        per_shard.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in per_shard.values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per_shard.values())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1001])
def test_permutation_and_its_inverse(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 5).alias("p"))
    rows = rows.withColumn("back", sharding.permuted(F.col("p"), n, 5, forward=False)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_shards_of_clashing_and_empty_tables(spark):
    out = sharding.assign_shards(clashing(edge_docs(spark)), 4)
    assert out.count() == len(edge_rows()) and out.schema["shard"].dataType.simpleString() == "int"
    assert {"bucket", "place", "extra_map"} <= set(out.columns)
    assert sharding.assign_shards(no_docs(spark), 4).count() == 0


def test_written_shards(spark, tmp_path):
    sharding.write_shards(edge_docs(spark), str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 3


# ---- quality -------------------------------------------------------------------------------------


def plain_stats(text):
    w, t = words(text), text or ""
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {j for i in range(len(w) - 2) if grams[(w[i], w[i + 1], w[i + 2])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_quality_statistics(spark):
    rng = random.Random(2)
    pool = ["a", "B", "é", "#", "|", "\n", " ", "\t", "\x1c", "a b c", "x\ny\n", "🙂", "\x0b"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [r[1] for r in edge_rows()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in quality.measure(df).collect():
        got = tuple(r.stats)[:5]
        assert got == plain_stats(texts[r.i]), texts[r.i]


def local_estimate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same concentration steps in NumPy, from whole multiples of 1 / SCALE."""
    floor = np.diag(np.square(quality.FLOOR))

    def moments(rows):
        mean = rows.mean(axis=0)
        return mean, (rows[:, :, None] * rows[:, None, :]).mean(axis=0) - np.outer(mean, mean) + floor

    def far(rows, mean, cov):
        z = rows - mean
        return np.maximum(np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z), 0)

    def quantile(v, q):
        return np.sort(v)[math.ceil(len(v) * q) - 1]

    mid = np.array([quantile(c, 0.5) for c in x.T])
    sd = np.array([(quantile(c, 0.75) - quantile(c, 0.25)) / 1.349 for c in x.T])
    found = []
    for mean, cov, last in ((mid, np.diag(sd**2) + floor, math.inf), (*moments(x), np.linalg.slogdet(moments(x)[1])[1])):
        if last < math.inf:
            found.append((last, mean, cov))
        while True:
            bins = np.floor(np.log2(far(x, mean, cov) + 1) * quality.BIN)
            cut = np.sort(bins)[math.ceil(len(x) * quality.COVERED) - 1]
            mean, cov = moments(x[bins <= cut])
            now = np.linalg.slogdet(cov)[1]
            found.append((now, mean, cov))
            if not now < last - quality.FALLS:
                break
            last = now
    best = min(found, key=lambda f: f[0])
    return moments(x[far(x, best[1], best[2]) <= quality.FITS])


def test_outliers_match_local_estimates_and_junk_goes(spark):
    rows = [(i, prose(i, 80 + i % 90), "en", "hot", 1) for i in range(300)]
    rows += [(1000 + i, prose(5000 + i, 120).upper(), "en", "hot", 1) for i in range(30)]
    rows += [(2000 + i, " ".join(w + "%%%" for w in prose(7000 + i, 120).split()), "en", "hot", 1) for i in range(30)]
    rows += [(3000 + i, prose(9000 + i, 100), "en", f"small{i % 9}", 1) for i in range(130)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.reject_outliers(docs).collect()}
    assert all(got[r[0]].kept == (not 1000 <= r[0] < 3000) for r in rows)
    measured = quality.measure(docs).where("source = 'hot'")
    x = np.array(measured.select(*quality.vector(F.col("stats"))).collect(), dtype=float) / quality.SCALE
    ids = [r[0] for r in measured.select("doc_id").collect()]
    mean, cov = local_estimate(x)
    z = x - mean
    want = np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)
    assert np.allclose([got[i].distance for i in ids], want, rtol=1e-6, atol=1e-9)


def test_repeated_lines_or_windows_alone_reject(spark):
    def lines(seed, several):
        """Lines of five words each, ``several`` of which are followed by the same short line."""
        w = prose(seed, 150).split()
        cut = [" ".join(w[i : i + 5]) for i in range(0, 150, 5)]
        return "\n".join(c + "\nback" * (i < several) for i, c in enumerate(cut))

    def windows(seed, again):
        """One line in which the first ``again`` words come twice."""
        w = prose(seed, 150).split()
        return " ".join(w + w[:again])

    rows = [(i, prose(i, 80 + i % 90), "en", "hot", 1) for i in range(300)]
    rows += [(1000 + i, lines(5000 + i, 28), "en", "hot", 1) for i in range(8)]
    rows += [(2000 + i, windows(6000 + i, 50), "en", "hot", 1) for i in range(8)]
    rows += [(3000 + i, lines(7000 + i, 4), "en", "hot", 1) for i in range(8)]
    rows += [(4000 + i, windows(8000 + i, 8), "en", "hot", 1) for i in range(8)]
    got = {r.doc_id: r for r in quality.reject_outliers(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[r[0]].kept == (not 1000 <= r[0] < 3000) for r in rows), [r for r in got.values() if r.doc_id >= 1000]


def test_quality_of_edge_cases(spark):
    docs = edge_docs(spark)
    out = quality.reject_outliers(clashing(docs))
    rows = out.select("doc_id", "base_failed", "kept", "distance").collect()
    assert len(rows) == len(edge_rows()) and set(CLASHES) <= set(out.columns)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].base_failed and not by_id[i].kept for i in (100, 101, 102, 103))
    assert by_id[104].kept and by_id[105].kept and by_id[106].kept
    assert quality.reject_outliers(no_docs(spark)).count() == 0


# ---- personal data -------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text, spans):
    out, last, reach = [], 0, 0
    for a, k, b in sorted(spans):
        if a < reach:
            last = reach = max(reach, b)
            continue
        out += [text[last:a], f"[{pii.KINDS[k].upper()}]"]
        last = reach = b
    return "".join(out) + text[last:]


def test_base_spans_and_redaction(spark):
    rng = random.Random(4)
    pool = ["a", "b.c", "@", "@", "x-y", "_", "1", "12", "255", "256", "0001", ".", ".", " ", "-", "+", "(", ")",
            "4111 1111 1111 1111", "é", "🙂", "\n", "a@b.cd", "1.2.3.4", "+49 30 1234567"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["", None, "1" * 20_000, "a@" * 5_000, "a@b.c " * 700, "+1 (" * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = pii.find_pii(df, pii.fit_detector(df)).withColumn("old", F.col("text"))
    for r in pii.redact(found).select("i", pii.spans_text(F.col("base")).alias("b"), "spans", "text").collect():
        assert r.b == joined(plain_spans(texts[r.i]))
        if texts[r.i] is not None:
            spans = [(s["start"], s["kind"], s["end"]) for s in r.spans]
            assert set(plain_spans(texts[r.i])) <= set(spans) and r.text == redacted(texts[r.i], spans)


def test_trees_add_secrets_and_leave_prose_alone(spark):
    rng = random.Random(9)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'{prose(i, 30)} token = "{token()}" {prose(i + 500, 20)}') for i in range(200)]
    rows += [(1000 + i, prose(i, 60) + " " + "konstruktionszeichnungsbearbeitung" * (i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    detector = pii.fit_detector(df)
    for r in pii.find_pii(df, detector).collect():
        hits = [s for s in r.spans if s["kind"] == pii.KINDS.index("secret")]
        assert len(hits) == (1 if r.doc_id < 1000 else 0), r.doc_id


def test_pii_of_edge_cases(spark):
    docs = clashing(edge_docs(spark))
    out = pii.find_pii(docs, pii.fit_detector(docs))
    assert out.count() == len(edge_rows()) and set(CLASHES) <= set(out.columns)
    empty = no_docs(spark)
    assert pii.redact(pii.find_pii(empty, pii.fit_detector(empty))).count() == 0


def test_boosting_learns_an_interaction():
    x = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(3)])
    label = ((x[:, 0] > 1) & (x[:, 1] > 1) | (x[:, 2] == 2)).astype(int)
    model = boosting.fit_boosted(x, label, np.ones(len(x)))
    assert ((model.probability(x) > 0.5) == label).all()
    assert boosting.threshold_for(np.array([0.9, 0.8, 0.7]), np.array([1, 0, 1]), np.ones(3), 0.99) == 0.9
    assert boosting.threshold_for(np.array([0.9]), np.array([0]), np.ones(1), 0.99) > 1


# ---- near copies ---------------------------------------------------------------------------------


def near_rows():
    base = prose(77, 300)
    rows = [(i, edited(base, i % 12, i)) for i in range(60)]  # near copies at many distances
    rows += [(100 + i, prose(i, 40)) for i in range(30)]
    rows += [(200 + i, base) for i in range(25)]  # exact copies
    rows += [(300, None), (301, ""), (302, "  "), (303, "One two"), (304, "one TWO"), (305, "one two three"), (306, "é É")]
    rows += [(307, "É é"), (308, prose(5, 6000)), (309, prose(5, 6000) + " tail")]
    return rows


def test_components_match_all_pairs(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = components(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r.doc_id
        assert r.n_shingles == len(shingles(text[r.doc_id]))


def test_links_across_components_in_one_bucket(spark):
    """The comparison of strays by blocks finds what the pairs with a bucket's ends do not."""
    base = prose(1, 200)
    rows = [(1, edited(base, 40, 1)), (5, base), (6, base + " more"), (9, edited(base, 40, 2)), (12, prose(3, 50))]
    docs = spark.createDataFrame(rows, "id long, text string")
    buckets = spark.createDataFrame([(0, i, i) for i, _ in rows], "key long, node long, component long")
    links = minhash.across_components(buckets, docs, 5, 85).collect()
    assert [(r.x, r.y) for r in links] == [(5, 6)]


def test_every_coordinate_fills():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 50, 400]
    values = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    sketch = minhash.fill_bins(values, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
    assert (sketch != np.uint64(2**64 - 1)).all()
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    two = np.concatenate([a[:900], a[100:]])
    both = minhash.fill_bins(two, np.repeat([0, 1], 900), 2)
    assert abs((both[0] == both[1]).mean() - 0.8) < 0.17


def test_near_copies_of_edge_cases(spark):
    got = minhash.near_duplicates(clashing(edge_docs(spark))).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
    stays = minhash.keep_one(edge_docs(spark)).collect()
    ids = [r.doc_id for r in stays if r.doc_id is not None]
    want = components([(r[0], r[1]) for r in edge_rows() if r[0] is not None])
    assert sorted(ids) == sorted({i for i, c in want.items() if i == c})
    assert sum(r.doc_id is None for r in stays) == 2
    assert minhash.near_duplicates(no_docs(spark)).count() == 0 == minhash.keep_one(no_docs(spark)).count()


def test_marked_rows_miss_no_member(spark):
    from trialsift.llm.idsets import marked

    ids = spark.range(0, 3000, 7)
    df = spark.range(3000).select(F.col("id"), F.lit(1).alias("place")).union(spark.createDataFrame([(None, 1)], "id long, place int"))
    rows = marked(df, F.col("id"), ids, "m").collect()
    hits = {r.id for r in rows if r.m}
    assert len(rows) == 3001 and hits >= set(range(0, 3000, 7)) and len(hits) < 440
    assert not any(r.m for r in marked(df, F.col("id"), ids.limit(0), "m").collect())


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (8, 8), (2000, 2001), (2001, 2000)]
    root = {i: i for i in range(2100)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if b is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    touched = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {i: find(i) for i in touched} and len(got) == len(touched)
    none = connected_components(spark.createDataFrame([], "a int, b int"), "a", "b")
    assert none.count() == 0


# ---- mixing --------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped and sizes[s] > 0]
        left = total - sum(3 * sizes[s] for s in capped)
        unit = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if unit * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in capped else (unit * weight[s] if s in free else 0) for s in names}
        capped |= set(over)


@pytest.mark.parametrize("slice_rows", [3, 20_000])
def test_mix_reaches_targets(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    docs = clashing(edge_docs(spark))
    rows = mixing.plan_mix(docs).select("doc_id", "source", "text", "size", "source_size", "target", "taken").collect()
    assert len(rows) == len(edge_rows())
    sizes: dict = {}
    for _, text, _, source, _ in edge_rows():
        sizes[source] = sizes.get(source, 0) + len(words(text))
    targets = plain_targets(sizes)
    for source, target in targets.items():
        own = [r for r in rows if r.source == source]
        assert all(math.isclose(r.target, target, abs_tol=1e-6) and r.source_size == sizes[source] for r in own)
        longest = max(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= longest / 2 + 1e-6
        assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in own)
        assert max((r.taken // r["size"] for r in own if r["size"]), default=0) - min(
            (r.taken // r["size"] for r in own if r["size"]), default=0) <= 1
    key = lambda r: (str(r.doc_id), r.text or "", r.taken)
    again = mixing.plan_mix(docs.repartition(7)).select("doc_id", "source", "text", "size", "source_size", "target", "taken")
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r["size"] for r in rows if r["size"])
    assert {(r["size"], r["taken"]) for r in mixed.select("size", "taken").distinct().collect()} == {("extra", "extra")}
    assert mixing.plan_mix(no_docs(spark)).count() == 0
