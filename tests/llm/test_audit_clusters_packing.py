"""Filter audit, clustering and packing against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_helpers import SCHEMA, edge_docs, edge_rows, no_docs, prose
from pyspark.sql import functions as F

from trialsift.llm import byte_bpe, centroids, filter_audit, packing, queries, transducer
from trialsift.llm.tokenizer_files import BYTE_BPE

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def with_extra(df, names: str):
    return df.select("*", *[F.lit("extra").alias(c) for c in names.split()])


# ---- byte transducer -----------------------------------------------------------------------------


def plain_counts(text: str) -> list[int]:
    found = WORDS.findall(text)
    return [len(found), len(set(found)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))]


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_transducer_agrees_with_patterns(monkeypatch, piece, collide):
    monkeypatch.setattr(transducer, "PIECE", piece)
    transducer._powers.cache_clear()
    if collide:  # nearly all words share a hash, so that only their bytes tell them apart
        monkeypatch.setattr(transducer, "mix", lambda x: x & np.uint64(3))
    rng = random.Random(piece)
    for _ in range(60):
        texts = ["".join(rng.choice("ab AB\n\t #é漢😀\x1c|") for _ in range(rng.choice([0, 1, 9, 200]))) for _ in range(5)]
        raw = [t.encode() for t in texts]
        bounds = 2 + np.cumsum([0] + [len(b) for b in raw])
        got = transducer.count_texts(np.frombuffer(b"xx" + b"".join(raw), dtype=np.uint8), bounds)
        assert got.tolist() == [plain_counts(t) for t in texts]
    transducer._powers.cache_clear()


def test_text_counts_of_awkward_documents(spark):
    out = transducer.text_counts(with_extra(edge_docs(spark), "counts n_words"))
    rows = out.select("text", "counts.*").collect()
    assert len(rows) == len(edge_rows())
    assert all(list(r[1:]) == plain_counts(r[0] or "") for r in rows)
    assert transducer.text_counts(no_docs(spark)).count() == 0


# ---- filter audit --------------------------------------------------------------------------------


def brute_audit(docs: list[tuple], labels: list[tuple]) -> dict:
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    judged = []
    for i, text, _, source, _ in docs:
        text = text or ""
        n, distinct, capitals, points, symbols = plain_counts(text)
        earlier = i is not None and any(j is not None and j < i and (u or "") == text for j, u, *_ in docs)
        tests = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * points, symbols > 0, earlier)
        fails = {f for f, bad in zip("ABCDE", tests) if bad}
        judged.append((source or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        own = [d for d in judged if d[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone), f,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shares[row[6]]
    return out


def audit_rows() -> list[tuple]:
    rng = random.Random(5)
    rows = edge_rows()
    for i in range(200, 290):
        text = prose(i % 60, rng.choice([30, 199, 200, 260]))
        text = rng.choice([text, text.upper(), text + " 50% | #", " ".join(text.split()[:9] * 40)])
        rows.append((i, text, "en", rng.choice(["s0", "s1", "", None]), 1))
    return rows


def test_audit_runs_every_order(spark):
    rows = audit_rows()
    labels = [(i, i % 2, (i // 3) % 2) for i in range(0, 280, 2)]
    labels += [(200, 1, 1), (200, 0, 0), (None, 1, 1), (7, None, 1), (None, None, None)]
    docs = with_extra(spark.createDataFrame(rows, SCHEMA), "counts part failed digest key n good toxic quality")
    out = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in out.collect()}
    assert got == brute_audit(rows, labels)
    assert dict(out.dtypes)["step"] == "int" and dict(out.dtypes)["shapley"] == "bigint"


def test_audit_of_hot_copies_and_empty_tables(spark):
    marks = spark.createDataFrame([(3, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    copies = spark.range(1, 3001).select(
        F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    rows = filter_audit.audit_filters(copies, marks).where("filter_order = 'EABCD' AND step = 1").collect()
    assert {(r.part, r.kept, r.removed, r.good_lost) for r in rows} == {("a", 0, 1000, 1), ("b", 1, 1999, 1)}
    assert filter_audit.audit_filters(no_docs(spark), marks).count() == 0
    assert filter_audit.audit_filters(copies, marks.limit(0)).count() == 2 * 600


# ---- clustering ----------------------------------------------------------------------------------


def brute_clusters(rows: list[tuple], k: int, rounds: int, dims: int) -> list[tuple]:
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(256 * c) for c in x]))
    name = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups: dict = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, g in groups.items():
            centres[j] = [sum(c) // len(g) for c in zip(*g)]
    last = [(i, nearest(x)) for i, x in kept]
    total = sum(d for _, (d, _) in last)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        (i if i is not None else -1, j, d, sum(e for _, (e, g) in last if g == j), total, digest[j])
        for i, (d, j) in last
    )


def vector_rows(dims: int) -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=dims) / 3 + (i % 4)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (500, [0.0] * dims), (501, [0.0] * dims)]
    rows += [
        (600, None), (601, []), (602, [1.0] * (dims - 1)), (603, [math.nan] + [0.0] * (dims - 1)),
        (604, [None] + [0.0] * (dims - 1)), (605, [math.inf] + [0.0] * (dims - 1)), (606, [-math.inf] * dims),
    ]
    return rows


@pytest.mark.parametrize("dims,k,chunk", [(64, 12, 2048), (19, 5, 13), (16, 300, 2048)])
def test_clusters_agree_with_plain_rounds(spark, monkeypatch, dims, k, chunk):
    monkeypatch.setattr(centroids, "CHUNK", chunk)
    rows = vector_rows(dims)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = centroids.cluster(with_extra(vectors, "id x cluster block chunk distance"), k=k, rounds=4, dims=dims)
    got = sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in out.collect())
    assert got == brute_clusters(rows, k, 4, dims)
    assert [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]


def test_clusters_of_large_components_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    big = [(i, [float(i % 5) * 60_000 - 100_000.0, float(i), 0.5]) for i in range(40)]
    out = centroids.cluster(spark.createDataFrame(big, schema), k=3, rounds=3, dims=3)
    assert sorted(tuple(r) for r in out.collect()) == brute_clusters(big, 3, 3, 3)
    none = centroids.cluster(spark.createDataFrame([(1, None)], schema))
    assert none.count() == 0 and none.columns == out.columns
    with pytest.raises(Exception, match="a component is beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30])], schema), dims=1).count()


# ---- packing -------------------------------------------------------------------------------------


def plain_bins(counts: np.ndarray, cap: int) -> list[tuple]:
    """Best-two-fit one bin at a time, with every pair of documents tried."""
    left, out = counts.copy(), []
    while left.any():
        held, room = [], cap
        while fitting := [s for s in range(room, 0, -1) if left[s]]:
            left[fitting[0]] -= 1
            held.append(fitting[0])
            room -= fitting[0]
        if room and len(held) > 1:
            least = min(held)
            free = [s for s in range(1, cap + 1) if left[s]]
            pairs = [
                (a + b, a, b) for a in free for b in free
                if a >= b and least < a + b <= room + least and (a > b or left[a] > 1)
            ]
            if pairs:
                _, a, b = max(pairs)
                held.remove(least)
                left[least] += 1
                held += [a, b]
                left[a] -= 1
                left[b] -= 1
        out.append(tuple(sorted(held, reverse=True)))
    return out


def test_plan_of_bins_agrees_with_one_bin_at_a_time():
    rng = random.Random(2)
    for _ in range(80):
        cap = rng.choice([5, 10, 30])
        counts = np.zeros(cap + 1, dtype=np.int64)
        for _ in range(rng.randint(0, 50)):
            counts[rng.randint(1, cap)] += rng.choice([1, 1, 6])
        plan = packing.plan_bins(counts, cap)
        found = [tuple(s for s, n in held for _ in range(n)) for times, held in plan for _ in range(times)]
        assert found == plain_bins(counts, cap)
        best = sum(times for times, _ in packing.best_plan(counts, cap))
        assert -(-int((counts * np.arange(cap + 1)).sum()) // cap) <= best <= len(found)


def test_bins_of_many_documents_are_full():
    counts = np.zeros(1025, dtype=np.int64)
    sizes = np.random.default_rng(0).lognormal(5.2, 1, 200_000).astype(int).clip(1, 1024)
    counts += np.bincount(sizes, minlength=1025) * 10**7
    plan = packing.best_plan(counts, 1024)
    assert len(plan) < 20_000  # the plan does not grow with the number of documents
    assert sum(times for times, _ in plan) <= (counts * np.arange(1025)).sum() / 1024 * 1.001


ODD_TEXTS = [
    None, "", " ", "<|endoftext|>", "a <|endoftext|> b", "x" * 9000, " " * 9000 + "y", "  　x\x1cy",
    "I'll we've don't 'S it's 12ab34 …—� é 漢字 😀👍🏽 ١٢٣ \r\n\r\n \t z", prose(4, 3000),
]


def test_pieces_have_the_ids_of_the_library(spark):
    library = byte_bpe.ByteEncoder(BYTE_BPE())
    assert library.quick is not None
    rows = edge_rows() + [(300 + i, t, "en", "s9", 1) for i, t in enumerate(ODD_TEXTS)]
    docs = with_extra(spark.createDataFrame(rows, SCHEMA), "piece start length ids cell sequence_id offset rank part")
    packed = packing.pack_documents(docs, BYTE_BPE(), cap=100, end=2)
    assert "text" not in packed.columns and len(set(packed.columns)) == len(packed.columns)
    pieces = packed.collect()
    expected = []
    for i, text, *_ in rows:
        ids = library.library.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 100 or 100, len(ids) + 1, 100)]
        for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
            expected.append((i, n, low, high - low, np.array(ids[low:high], dtype="<u4").tobytes()))
    order = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    got = [(p.doc_id, p.piece, p.start, p.length, bytes(p.ids)) for p in pieces]
    assert sorted(got, key=order) == sorted(expected, key=order)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for p in pieces:
        row = whole[p.sequence_id]
        assert p.offset in row.starts and row.ids[4 * p.offset : 4 * (p.offset + p.length)] == p.ids
    assert sum(len(r.ids) for r in whole.values()) == sum(len(p.ids) for p in pieces)
    assert max(len(r.ids) for r in whole.values()) <= 400


@pytest.mark.parametrize("slice_rows", [7, 20_000])
def test_places_are_gapless_and_repeatable(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(packing, "SLICE_ROWS", slice_rows)
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 3, 3, 3, 3, 8, 20, 33, 64])) for i in range(900)] + [(5, 3), (5, 3), (None, 8)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long")
    out = packing.pack_pieces(with_extra(pieces, "s hashed"), cap=64)
    found: dict = {}
    for r in out.collect():
        found.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(map(len, found.values())) == len(rows)
    assert len(found) <= -(-sum(n for _, n in rows) // 64) + 1
    again = packing.pack_pieces(with_extra(pieces.repartition(5), "s hashed"), cap=64)
    columns = ("doc_id", "length", "sequence_id", "offset")
    assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, again.select(*columns).collect()))
    assert packing.pack_pieces(pieces.limit(0), cap=64).count() == 0
    with pytest.raises(Exception, match="a length is not from 1 to 64"):
        packing.pack_pieces(spark.createDataFrame([(1, 65)], "doc_id long, length long"), cap=64).count()


# ---- the registered queries ----------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def test_registered_packing_has_the_digests_of_the_contract(spark):
    rows = queries.op13_packing(spark, SF).collect()
    library = byte_bpe.ByteEncoder(BYTE_BPE()).library
    ids = {
        r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2]
        for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    }
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert r.length == len(part) // 4 <= 1024 and r.ids_crc32 == zlib.crc32(part)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert len({r.sequence_id for r in rows}) <= -(-sum(map(len, ids.values())) // 1024) + 2


def test_registered_audit_and_clusters_cover_their_tables(spark):
    audit = queries.op11_filters(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert audit.count() == 600 * docs.select("source").distinct().count()
    first = audit.where("step = 1 AND filter_order = 'ABCDE'").agg(F.sum(F.col("kept") + F.col("removed"))).first()[0]
    assert first == docs.count()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op12_centroids(spark, SF).collect())
    assert got == brute_clusters(vectors, 40, 5, 64)
