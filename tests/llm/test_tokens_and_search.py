"""Token ids and files, shared passages, exact search, URLs and the pipeline against plain Python."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import (
    CLASHES, VOCABULARY, clashing, components, edge_docs, edge_rows, edited, no_docs, prose, shingles, words,
)
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialsift.llm import bpe, passages, pivots, range_coder, token_files, urls
from trialsift.llm.tokenizer_files import WORD_BPE
from trialsift.session import cut_lineage


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE())


def odd_texts(n: int = 1500) -> list[str]:
    rng = random.Random(3)
    pool = "abcABC'sd12 \t\n\x1c\x85 éÉñΣσςİıßﬁ①½२क्षि中文字🙂🏽́‍<|>!?…Ａ\xa0ǅ\x00"
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return [*out, "", "a" * 3000, "thethe" * 900, "x<|endoftext|>y <|startoftext|><|ENDOFTEXT|>", "it's WE'LL"]


# ---- BPE -----------------------------------------------------------------------------------------


def test_encoder_matches_the_library(tokenizer):
    texts = odd_texts()
    encoder = bpe.Encoder(open(WORD_BPE(), encoding="utf-8").read())
    for text, want, (ids, decoded) in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), encoder.encode(texts)):
        assert ids.tolist() == want.ids, text
        assert decoded == tokenizer.decode(want.ids, skip_special_tokens=False) == encoder.decode(ids)


def test_memory_of_pieces_is_bounded(tokenizer):
    encoder = bpe.Encoder(open(WORD_BPE(), encoding="utf-8").read())
    encoder.table.limit = 50
    texts = [prose(i, 40) for i in range(30)]
    for text, (ids, _) in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["ab" * 40, "hello" * 30, "aaaa" * 33])
def test_long_and_short_trees_agree(text):
    vocabulary = bpe.Vocabulary(open(WORD_BPE(), encoding="utf-8").read())
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    symbols = vocabulary.inner[raw]
    symbols[-1] = vocabulary.last[raw[-1]]
    rows = bpe.merge_many(symbols[None, :], vocabulary)[0]
    assert bpe.merge_one(symbols.tolist(), vocabulary.pairs) == rows[rows >= 0].tolist()


def test_bpe_of_documents(spark, tokenizer):
    docs = clashing(edge_docs(spark))
    out = bpe.bpe_encode(docs, WORD_BPE())
    assert set(out.columns) == set(docs.columns) | {"ids", "decoded"}
    for r in out.collect():
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == tokenizer.decode(want, skip_special_tokens=False)
    back = bpe.bpe_decode(out.select("doc_id", "ids", F.col("decoded").alias("old")), WORD_BPE())
    assert all(r.old == r.decoded for r in back.collect())
    assert bpe.bpe_encode(no_docs(spark), WORD_BPE()).count() == 0


# ---- token files ---------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "zeros", "few", "runs", "one", "edge"])
def test_coder_round_trip(kind):
    rng = np.random.default_rng(1)
    ids = {
        "random": rng.integers(0, 1 << 16, 3000),
        "zeros": np.zeros(2500, int),
        "few": rng.integers(0, 4, 5000),
        "runs": np.repeat(rng.integers(0, 60_000, 40), 60),
        "one": np.array([65_535]),
        "edge": np.tile([0, 255, 256, 65_535], 700),
    }[kind].astype(np.uint16)
    starts = np.arange(0, len(ids), range_coder.BLOCK)
    lengths = np.minimum(range_coder.BLOCK, len(ids) - starts)
    payloads, checks = range_coder.encode_blocks(ids, starts, lengths)
    # Blocks are independent: any of them decodes alone.
    for s, n, p, c in zip(starts, lengths, payloads, checks):
        assert (range_coder.decode_blocks([p], np.array([n]), [c])[0] == ids[s : s + n]).all()
    if kind in ("zeros", "few", "runs"):
        assert sum(map(len, payloads)) < len(ids)
    damaged = bytes([payloads[0][0] ^ 255]) + payloads[0][1:]
    with pytest.raises(ValueError):
        range_coder.decode_blocks([damaged], lengths[:1], [checks[0] ^ 1])


def encoded(encoder, texts):
    import pyarrow as pa

    return [np.frombuffer(x.as_buffer(), "<u2").tolist() for run in encoder.encode(pa.array(texts, pa.string()), 2) for x in run]


@pytest.mark.parametrize("around", ["{}", "a{}B", "9{}9", "'{}", "{}'S", "\u00df{}", "{}\u0301"])
def test_split_words_are_those_of_the_library(tokenizer, around):
    """Every character up to the end of Greek and Cyrillic, whether its piece is split here or in the library."""
    texts = [around.format(chr(c)) for c in range(0x530)]
    encoder = token_files.LibraryEncoder(open(WORD_BPE(), encoding="utf-8").read())
    want = [w.ids + [2] for w in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded(encoder, texts) == want


def test_every_word_is_merged_once(tokenizer, monkeypatch):
    encoder = token_files.LibraryEncoder(open(WORD_BPE(), encoding="utf-8").read())
    asked, merge = [], encoder.merger._merge
    monkeypatch.setattr(encoder.merger, "_merge", lambda words: (asked.extend(words.to_pylist()), merge(words))[1])
    monkeypatch.setattr(encoder, "_encode_whole", lambda pieces: pytest.fail(f"asked whole: {pieces}"))
    texts = ["Word, word. (WORD) word's", None, "", " \n", "\u00c9t\u00e9 \u00e9t\u00e9, word", *[prose(i, 30) for i in range(9)]]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert encoded(encoder, texts) == want and encoded(encoder, texts[::-1]) == want[::-1]
    assert len(asked) == len(set(asked)) and {"word", "\u00e9t\u00e9", ",", "'s"} <= set(asked)


def test_memory_of_words_and_length_of_runs_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 50)
    monkeypatch.setattr(token_files, "_RUN", 300)
    monkeypatch.setattr(token_files, "_CALL", 7)
    encoder = token_files.LibraryEncoder(open(WORD_BPE(), encoding="utf-8").read())
    texts = [*odd_texts(), *[prose(i, 40) for i in range(30)]]
    assert encoded(encoder, texts) == [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert len(encoder.merger.known) < 200


def test_coder_learns_whole_ids():
    """A block of few, scattered ids: order 0 alone must learn their upper bytes."""
    ids = np.random.default_rng(5).choice(np.array([3, 7000, 7001, 30_000, 49_000]), 4 * range_coder.BLOCK).astype(np.uint16)
    starts = np.arange(0, len(ids), range_coder.BLOCK)
    lengths = np.full(len(starts), range_coder.BLOCK)
    payloads, checks = range_coder.encode_blocks(ids, starts, lengths)
    # Blocks of different length, and one without ids, go side by side.
    more, sums = range_coder.encode_blocks(ids, np.array([0, 5, 9, 40]), np.array([1000, 17, 0, 300]))
    back = range_coder.decode_blocks([*payloads, *more], np.append(lengths, [1000, 17, 0, 300]), [*checks, *sums])
    for got, s, n in zip(back, [*starts, 0, 5, 9, 40], [*lengths, 1000, 17, 0, 300]):
        assert (got == ids[s : s + n]).all()
    assert sum(map(len, payloads)) * 8 < 13 * len(ids)
    with pytest.raises(ValueError):
        range_coder.decode_blocks([payloads[0][:-3]], lengths[:1], checks[:1])


def test_no_small_group_of_blocks_is_left_over(monkeypatch):
    monkeypatch.setattr(range_coder, "LANES", 100)
    for n in (0, 1, 99, 104, 149, 151, 1049):
        lengths = np.random.default_rng(n).integers(0, 50, n)
        groups = list(range_coder._batches(lengths))
        assert sorted(np.concatenate([*groups, []]).tolist()) == list(range(n))
        assert all((np.diff(lengths[g]) <= 0).all() for g in groups)
        assert n < 100 or all(60 < len(g) <= 150 for g in groups)


def test_token_files(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 4096)
    docs = clashing(edge_docs(spark)).repartition(5)
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, WORD_BPE(), end=2)
    got = token_files.read_token_files(spark, path).collect()
    want = sorted(
        (r[0] if r[0] is not None else -1, tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]))
        for r in edge_rows()
    )
    rows = sorted((r.doc_id if r.doc_id is not None else -1, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    assert rows == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += len(r.ids) // 4
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    empty = str(tmp_path / "none")
    token_files.write_token_files(no_docs(spark), empty, WORD_BPE())
    assert token_files.read_token_files(spark, empty).count() == 0
    damaged = spark.read.parquet(path).withColumn("checks", F.transform("checks", lambda c: c + 1))
    damaged.write.parquet(str(tmp_path / "damaged"))
    with pytest.raises(Exception, match="checksum"):
        token_files.read_token_files(spark, str(tmp_path / "damaged")).collect()


# ---- passages ------------------------------------------------------------------------------------


def best_chain(xs, ys):
    """Best chain score by comparing all pairs of anchors."""
    order = sorted(range(len(xs)), key=lambda i: (xs[i], ys[i]))
    score = {}
    for i in order:
        gains = [
            score[j] - passages.GAP_COST * (xs[i] - xs[j] + ys[i] - ys[j])
            for j in score if xs[j] < xs[i] and ys[j] < ys[i]
        ]
        score[i] = passages.K + max([0.0, *gains])
    return max(score.values())


def test_chains_are_best_and_collinear():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 40)
        xs, ys = [rng.randrange(60) for _ in range(n)], [rng.randrange(60) for _ in range(n)]
        found = passages.chains(xs, ys)
        assert sum(map(len, found)) == n and all(
            a < b and c < d for path in found for (a, c), (b, d) in zip(path, path[1:])
        )
        tree = passages.Fenwick(60)
        assert tree.upto(60)[1] == -1
        assert abs(best_chain(*zip(*found[0])) - best_chain(xs, ys)) < 1e-9


def test_alignment_finds_the_common_stretch():
    x, y = np.arange(100, 200, dtype=np.uint64), np.arange(130, 260, dtype=np.uint64)
    # x[30:] equals y[:70]; the slices begin at words 1000 and 2000 of their texts.
    assert passages.align(x, y, 1000, 2000, ([1050], [1056], [970])) == [(1030, 1100, 2000, 2070)]
    # A word of y is missing: the diagonal changes by one, wherever the change is seen.
    z = np.delete(y, 20)
    runs = ([1035, 1070], [1041, 1076], [970, 969])
    assert passages.align(x, z, 1000, 2000, runs) == [(1030, 1100, 2000, 2069)]
    # Two stretches with unlike words between them are two results.
    w = np.concatenate([x[:40], np.arange(900, 960, dtype=np.uint64), x[40:]])
    v = np.concatenate([x[:40], np.arange(700, 760, dtype=np.uint64), x[40:]])
    assert sorted(passages.align(w, v, 0, 0, ([0], [6], [0]))) == [(0, 40, 0, 40), (100, 160, 100, 160)]


def test_alignments_part_where_words_differ():
    rng = np.random.default_rng(8)

    def parted(*lengths):
        """Texts that agree in every other length, from the first on."""
        x = rng.integers(0, 2**63, sum(lengths), dtype=np.uint64)
        y, ends = x.copy(), np.cumsum(lengths)
        for k in range(1, len(lengths), 2):
            y[ends[k - 1] : ends[k]] += np.uint64(1)
        alike = [(int(ends[k] - lengths[k]), int(ends[k])) for k in range(0, len(lengths), 2)]
        return x, y, alike

    gaps = [(100, 80, 100), (60, 40, 60), (200, *[80, 200] * 5), (200, 80, 60, 80, 200), (50, 30, 50, 400, 50, 30, 50)]
    for lengths in gaps:
        x, y, alike = parted(*lengths)
        found = passages.align(x, y, 0, 0, ([0], [len(x)], [0]))
        assert all(any(c <= a and b <= d for c, d, _, _ in found) for a, b in alike), (lengths, found)
        assert all((c, d) == (e, f) and (x[c:d] == y[c:d]).mean() >= 0.8 for c, d, e, f in found), (lengths, found)


def passage_docs(spark, rng, passages_of, first=0):
    """Documents of numbered words with a passage between 70 unlike words on both sides."""
    def text(middle):
        around = [f"u{n}" for n in rng.integers(0, 2**62, 140)]
        return " ".join([*around[:70], *middle, *around[70:]])

    rows = [(first + i, text(middle)) for i, middle in enumerate(passages_of)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def covered(docs):
    """Documents whose passage is found but for a few words at its ends."""
    rows = passages.repeated_passages(docs).collect()
    return {r.doc_id for r in rows if r.start_word <= 76 and r.end_word >= 124}


def test_passages_shared_by_middle_documents(spark):
    """Each seed of the passage stands alone in a lower and in a higher document too."""
    rng = np.random.default_rng(4)
    shared = [f"w{i}" for i in range(60)]
    strays = [shared[i : i + 9] for i in range(0, 52, 2)]
    around = [[f"s{n}" for n in rng.integers(0, 2**62, 30)] + s for s in strays]
    docs = passage_docs(spark, rng, [*around, shared, shared, *around])
    assert {len(strays), len(strays) + 1} <= covered(docs)


def test_passages_with_every_fifth_word_changed(spark):
    rng = np.random.default_rng(5)
    found = []
    for k, every in enumerate((12, 10, 8, 6, 5)):
        for i in range(6):
            shared = [f"p{k}.{i}.{j}" for j in range(60)]
            found += [shared, [f"q{k}.{i}.{j}" if j % every == every - 1 else w for j, w in enumerate(shared)]]
    docs = passage_docs(spark, rng, found)
    assert covered(docs) == set(range(len(found)))


def test_shared_passages(spark):
    exact, fuzzy = prose(900, 60), prose(901, 90)
    rows = [(i, prose(i, 150)) for i in range(30)]
    rows += [(100 + i, f"{prose(300 + i, 40)} {exact} {prose(400 + i, 40)}") for i in range(20)]
    rows += [(200 + i, f"{prose(500 + i, 40)} {edited(fuzzy, 5, i)} {prose(600 + i, 40)}") for i in range(6)]
    rows += [(300 + i, prose(950, 80)) for i in range(4)]  # copies
    rows += [(400, f"{prose(1, 30)} {' '.join(exact.split()[:30])}"), (401, None), (402, ""), (403, "a b"), (404, "w " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.repeated_passages(docs).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.partner_id))
    assert set(by) == {*range(100, 120), *range(200, 206), *range(300, 304)}
    for i in range(100, 120):
        assert any(a <= 40 and b >= 100 and b - a < 115 for a, b, _ in by[i]), by[i]
    for i in range(200, 206):
        assert any(a <= 46 and b >= 124 for a, b, _ in by[i]), by[i]
    assert all(p != i for i, found in by.items() for *_, p in found)
    edges = passages.repeated_passages(clashing(edge_docs(spark))).collect()
    assert {5, 104, 105, 106} & {r.doc_id for r in edges} >= {105, 106}
    assert passages.repeated_passages(no_docs(spark)).count() == 0


def test_places_travel_in_a_few_bytes():
    """Places of seeds come whole out of their packs, which have half the bytes of plain rows."""
    rng = np.random.default_rng(4)
    words = {7 * i: rng.integers(0, 1 << 32, size=400, dtype=np.uint32) for i in range(250)}
    words[5] = np.array([1, 2, 3], dtype=np.uint32)  # too short for a seed
    batch = pa.RecordBatch.from_pydict({"node": list(words), "words": [w.tobytes() for w in words.values()]})
    packs = list(passages._places(6)(iter([batch])))
    rows = [r for b in packs for r in b.to_pylist()]
    assert [r["bucket"] for r in rows] == list(range(6))
    got = set()
    for r in rows:
        rest = passages.unpacked_hashes(r["h"], r["n"]).tolist()
        got |= set(zip([r["bucket"]] * r["n"], rest, *(passages.unpacked(r[c], r["n"]).tolist() for c in ("node", "p"))))
    want, kept = set(), 1 << 8 * passages.SEED_BYTES
    for node, own in words.items():
        for p, h in enumerate(passages.grams(own.astype(np.uint64)).view(np.uint64).tolist()):
            want.add((h % 6, h // 6 % kept, node, p))
    assert got == want and sum(r["n"] for r in rows) == len(want) == 250 * 397
    assert sum(b.nbytes for b in packs) < 10 * len(want)


def test_packs_do_not_multiply_with_partitions():
    assert passages.bucket_count(0, 200) == 1
    assert passages.bucket_count(8_000_000, 211) == passages.bucket_count(8_000_000, 4000) == 488
    assert passages.bucket_count(24_000_000, 12) == 96
    assert passages.bucket_count(10**10, 48) == 9537


def test_anchors_travel_in_packs(spark):
    """Links over packs are those over plain rows, whatever the number of buckets."""
    rng = np.random.default_rng(9)
    columns = {"node": list(range(40)), "words": [rng.integers(0, 4, size=60, dtype=np.uint32).tobytes() for _ in range(40)]}
    batch = pa.RecordBatch.from_pydict(columns)

    def anchors(buckets):
        by_bucket = {}
        for r in (r for b in passages._places(buckets)(iter([batch])) for r in b.to_pylist()):
            by_bucket.setdefault(r["bucket"], []).append(r)
        rows = [r for k in sorted(by_bucket) for r in by_bucket[k]]
        found = []
        for b in passages._linked(buckets)(iter([pa.RecordBatch.from_pylist(rows)])):
            for r in b.to_pylist():
                found += zip(*(passages.unpacked(r[c], r["n"]).tolist() for c in "xyda"))
        return sorted(found)

    plain = [(int(h), n, p) for n, w in zip(*columns.values())
             for p, h in enumerate(passages.grams(np.frombuffer(w, dtype=np.uint32).astype(np.uint64)))]
    h, node, p = (np.array(c) for c in zip(*sorted(plain)))
    want = [(int(node[i]), int(node[j]), int(p[j] - p[i]), int(p[i]))
            for u, v in passages.links(h, node, np.arange(len(h))) for i, j in zip(u, v)]
    assert anchors(1) == anchors(13) == sorted(want)


def test_shuffle_files_go_with_the_write(spark):
    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in folders for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}

    before = files()
    written = cut_lineage(spark.range(1000).repartition(3, "id"), free=True)
    assert not files() - before and written.count() == 1000


# ---- search --------------------------------------------------------------------------------------


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(pivots, "ROW_BLOCK", 64)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(20)]  # ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] + [0.0] * 5), (403, [float("inf")] * 6),
             (404, []), (None, [1.0] * 6), (450, [0.0] * 6), (500, [9e9] * 6), (550, [1.0, 2.0]), (600, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = pivots.top_k(df.repartition(4), F.col("vec_id") % 50 == 0, k=5).collect()
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = [int(np.floor(256 * x)) for x in v]
    want = []
    for q, v in whole.items():
        if q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v)]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert pivots.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert pivots.top_k(one, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_best_of_a_block_looks_seldom_and_is_exact(monkeypatch, scale):
    """Bounds that exclude little cost a few evaluations of growing size, not one for every 128 rows."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-9, 10, size=(6000, 12)) * scale
    rows[3000:3200] = rows[17]  # ties
    ids = rng.permutation(6000)
    pivots_ = pivots.choose_pivots(rows[:100])
    table = pivots._distances(rows, pivots_)
    block = pivots.Block(ids, rows, table, np.square(rows.astype(np.float64)).sum(axis=1))
    sizes = []
    scores = pivots.Block.scores
    monkeypatch.setattr(pivots.Block, "scores", lambda self, at, q: (sizes.append(len(at)), scores(self, at, q))[1])
    for i in (17, 3000, 42):
        sizes.clear()
        found = pivots.best_of(rows[i], int(ids[i]), table[i], -np.inf, block, 5)
        query = rows[i].tolist()
        want = [(sum(a * b for a, b in zip(r, query)), n) for r, n in zip(rows.tolist(), ids.tolist()) if n != ids[i]]
        assert found == sorted(want, key=lambda f: (-f[0], f[1]))[:5] and len(sizes) <= 6


# ---- URLs ----------------------------------------------------------------------------------------


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://a.example.com/en/1", None),
        (2, "https://www.example.com/en/2", ""),
        (3, "http://b.NET/es/x?q=1#f", None),
        (4, "http://plain.org/x", '<link rel="canonical" href="http://b.net/es/x?q=1">'),
        (5, "https://plain.org/x/?utm_source=feed#top", None),  # an alias of 4
        (6, "http://other.org/", '<meta http-equiv="refresh" content="0; url=http://plain.org/x">'),
        (7, "http://free.org/", "<LINK href='http://shop.com/a' rel='canonical'>"),
        (8, "http://both.org/", '<link rel=canonical href=http://b.net/fr/>'),
        (9, "http://both2.org/", '<link rel=canonical href=http://both.org/>'),
        (10, "http://shop.com/b", '<link rel=canonical href="http://both.org/index.html">'),
        (11, None, "<link rel=canonical href=http://b.net/es/x>"),
        (12, "no scheme", None),
        (13, "", None),
        (14, "http://", None),
        (15, "http://x.org", '<link rel="canonical" href="/y">'),
        (16, "http://example.com.org/en/", None),
        (17, "x://net/es/", None),
        (18, "http://plain.org/x", None),
        (18, "http://plain.org/x", None),
        (19, "http://b.net/fr/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge_urls(clashing(pages).repartition(4))
    found = {r.page_id: (r["host"], r["path"], r["rule"], r.verdict) for r in got.collect()}
    assert got.count() == len(rows)
    assert found[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert found[2][2:] == ("www.example.com/en/", "allow")
    assert found[3] == ("b.net", "/es/x", "net/es/", "block")
    assert [found[i][2:] for i in (4, 5, 6, 18)] == [(None, "block")] * 4
    assert found[7][2:] == (None, "allow")
    # A block and an explicit allow in one component: allow goes first, the block's own rule stays.
    assert [found[i][2:] for i in (8, 9)] == [(None, "allow")] * 2 and found[10][2:] == ("com/", "allow")
    assert found[19][2:] == ("net/fr/", "block")
    assert found[11] == found[12] == found[13] == found[14] == ("", "", None, "allow")
    assert found[15][2:] == (None, "allow") and found[16][2:] == (None, "allow") and found[17][2:] == ("net/es/", "block")
    redirects = spark.createDataFrame([("http://x.org", "http://b.net/es/"), (None, "http://a.org")], "from_url string, to_url string")
    extra = pages.unionByName(spark.createDataFrame([(20, "http://b.net/es/", None)], pages.schema))
    more = {r.page_id: r.verdict for r in urls.judge_urls(extra, redirects=redirects).collect()}
    assert more[15] == "block"
    assert urls.judge_urls(pages.limit(0)).count() == 0
    assert urls.judge_urls(pages.drop("html"), html=None).count() == len(rows)


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tokenizer):
    import corpus_pipeline as pipeline

    rows = [(i, prose(i, 60 + i) + (f" mail {i}x@mail.example.com" if i % 7 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(150)]
    rows += [(200 + i, prose(3, 63), "en", "s1", 0) for i in range(5)]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in prose(i, 90).split()), "en", "s2", 0) for i in range(12)]
    rows += [(400, None, "en", "s0", 0), (401, "short", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["quality_rules", "near_copies", "personal_data", "source_mix", "token_ids"]
    good = stage["quality_rules"](spark, docs, "")
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and ids == {r[0] for r in rows if r[0] < 300}
    one = stage["near_copies"](spark, good, "")
    want = components([(r[0], r[1]) for r in rows if r[0] in ids])
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, c in want.items() if i == c}
    clean = stage["personal_data"](spark, one, "")
    texts = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and all("@" not in r.text and r.n_chars == len(r.text) for r in texts.values())
    assert "[EMAIL]" in texts[7].text and texts[8].text == rows[8][1]
    mixed = stage["source_mix"](spark, clean, "")
    assert mixed.columns == docs.columns
    total = sum(len(words(r.text)) for r in texts.values())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - total) < 0.2 * total
    last = stage["token_ids"](spark, mixed, "").collect()
    assert len(last) == mixed.count()
    for r in last[:40]:
        assert np.frombuffer(r.ids, "<u4").tolist() == tokenizer.encode(texts[r.doc_id].text, add_special_tokens=False).ids
    for name, run in pipeline.STAGES:
        run(spark, no_docs(spark), "").collect()


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sum(name.startswith("op") and name[2].isdigit() for name in names) == 13 and "pipeline" in names
    assert set(CLASHES) and VOCABULARY and zlib.crc32(b"a")


def test_near_copies_stage_links_from_four_fifths_on(spark):
    import corpus_pipeline as pipeline

    base = prose(41, 300).split()
    rows = [(1, " ".join(base))]
    for i, edits in ((2, 6), (3, 8)):
        other = list(base)
        for k in range(edits):
            other[20 + 35 * k] = f"edit{i}x{k}"
        rows.append((i, " ".join(other)))
    sets = [shingles(t) for _, t in rows]
    assert [round(len(sets[0] & s) / len(sets[0] | s), 2) for s in sets[1:]] == [0.82, 0.76]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_copies(spark, docs, "").collect()} == {1, 3}
