"""Registered queries as they are run, the whole pipeline, and shared passages against all pairs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_helpers import SCHEMA, components, edited, prose, words

from trialsift.llm import queries
from trialsift.llm.passages import repeated_passages
from trialsift.llm.tokenizer_files import WORD_BPE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE())


def test_op1(spark, texts):
    rows = queries.op1_shards(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    counts = [sum(r.shard == s for r in rows) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    for s in range(40):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_op2(spark, texts):
    for r in queries.op2_quality(spark, SF).collect():
        text = texts[r.doc_id]
        assert (r.n_words, r.word_chars) == (len(words(text)), sum(map(len, words(text))))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple]:
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (
            r"[0-9](?:[\x20-]?[0-9])+",
            lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        ),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    out = []
    for i, (name, (pattern, holds)) in enumerate(kinds.items()):
        out += [(m.start(), i, name, m.end()) for m in re.finditer(pattern, text) if holds(m.group())]
    return sorted(out)


def test_op3(spark, texts):
    for r in queries.op3_pii(spark, SF).collect():
        found = base_spans(texts[r.doc_id])
        joined = ",".join(f"{name}:{a}:{b}" for a, _, name, b in found)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(name == kind for _, _, name, _ in found)
        given = [s for s in r.spans.split(",") if s]
        assert set(joined.split(",")) - {""} <= set(given) and r.n_spans == len(given)


def test_op5(spark, texts, tokenizer):
    at = 0
    for r in sorted(queries.op5_tokens(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_op6(spark, texts, tokenizer):
    for r in queries.op6_bpe(spark, SF).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_op9(spark, texts):
    want = components(list(texts.items()), 85)
    rows = queries.op9_minhash(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_pipeline_from_end_to_end(spark, texts, tokenizer):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in rows}
    judged = {r.doc_id: r.kept for r in queries.op2_quality(spark, SF).collect()}
    assert kept and all(judged[i] for i in kept)
    groups = components([(i, texts[i]) for i in texts if judged[i]], 80)
    assert len({groups[i] for i in kept}) == len(kept)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
        if not base_spans(texts[r.doc_id]) and "token =" not in texts[r.doc_id]:
            assert ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids


# ---- passages ------------------------------------------------------------------------------------


def lowered(text: str) -> list[str]:
    return words(re.sub("[A-Z]", lambda m: m.group().lower(), text))


def common_words(a: list[str], b: list[str], least: int) -> tuple[set[int], set[int]]:
    """Places of both texts in a common run of ``least`` words or more, by all pairs of places."""
    x, y, last = set(), set(), {}
    for i in range(len(a)):
        row = {}
        for j in range(len(b)):
            if a[i] == b[j]:
                n = row[j] = last.get(j - 1, 0) + 1
                if n >= least:
                    x.update(range(i - n + 1, i + 1))
                    y.update(range(j - n + 1, j + 1))
        last = row
    return x, y


def test_passages_agree_with_all_pairs(spark):
    rng = random.Random(12)
    shared = [prose(900 + i, n) for i, n in enumerate((50, 55, 80, 49, 30))]
    rows = []
    for i in range(36):
        parts = [prose(100 + i, rng.randint(20, 90))]
        for passage in rng.sample(shared, rng.choice([0, 0, 1, 1, 2])):
            parts += [passage, prose(2000 + 10 * i + len(parts), rng.randint(20, 60))]
        rows.append((i, " ".join(parts), "en", "s", 1))
    rows += [(100, rows[3][1], "en", "s", 1), (101, None, "en", "s", 1), (102, "", "en", "s", 1)]
    places = {i: lowered(t or "") for i, t, *_ in rows}
    want: dict[int, set[int]] = {i: set() for i in places}
    for i in places:
        for j in places:
            if i < j:
                x, y = common_words(places[i], places[j], 50)
                want[i] |= x
                want[j] |= y
    found = repeated_passages(spark.createDataFrame(rows, SCHEMA), min_words=50).collect()
    got: dict[int, set[int]] = {i: set() for i in places}
    for r in found:
        assert r.end_word - r.start_word >= 50 and r.partner_id != r.doc_id
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    for i in places:
        assert want[i] <= got[i]
        # An alignment may go on over a few words that agree by chance.
        assert len(got[i] - want[i]) <= 0.25 * len(want[i])
    clean = {i for i in places if not want[i]}
    assert clean and not any(got[i] for i in clean)


@pytest.mark.parametrize("rate,least", [(0.05, 0.99), (0.1, 0.9)])
def test_passages_in_large_families_of_edited_copies(spark, rate, least):
    base, n = prose(77, 60), 100
    rows = []
    for i in range(n):
        copy = edited(base, int(60 * rate), i) if i else base
        rows.append((i, f"{prose(3000 + i, 40)} {copy} {prose(6000 + i, 40)}", "en", "s", 1))
    found = repeated_passages(spark.createDataFrame(rows, SCHEMA), min_words=40).collect()
    hit = {r.doc_id for r in found if r.start_word < 60 and r.end_word > 80}
    assert len(hit) >= least * n
