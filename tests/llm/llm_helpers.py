"""Small documents with every awkward case, and plain Python versions of the contracts' rules."""

from __future__ import annotations

import random
import re

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in "ka lo mi ne pu ra se ti vo".split() for b in "na ro li mek stu x".split()]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(words)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(out))


def edge_rows() -> list[tuple]:
    """NULLs in any column, empty and very long texts, ties, repeated rows."""
    rows = [(i, prose(i, 60 + i), "en" if i % 3 else "de", f"s{i % 4}", 1) for i in range(40)]
    rows += [
        (100, None, "en", "s0", None),
        (101, "", "en", "s0", 0),
        (102, " \t\n ", None, None, 4),
        (103, "a" * 20_000, "en", "s1", 20_000),
        (104, prose(7, 9000), "en", "s1", 1),
        (105, prose(3, 63), None, "s2", 1),
        (106, prose(3, 63), "en", None, 1),
        (None, prose(8, 70), "en", "s3", 1),
        (None, None, None, None, None),
        (7, prose(7, 67), "en", "s3", 1),
        (7, prose(7, 67), "en", "s3", 1),
    ]
    return rows


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = (
    "shard slot row_number bucket place size source_size target taken u weight where ran at stats kept "
    "distance g l base spans whole more ids decoded coded id node key host path rule own part x y h n"
).split()


def clashing(df):
    """The documents with extra columns named like outputs and working columns."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("extra").alias(c) for c in CLASHES], F.create_map(F.lit("k"), F.lit(1)).alias("extra_map"))


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, size: int = 5) -> set[tuple]:
    found = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return set()
    if len(found) < size:
        return {tuple(found)}
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def components(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, int]:
    """Smallest linked id of each id, by all pairs."""
    root = {i: i for i, _ in rows}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i == j or (x and y and 100 * len(x & y) >= percent * len(x | y)):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def edited(text: str, changes: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    out = text.split(" ")
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"edit{rng.integers(10**6)}"
    return " ".join(out)
