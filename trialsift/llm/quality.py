"""Quality rules: base rules on words, then robust multivariate outliers per language and source.

Statistics of a text become a vector of six transformed values.  Per group of language and source
the minimum-covariance-determinant estimate is found by concentration steps over *all* rows: given
a centre and a covariance, the ``COVERED`` share of rows with the smallest Mahalanobis distances gives the
next ones.  A group and start goes on as long as its determinant falls, by ``FALLS`` of its logarithm at
least, and then leaves the steps; so the steps end by themselves, and the smallest determinant seen counts.
Two starts (median and interquartile range; mean and covariance) are carried on and the smaller determinant wins.  A last step
re-estimates from all rows that fit, and a document is rejected when its distance is beyond the
chi-square quantile ``REJECT`` of six degrees of freedom.

A concentration step is one aggregation: rows are counted and summed per group and distance bin, so
a hot group is reduced before the shuffle, and the subset is cut at a bin (about 1 % of the distance
wide).  Values are whole multiples of 1/1024 and sums are exact, so reruns and other partitionings give the same
estimates.  Every covariance has the squares of ``FLOOR`` added, the regularised form of the
estimate: most texts have no symbols and no repeated lines, and a plain estimate would reject any
text that has one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.llm.common import fresh, others, quoted
from trialsift.llm.shingles import windows, word_hashes
from trialsift.session import cut_lineage

MIN_WORDS = 50
COVERED = 0.65
MIN_ROWS = 100  # groups with fewer rows are pooled per language, then over all languages
SCALE = 1024
NAMES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "letters")
# Smallest spread of each value that counts as a difference in quality.  A distance is at most the sum of
# (difference / floor)^2, so the floors of shares leave room for each to pass REJECT alone: where nobody else
# repeats anything, from 39 % of repeated lines or 25 % of words in repeated windows on.
FLOOR = (0.06, 0.045, 0.1, 0.08, 0.25, 0.4)
DIMS = len(NAMES)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
FALLS = 1e-6


def chi_square_cut(tail: float) -> float:
    """Quantile of six degrees of freedom, whose survival function is closed."""
    low, high = 0.0, 400.0
    for _ in range(200):
        x = (low + high) / 2
        if math.exp(-x / 2) * (1 + x / 2 + x * x / 8) > tail:
            low = x
        else:
            high = x
    return high


FITS = chi_square_cut(0.025)
REJECT = chi_square_cut(1e-6)

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_upper long"


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Class bits of every code point: 1 white space, 2 symbol, 4 letter, 8 upper-case letter."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        table[c] = 4 * ch.isalpha() + 8 * (ch.isalpha() and ch.isupper())
    table[[0x20, *range(0x09, 0x0E)]] = 1
    table[[ord(c) for c in "#*$%&|<>"]] |= 2
    return table


def _text_stats(text: str | None, kinds: np.ndarray) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(kinds[codes], minlength=16)
    bits = np.arange(16)
    seen: set[str] = set()
    lines = repeated = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            repeated += line in seen
            seen.add(line)
    again = 0
    if len(words) >= 3:
        _, inverse, times = np.unique(
            windows(word_hashes(words), 3), return_inverse=True, return_counts=True
        )
        covered = np.zeros(len(words), dtype=bool)
        twice = np.flatnonzero(times[inverse] > 1)
        for shift in range(3):
            covered[twice + shift] = True
        again = int(covered.sum())
    return (
        len(words),
        int(counts[(bits & 1) == 0].sum()),
        int(counts[(bits & 2) > 0].sum()),
        repeated,
        again,
        lines,
        int(counts[(bits & 4) > 0].sum()),
        int(counts[(bits & 8) > 0].sum()),
    )


def _all_stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Statistics of whole texts; zeros for NULL and for texts without words."""
    kinds = _kinds()
    names = [part.split()[0] for part in STATS.split(",")]
    for texts in batches:
        rows = [_text_stats(t, kinds) for t in texts]
        yield pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, len(names)), columns=names)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector(s: Column) -> list[Column]:
    """The transformed statistics in multiples of 1 / SCALE."""

    def share(a: str, b: str) -> Column:
        return F.sqrt(s[a] / F.greatest(s[b], F.lit(1)))

    odds = F.log((s["n_letters"] + 1) / (s["word_chars"] - s["n_letters"] + 1))
    values = [
        F.log((s["word_chars"] + 1) / (s["n_words"] + 1)),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        F.log((s["n_upper"] + 1) / (s["n_letters"] + 50)),
        odds,
    ]
    return [F.round(v * SCALE).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _group(lang: str, source: str | None) -> Column:
    """Group name of a row; NULL is a value like any other, and the pool of a language another."""
    parts = [F.coalesce(F.concat(F.lit("="), quoted(lang).cast("string")), F.lit("-"))]
    if source is not None:
        parts.append(F.coalesce(F.concat(F.lit("="), quoted(source).cast("string")), F.lit("-")))
    return F.concat_ws("\x01", *parts)


EVERY = "*"


def _pooled(rows: DataFrame) -> DataFrame:
    """Rows under the group that is large enough for them: their own, their language's, or all."""
    named = F.col("g")
    for level in ("l", None):
        counts = cut_lineage(rows.groupBy("g").agg(F.count("*").alias("held")))
        low = counts.where(F.col("held") < MIN_ROWS).select("g", F.lit(True).alias("few"))
        to = F.col("l") if level else F.lit(EVERY)
        rows = rows.join(low, "g", "left").withColumn("g", F.when(F.col("few"), to).otherwise(named))
        rows = rows.drop("few")
    return rows


def _estimates(sums: DataFrame) -> DataFrame:
    """Centre, inverse covariance (floored) and log-determinant from the sums of a group."""
    schema = "g string, start int, logdet double, " + ", ".join(
        [f"m{i} double" for i in range(DIMS)] + [f"v{i}{j} double" for i, j in PAIRS]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["n"].to_numpy(dtype=float)[:, None]
            mean = f[[f"s{i}" for i in range(DIMS)]].to_numpy(dtype=float) / n / SCALE
            cov = np.zeros((len(f), DIMS, DIMS))
            for i, j in PAIRS:
                product = f[f"p{i}{j}"].to_numpy(dtype=float) / n[:, 0] / SCALE**2
                cov[:, i, j] = cov[:, j, i] = product - mean[:, i] * mean[:, j]
            cov += np.diag(np.square(FLOOR))
            inverse = np.linalg.inv(cov)
            out = {"g": f["g"], "start": f["start"], "logdet": np.linalg.slogdet(cov)[1]}
            out |= {f"m{i}": mean[:, i] for i in range(DIMS)}
            out |= {f"v{i}{j}": inverse[:, i, j] * (1 if i == j else 2) for i, j in PAIRS}
            yield pd.DataFrame(out)

    return sums.mapInPandas(run, schema)


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined to its group's estimate."""
    z = [F.col(f"x{i}") / SCALE - F.col(f"m{i}") for i in range(DIMS)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.col(f"v{i}{j}") * z[i] * z[j]
    return F.greatest(total, F.lit(0.0))


BIN = 64  # distance bins per doubling


def _sums() -> list[Column]:
    """Number of rows, sums and sums of products of the values."""
    return [
        F.count("*").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS],
    ]


def _totals(binned: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return binned.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in binned.columns if c[0] in "sp" and c[1:].isdigit()]
    )


def _step(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step of all groups and starts."""
    near = rows.join(model, "g").select(
        "g", "start", F.floor(F.log2(distance() + 1) * BIN).alias("bin"), *[f"x{i}" for i in range(DIMS)]
    )
    binned = near.groupBy("g", "start", "bin").agg(*_sums())
    whole = Window.partitionBy("g", "start")
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = binned.select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("all"),
    ).where(F.col("before") < F.ceil(F.col("all") * COVERED))
    return cut_lineage(_estimates(_totals(inside.drop("bin", "before", "all"), ("g", "start"))))


def _starts(rows: DataFrame) -> DataFrame:
    """Median with interquartile range (start 0), mean with covariance (start 1)."""
    plain = _estimates(
        rows.groupBy("g").agg(*_sums()).withColumn("start", F.lit(1))
    )
    values = rows.select("g", F.posexplode(F.array(*[f"x{i}" for i in range(DIMS)])).alias("d", "x"))
    counts = values.groupBy("g", "d", "x").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("g", "d")
    ranked = counts.select(
        "g", "d", "x",
        F.sum("n").over(whole.orderBy("x")).alias("upto"),
        F.sum("n").over(whole).alias("all"),
    )

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("x"))) / SCALE

    spread = ranked.groupBy("g", "d").agg(
        quantile(0.5).alias("mid"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("sd")
    )
    wide = spread.groupBy("g").agg(
        *[F.max(F.when(F.col("d") == i, F.col("mid"))).alias(f"m{i}") for i in range(DIMS)],
        *[
            F.max(F.when(F.col("d") == i, 1 / (F.col("sd") ** 2 + FLOOR[i] ** 2))).alias(f"v{i}{i}")
            for i in range(DIMS)
        ],
    )
    robust = wide.select(
        "g",
        F.lit(0).alias("start"),
        F.lit(math.inf).alias("logdet"),
        *[f"m{i}" for i in range(DIMS)],
        *[F.col(f"v{i}{j}") if i == j else F.lit(0.0).alias(f"v{i}{j}") for i, j in PAIRS],
    )
    return cut_lineage(robust.unionByName(plain))


def fit(measured: DataFrame, stats: str = "stats", lang: str = "lang", source: str = "source") -> DataFrame:
    """Estimates per group (``g``) of the rows that pass the base rules."""
    s = F.col(stats)
    rows = measured.where(~base_failed(s)).select(
        _group(lang, source).alias("g"), _group(lang, None).alias("l"), *vector(s)
    )
    rows = _pooled(cut_lineage(rows))
    sizes = rows.groupBy("g").agg(F.count("*").alias("held")).where(F.col("held") >= MIN_ROWS)
    rows = cut_lineage(rows.join(sizes.select("g"), "g", "left_semi").drop("l"))
    active = _starts(rows)
    seen = active
    while not active.isEmpty():
        moved = _step(rows, active)
        seen = seen.unionByName(moved)
        last = active.select("g", "start", F.col("logdet").alias("last"))
        falling = moved.join(last, ["g", "start"]).where(F.col("logdet") < F.col("last") - FALLS)
        active = cut_lineage(falling.drop("last"))
    model = seen
    best = model.groupBy("g").agg(F.min_by(F.struct(*model.columns), F.struct("logdet", "start")).alias("b"))
    best = cut_lineage(best.select("b.*"))
    fitting = rows.join(best, "g").where(distance() <= FITS)
    sums = fitting.groupBy("g").agg(*_sums())
    return cut_lineage(_estimates(sums.withColumn("start", F.lit(0))).drop("start", "logdet"))


def measure(docs: DataFrame, text: str = "text", stats: str = "stats") -> DataFrame:
    """All columns of ``docs`` and the struct of statistics of the whole text."""
    text_stats = F.pandas_udf(_all_stats, STATS)
    return docs.withColumn(stats, text_stats(quoted(text).cast("string")))


def judge(
    measured: DataFrame, model: DataFrame, stats: str = "stats", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """All columns of ``measured`` and ``base_failed``, ``distance`` and ``kept``.

    The estimates are joined once per fallback level; Spark broadcasts them if they are small.
    """
    s = quoted(stats)
    names = fresh(measured, "g0", "g1", "d0")
    out = measured.select(
        "*", _group(lang, source).alias(names[0]), _group(lang, None).alias(names[1])
    )
    # Working names must not meet columns of the documents.
    mark = "__"
    while any(c.lower().startswith(mark) for c in out.columns):
        mark += "_"
    marked = [(n, f"{mark}{n}") for n in model.columns]
    distances = []
    xs = [x.alias(f"{mark}x{i}") for i, x in enumerate(vector(s))]
    out = out.select("*", *xs)
    every = model.where(F.col("g") == EVERY)
    for k, (part, key) in enumerate(
        ((model, quoted(names[0])), (model, quoted(names[1])), (every, F.lit(EVERY)))
    ):
        own = part.select(*[F.col(n).alias(f"{m}_{k}") for n, m in marked])
        found = F.col(f"{mark}g_{k}")
        # One row at most has the name of all languages, so that this one is broadcast.
        out = out.join(F.broadcast(own) if k == 2 else own, found == key, "left")
        z = [F.col(f"{mark}x{i}") / SCALE - F.col(f"{mark}m{i}_{k}") for i in range(DIMS)]
        total = F.lit(0.0)
        for i, j in PAIRS:
            total = total + F.col(f"{mark}v{i}{j}_{k}") * z[i] * z[j]
        distances.append(F.when(found.isNotNull(), F.greatest(total, F.lit(0.0))))
    far = F.coalesce(*distances)
    failed = base_failed(s)
    return out.select(
        *others(measured, ("base_failed", "distance", "kept")),
        failed.alias("base_failed"),
        far.alias("distance"),
        (~failed & (F.coalesce(far, F.lit(0.0)) <= REJECT)).alias("kept"),
    )


def reject_outliers(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All columns of ``docs``, the ``stats`` of their texts, ``base_failed``, ``distance``, ``kept``.

    Texts that are NULL, empty or short fail the base rules.  NULL is a language and a source like
    any other.  Groups under ``MIN_ROWS`` rows are judged with those of their language, then of all
    languages; where even these are few, only the base rules hold (``distance`` is NULL).  Repeated
    rows count each.  Columns with the names of outputs are replaced.  Texts are measured once: rows and
    statistics are written, estimates read the statistics alone, and the verdict reads all.
    """
    (stats,) = fresh(docs.drop("stats"), "stats")
    plain = docs.select(*others(docs, ("stats",)))
    measured = cut_lineage(measure(plain, text, stats))
    model = fit(measured.select(quoted(lang), quoted(source), quoted(stats)), stats, lang, source)
    return judge(measured, model, stats, lang, source)
