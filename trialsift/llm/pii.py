"""Personal data in whole texts: strict patterns, and candidates chosen by boosted trees.

Strict patterns (``BASE``) always give spans.  Around them, generous generators propose candidates,
overlapping ones included; each has features of its format and of its context, and boosted trees
give it a probability.  Thresholds are calibrated per generator to a precision on candidates that
the trees have not seen.  The labels to learn from are the candidates whose case is clear: formats that
a strict rule confirms or excludes; the rest is left to the trees.

All work on texts is done by SQL expressions within a row: positions come from the lengths of the
pieces between matches, so no text is exploded, shuffled or sent to Python.  The patterns use
possessive repetitions and look-behinds, so that they take linear time on long runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift.llm.boosting import Boosted, calibrate, fit_boosted, threshold_for
from trialsift.llm.common import fresh, others, quoted

KINDS = ("email", "ip", "card", "phone", "secret")
MAX_CELLS = 50_000  # distinct labelled feature vectors that the trees are fitted on
PRECISION = 0.99

_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns, written so that a run is tried once: the same matches in linear time.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:@|[(\[{{]at[)\]}}]) ?[A-Za-z0-9-]++"
    r"(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.:A-Za-z])(?:[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,4}){3}(?![0-9])"
    r"|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:]))",
    "card": r"[0-9](?:[\x20.-]?[0-9]){8,}+",
    "phone": r"(?<![0-9+(])[+(]?[0-9][0-9\x20().-]{6,}[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+",
}
_HINTS = {
    "email": "mail|contact|write|kontakt|contacto|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|amex|master|pay|carte|tarjeta|karte",
    "phone": "phone|tel|call|mobile|fax|cell|fon|tél|móvil",
    "secret": "token|key|secret|passw|pwd|api|auth|bearer|credential",
}
#: What a text must hold before a pattern is tried on it.
_NEEDS = {
    "email": lambda t: (F.instr(t, "@") > 0) | F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at}")),
    "ip": lambda t: F.rlike(t, F.lit("[0-9A-Fa-f][.:\\[(]")),
    "card": lambda t: F.rlike(t, F.lit("[0-9][\\x20.-]?[0-9]")),
    "phone": lambda t: F.rlike(t, F.lit("[0-9]")),
    "secret": lambda t: F.rlike(t, F.lit("[A-Za-z0-9+/_-]{20}")),
}
BLOCK = 256


def _running(values: Column) -> Column:
    """Sums of all earlier elements of an array of longs, block by block to stay near linear."""

    def prefix(part: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.expr("CAST(array() AS array<bigint>)").alias("a"))
        return F.aggregate(
            part, zero, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a"))
        )

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda b: prefix(F.slice(values, b, BLOCK)))
    offsets = lambda done: prefix(F.transform(done, lambda d: d["s"]))["a"]
    moved = F.transform(
        F.arrays_zip(blocks.alias("d"), offsets(blocks).alias("o")),
        lambda z: F.transform(z["d"]["a"], lambda v: v + z["o"]),
    )
    return F.when(
        F.size(values) <= BLOCK, prefix(values)["a"]
    ).otherwise(F.flatten(moved))


def with_spans(df: DataFrame, text: str, patterns: dict[str, str], prefix: str) -> DataFrame:
    """Add ``<prefix><kind>``: arrays of (start, end, m) of the matches, in code points."""
    t = quoted(text)
    lists = {}
    staged = df
    for kind, pattern in patterns.items():
        m, p = fresh(staged, f"{prefix}{kind}_m", f"{prefix}{kind}_p")
        found = _NEEDS[kind](t)
        staged = staged.withColumn(m, F.when(found, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
        # The pieces are cut only where there is a match at all.
        staged = staged.withColumn(
            p, F.when(F.size(quoted(m)) > 0, F.transform(F.split(t, pattern, -1), lambda x: F.length(x).cast("long")))
        )
        lists[kind] = (m, p)
    sized = {}
    for kind, (m, p) in lists.items():
        (z,) = fresh(staged, f"{prefix}{kind}_z")
        steps = F.zip_with(quoted(m), quoted(p), lambda x, before: F.length(x) + F.coalesce(before, F.lit(0)))
        staged = staged.withColumn(z, F.when(quoted(p).isNotNull(), _running(steps)))
        sized[kind] = z
    empty = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint, m: string>>)")
    out = staged

    def span_of(p: str, z: str):
        def span(x: Column, i: Column) -> Column:
            start = F.get(quoted(z), i) + F.get(quoted(p), i)
            return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("m"))

        return span

    for kind, (m, p) in lists.items():
        spans = F.transform(quoted(m), span_of(p, sized[kind]))
        out = out.withColumn(f"{prefix}{kind}", F.coalesce(F.when(quoted(p).isNotNull(), spans), empty))
    return out.drop(*[c for pair in lists.values() for c in pair], *sized.values())


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets_ok(m: Column) -> Column:
    parts = F.split(F.regexp_replace(m, r"[^0-9]+", "."), r"\.")
    plain = F.transform(parts, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda x: (F.length(x) <= 3) & (F.try_to_number(x, F.lit("999")) <= 255))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substr(digits, i, F.lit(1)).cast("int") * 2) % 10
            + F.floor(F.substr(digits, i, F.lit(1)).cast("int") * 2 / 10).cast("int")
        ),
    )
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(False)


def _strict(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern stays."""
    if kind == "ip":
        return _octets_ok(m)
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add ``<prefix><kind>`` of the strict patterns, failing matches dropped."""
    found = with_spans(df, text, BASE, prefix)

    def stays(kind: str):
        return lambda s: _strict(kind, s["m"])

    for kind in BASE:
        name = f"{prefix}{kind}"
        found = found.withColumn(name, F.filter(quoted(name), stays(kind)))
    return found


FEATURES = ("kind", "digits", "letters", "marks", "plus", "sign", "valid", "variety", "hint", "left", "right")


def _features(kind: str, c: Column, text: Column) -> list[Column]:
    """Format and context of a candidate as small whole numbers."""
    m = c["m"]
    digits = _digits(m)
    before = F.lower(F.substr(text, F.greatest(c["start"] - 23, F.lit(1)).cast("int"), F.least(c["start"], F.lit(24)).cast("int")))
    after = F.substr(text, (c["end"] + 1).cast("int"), F.lit(1))
    if kind == "email":
        valid = F.rlike(m, F.lit(r"\.[A-Za-z]{2,}$"))
    elif kind == "ip":
        valid = F.rlike(m, F.lit(":")) | _octets_ok(m)
    elif kind == "card":
        valid = _luhn(digits)
    elif kind == "phone":
        valid = F.length(digits).between(9, 15)
    else:
        valid = F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]"))

    def around(x: Column) -> Column:
        return F.when((x == "") | F.rlike(x, F.lit(r"\s$")), 0).when(F.rlike(x, F.lit(r"[\"'=:(\[<]$")), 1).otherwise(2)

    whole = lambda flag: F.coalesce(flag, F.lit(False)).cast("int")
    return [
        F.lit(KINDS.index(kind)),
        F.least(F.length(digits), F.lit(20)),
        F.least(F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.lit(40)),
        F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(8)),
        whole(F.startswith(m, F.lit("+"))),
        whole(F.contains(m, F.lit("@"))),
        whole(valid),
        F.least(F.size(F.array_distinct(F.split(m, ""))), F.lit(16)),
        whole(F.rlike(before, F.lit(_HINTS[kind]))),
        around(before),
        around(F.when(F.rlike(after, F.lit(r"[.,;!?)\]]")), F.lit(" ")).otherwise(after)),
    ]


def _label(kind: str, c: Column, f: dict[str, Column]) -> Column:
    """1 and 0 for clear cases, NULL for those that are left to the trees."""
    m = c["m"]
    if kind == "email":
        return F.when((f["sign"] == 1) & ~F.contains(m, F.lit(" ")), f["valid"])
    if kind == "ip":
        return F.when(F.rlike(m, F.lit(r"^[0-9.]+$")), f["valid"])
    if kind == "card":
        return F.when(f["valid"] == 0, 0).when(~F.contains(m, F.lit(".")), 1)
    if kind == "phone":
        return F.when(f["valid"] == 0, 0).when(f["plus"] == 1, 1).when(f["hint"] == 0, 0)
    clear = (f["digits"] >= 3) & (f["variety"] >= 9)
    return F.when(~clear | (f["valid"] == 0), 0).when(f["hint"] == 1, 1)


@dataclass
class Detector:
    """Boosted trees and one threshold per generator; without trees only base spans are given."""

    model: Boosted | None
    thresholds: dict[str, float]

    def accepts(self, features: list[Column]) -> Column:
        return self.model.expression(features) if self.model else F.lit(0.0)


def _candidates(df: DataFrame, text: str, prefix: str) -> DataFrame:
    return with_spans(df, text, WIDE, prefix)


def fit_detector(docs: DataFrame, text: str = "text") -> Detector:
    """Count the labelled candidates of all documents by their features, and fit on the counts."""
    plain = docs.select(quoted(text).cast("string").alias("text"))
    found = _candidates(plain, "text", "w_")

    def row_of(kind: str):
        def row(c: Column) -> Column:
            values = _features(kind, c, F.col("text"))
            label = _label(kind, c, dict(zip(FEATURES, values))).cast("int")
            fold = F.pmod(F.xxhash64(c["m"]), F.lit(5)).cast("int")
            named = [v.cast("int").alias(n) for n, v in zip(FEATURES, values)]
            return F.struct(*named, label.alias("label"), fold.alias("fold"))

        return row

    rows = [F.transform(quoted(f"w_{kind}"), row_of(kind)) for kind in WIDE]
    cells = (
        found.select(F.explode(F.concat(*rows)).alias("c"))
        .select("c.*")
        .where(F.col("label").isNotNull())
        .groupBy(*FEATURES, "label", "fold")
        .count()
        .orderBy(F.desc("count"), *FEATURES, "label", "fold")
        .limit(MAX_CELLS)
        .collect()
    )
    table = np.array([tuple(r) for r in cells], dtype=np.int64).reshape(-1, len(FEATURES) + 3)
    x, label, fold, count = table[:, : len(FEATURES)], table[:, -3], table[:, -2], table[:, -1]
    if not len(x) or label.min() == label.max():
        return Detector(None, {k: 1.1 for k in KINDS})
    held = fold == 0
    learn = ~held if (~held).any() and len(set(label[~held].tolist())) == 2 else np.ones(len(x), bool)
    model = fit_boosted(x[learn], label[learn], count[learn])
    calibrate(model, x[held], label[held], count[held])
    probability, thresholds = model.probability(x), {}
    for i, kind in enumerate(KINDS):
        own = x[:, 0] == i
        seen = own & held if (own & held & (label == 1)).any() else own
        thresholds[kind] = threshold_for(probability[seen], label[seen], count[seen], PRECISION)
    return Detector(model, thresholds)


def find_pii(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``base`` and ``spans``: arrays of (start, kind, end), ordered.

    ``kind`` is the position in ``KINDS``; positions count code points, ends are exclusive.  Spans
    of the trees join those of the strict patterns where they meet none of these; of several that
    meet each other the most probable stays.  NULL and empty texts have none.  Columns with the
    names of outputs are replaced.
    """
    plain = docs.select(*others(docs, ("base", "spans")))
    whole, base, wide = fresh(plain, "whole", "pb_", "pw_")
    staged = plain.withColumn(whole, F.coalesce(quoted(text).cast("string"), F.lit("")))
    staged = _candidates(base_spans(staged, whole, base), whole, wide)

    def as_span(kind: str):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")
        )

    strict = F.concat(*[F.transform(quoted(f"{base}{k}"), as_span(k)) for k in BASE])
    staged = staged.withColumn("base", F.array_sort(strict))

    def score_of(kind: str):
        def score(c: Column) -> Column:
            p = detector.accepts(_features(kind, c, quoted(whole)))
            free = ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            worth = F.when(free & F.lit(detector.thresholds[kind] <= 1), p).otherwise(0.0)
            return F.struct(
                c["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                c["end"].alias("end"),
                worth.alias("p"),
            )

        return score

    def likely(kind: str):
        return lambda s: s["p"] >= detector.thresholds[kind]

    scored = [
        F.filter(F.transform(quoted(f"{wide}{kind}"), score_of(kind)), likely(kind)) for kind in WIDE
    ]
    (more,) = fresh(staged, "more")
    staged = staged.withColumn(more, F.concat(*scored))

    def best(s: Column) -> Column:
        def better(o: Column) -> Column:
            meets = (o["start"] < s["end"]) & (s["start"] < o["end"])
            ahead = (o["p"] > s["p"]) | (
                (o["p"] == s["p"]) & ((o["kind"] < s["kind"]) | ((o["kind"] == s["kind"]) & (o["start"] < s["start"])))
            )
            return meets & ahead

        return ~F.exists(quoted(more), better)

    added = F.transform(
        F.filter(quoted(more), best),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    return staged.select(
        *others(plain, ()), F.col("base"), F.array_sort(F.concat(F.col("base"), added)).alias("spans")
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def redact(found: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace every span of ``text`` by the upper-case name of its kind in brackets.

    Spans that overlap are replaced together, under the name of the first.
    """
    zero = F.struct(
        F.lit(0).cast("long").alias("end"),
        F.expr("CAST(array() AS array<struct<start: bigint, kind: int, end: bigint>>)").alias("a"),
    )

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc["a"], -1)
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        inside = (F.size(acc["a"]) > 0) & (s["start"] < acc["end"])
        kept = F.when(
            inside, F.array_append(F.slice(acc["a"], 1, F.size(acc["a"]) - 1), longer)
        ).otherwise(F.array_append(acc["a"], s))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), kept.alias("a"))

    (merged,) = fresh(found, "merged")
    staged = found.withColumn(merged, F.aggregate(quoted(spans), zero, join, lambda acc: acc["a"]))
    t, names = quoted(text), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(s: Column, i: Column) -> Column:
        last = F.coalesce(F.get(quoted(merged), i - 1)["end"], F.lit(0))
        return F.concat(F.substr(t, (last + 1).cast("int"), (s["start"] - last).cast("int")), F.get(names, s["kind"]))

    tail = F.substr(t, (F.element_at(quoted(merged), -1)["end"] + 1).cast("int"))
    changed = F.concat(F.array_join(F.transform(quoted(merged), piece), ""), tail)
    return staged.withColumn(text, F.when(F.size(quoted(merged)) > 0, changed).otherwise(t)).drop(merged)
