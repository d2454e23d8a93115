"""URL rules, and block decisions that follow redirects and canonical links.

A rule is a host and a path prefix; it fits its host and all subdomains, and the longest fitting
rule decides.  URLs that no rule fits take the decision of their alias class: URLs that differ only
in scheme, fragment, default port, index page, trailing slash or tracking parameters are one, and
redirects (a table, or ``<meta http-equiv=refresh>``) and ``<link rel=canonical>`` join such classes
into connected components.  In a component an explicit allow goes before any block; without either
a URL is allowed.

Only columns that a decision needs are shuffled, never pages.  A class is reduced to two flags
before the shuffle, and only classes with a decision are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift.llm.common import fresh, lower_ascii, others, quoted
from trialsift.llm.components import connected_components
from trialsift.session import cut_lineage

#: (verdict, host, path); a rule list is part of the plan, so it should stay within some hundreds.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; NULL without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or NULL."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    # Of rules of equal length the first given wins, so it must come last here.
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found).otherwise(out)
    return out


def alias_key(url: Column) -> Column:
    """What all spellings of a page's address share; NULL without a host."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/(index\.html?)?$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.lit("?"), F.array_join(kept, "&")))


def linked_url(html: Column, url: Column) -> Column:
    """Array of the canonical and the refresh target of a page, made absolute."""

    def target(tag: str, attribute: str) -> Column:
        found = F.regexp_extract(F.regexp_extract(html, tag, 0), attribute, 1)
        return F.when(F.rlike(html, F.lit(r"(?i)canonical|http-equiv")), found)

    canonical = target(
        r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    )
    refresh = target(
        r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?i)\burl\s*=\s*['\"]?([^\"'\s>]+)"
    )
    root = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^(.*?://[^/?#]*(?:/[^/?#]*)*/)", 1)

    def absolute(x: Column) -> Column:
        return (
            F.when(F.contains(x, F.lit("://")), x)
            .when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x))
            .when(F.startswith(x, F.lit("/")), F.concat(root, x))
            .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), x))
        )

    return F.transform(F.filter(F.array(canonical, refresh), lambda x: x.isNotNull() & (x != "")), absolute)


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    html: str | None = "html",
    redirects: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """All columns of ``pages`` and ``host``, ``path``, ``rule``, ``verdict``.

    ``redirects`` has columns ``from_url`` and ``to_url``.  A NULL URL or one without ``://`` has an
    empty host and path, no rule, is an alias of nothing and is allowed.  Repeated rows are judged
    each.  Columns with the names of outputs are replaced.
    """
    outputs = ("host", "path", "rule", "verdict")
    plain = pages.select(*others(pages, outputs))
    own, key, node, part, decided, to = fresh(plain, "own", "key", "node", "part", "decided", "to")
    address = quoted(url).cast("string")
    parsed = plain.select("*", host_of(address).alias("host"), path_of(address).alias("path"))
    parsed = parsed.select(
        "*",
        rule_for(F.col("host"), F.col("path"), rules).alias(own),
        F.md5(alias_key(address)).alias(key),
    )
    edges = []
    if html is not None:
        targets = plain.select(address.alias("u"), F.explode(linked_url(quoted(html), address)).alias("v"))
        edges.append(targets)
    if redirects is not None:
        edges.append(redirects.select(F.col("from_url").alias("u"), F.col("to_url").alias("v")))
    if edges:
        joined = edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])
        keyed = joined.select(F.md5(alias_key(F.col("u"))).alias("a"), F.md5(alias_key(F.col("v"))).alias("b"))
        found = connected_components(keyed.where(F.col("a").isNotNull() & F.col("b").isNotNull()), "a", "b")
        components = cut_lineage(found.select(F.col("node").alias(node), F.col("component").alias(part)))
        parsed = parsed.join(components, quoted(key) == quoted(node), "left")
        parsed = parsed.withColumn(part, F.coalesce(quoted(part), quoted(key))).drop(node)
    else:
        parsed = parsed.withColumn(part, quoted(key))
    verdicts = parsed.where(quoted(part).isNotNull() & quoted(own).isNotNull()).select(
        quoted(part).alias(to), (quoted(own)["verdict"] == "allow").alias(decided)
    )
    # An explicit allow goes before any block.
    classes = verdicts.groupBy(to).agg(F.max(decided).alias(decided)).where(~quoted(decided))
    judged = parsed.join(classes, quoted(part) == quoted(to), "left")
    inherited = F.when(quoted(decided) == False, "block").otherwise("allow")  # noqa: E712
    return judged.select(
        *others(plain, ()),
        "host",
        "path",
        quoted(own)["rule"].alias("rule"),
        F.coalesce(quoted(own)["verdict"], inherited).alias("verdict"),
    )
