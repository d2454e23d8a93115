"""Registered queries of this package: the operators with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.llm.bpe import bpe_encode
from trialsift.llm.centroids import cluster
from trialsift.llm.common import table
from trialsift.llm.filter_audit import audit_filters
from trialsift.llm.minhash import near_duplicates
from trialsift.llm.mixing import plan_mix
from trialsift.llm.packing import encode_pieces, pack_pieces
from trialsift.llm.passages import repeated_passages
from trialsift.llm.pii import BASE, KINDS, find_pii, fit_detector, spans_text
from trialsift.llm.pivots import top_k
from trialsift.llm.quality import fit, judge, measure
from trialsift.llm.sharding import assign_shards
from trialsift.llm.token_files import read_token_files, write_token_files
from trialsift.llm.tokenizer_files import BYTE_BPE, WORD_BPE
from trialsift.llm.urls import judge_urls
from trialsift.session import cut_lineage, scratch_path


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in forty shards; digests are those of the texts that the shards hold."""
    placed = assign_shards(table(spark, sf_dir, "documents"), 40)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and verdict of every document; texts are read once here."""
    docs = table(spark, sf_dir, "documents")
    measured = cut_lineage(measure(docs).select("doc_id", "lang", "source", "stats"))
    judged = judge(measured, fit(measured))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[F.col(f"stats.{c}").alias(c) for c in counts], "base_failed", "kept", "distance"
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fit_detector(docs))
    kinds = F.transform("base", lambda s: s["kind"])

    def count(kind: str):
        own = F.filter(kinds, lambda k: k == KINDS.index(kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that documents share."""
    return repeated_passages(table(spark, sf_dir, "documents"), min_words=50)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the token files."""
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, WORD_BPE(), end=2)
    return read_token_files(spark, path).select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document."""
    coded = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE())
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


# A vector takes no part if a component is NULL, NaN or infinite.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page, by the rules or by its aliases."""
    judged = judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


# Components by reachability over the canonical and refresh links between alias classes.
OP8_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS tail FROM pages),
p AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT page_id, url, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY page_id, url),
links AS (
  SELECT url AS a, unnest([
    CASE WHEN regexp_matches(html, '(?i)canonical|http-equiv') THEN regexp_extract(regexp_extract(html, '(?i)<link[^>]*rel\s*=\s*["'']?canonical[^>]*>', 0), '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1) END,
    CASE WHEN regexp_matches(html, '(?i)canonical|http-equiv') THEN regexp_extract(regexp_extract(html, '(?i)<meta[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>', 0), '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) END]) AS x
  FROM p),
ends AS (
  SELECT a, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN 'http:' || x
    WHEN starts_with(x, '/') THEN regexp_extract(a, '^(.*?://[^/?#]*)', 1) || x
    ELSE coalesce(nullif(regexp_extract(a, '^(.*?://[^/?#]*(?:/[^/?#]*)*/)', 1), ''), regexp_extract(a, '^(.*?://[^/?#]*)', 1) || '/') || x END AS b
  FROM links WHERE x IS NOT NULL AND x <> ''),
urls AS (SELECT url FROM p UNION SELECT b FROM ends),
keyed AS (
  SELECT url, CASE WHEN host <> '' THEN host || regexp_replace(coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), ''), '/(index\.html?)?$', '') || '?'
    || array_to_string(list_filter(string_split(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)')), '&') END AS key
  FROM (SELECT url, substr(url, instr(url, '://') + 3) AS tail,
      regexp_replace(translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '') AS host
    FROM urls WHERE instr(url, '://') > 0)),
edges AS (
  SELECT DISTINCT k.key AS a, l.key AS b FROM ends JOIN keyed k ON k.url = a JOIN keyed l ON l.url = b WHERE k.key <> l.key),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
part AS (SELECT a AS key, min(b) AS component FROM reach GROUP BY a),
own AS (
  SELECT p.page_id, p.url, p.host, p.path, fit.rule, fit.verdict, coalesce(part.component, keyed.key) AS c
  FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND fit.url = p.url
    LEFT JOIN keyed ON keyed.url = p.url LEFT JOIN part ON part.key = keyed.key),
classes AS (SELECT c, bool_or(verdict = 'allow') AS allowed FROM own WHERE verdict IS NOT NULL AND c IS NOT NULL GROUP BY c)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN allowed = false THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN classes ON own.c = classes.c
"""


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    planned = plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


# Sources are capped one after another by weight per word; the first that is not capped tells the
# share of a unit of weight for itself and all after it.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('0:' || doc_id), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u,
    coalesce(greatest(0.1e0, length(regexp_replace(text, '[#*$%&|<>@=_~^{}\[\]\\\x00-\x1F]', '', 'g'))
      / CAST(greatest(length(text), 1) AS DOUBLE)), 0.1e0) AS w
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words,
    CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, CASE WHEN words > 0 THEN weight ELSE 0e0 END AS real,
    CAST(sum(words) OVER () AS DOUBLE) AS total,
    row_number() OVER (ORDER BY CASE WHEN words > 0 THEN weight / words END DESC NULLS LAST, source NULLS LAST) AS k
  FROM s),
o AS (
  SELECT *, sum(real) OVER () - coalesce(sum(real) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS open,
    total - 3 * coalesce(sum(words) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM r),
v AS (SELECT *, open > 0 AND real > 0 AND remaining / nullif(open, 0) * real > 3 * words AS over FROM o),
f AS (SELECT remaining / open AS unit FROM v WHERE NOT over AND real > 0 ORDER BY k LIMIT 1),
t AS (
  SELECT source, words AS source_size,
    CASE WHEN real = 0 THEN 0e0 WHEN over THEN CAST(3 * words AS DOUBLE) ELSE (SELECT unit FROM f) * real END AS target
  FROM v),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE
    WHEN epochs < 3 AND before + size / 2e0 < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter removes in every order, per source."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Counts per part and set of failures meet every order and step.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed
  FROM w LEFT JOIN m ON w.doc_id = m.doc_id),
c AS MATERIALIZED (SELECT part, failed, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x)
    JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS MATERIALIZED (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before
  FROM o, range(1, 6) r(step)),
g AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN failed & CAST(before + own AS INTEGER) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & CAST(before AS INTEGER) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & CAST(before AS INTEGER) = 0 THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN failed & own > 0 AND failed & CAST(before AS INTEGER) = 0 THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of all sound vectors after five rounds."""
    return cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def _lloyd_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds, one after another, with exact integers."""
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS INTEGER) AS k, e
  FROM v ORDER BY sha256('2:' || vec_id) NULLS LAST, e LIMIT {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, any_value(v.e) AS e, any_value(vec_id) AS vec_id,
    min({{'d': CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'k': k}}) AS best
  FROM v, c{i} c GROUP BY r)""")
        if i < rounds:
            parts.append(f"""
m{i} AS (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM (
    SELECT best.k AS k, i, sum(e[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY best.k, i) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)""")
    parts.append("")
    body = ",".join(parts).rstrip(",")
    return body + f"""
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = best.k
"""


OP12_SQL = _lloyd_sql(40, 5)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; digests are taken before pieces travel."""
    pieces = cut_lineage(
        encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE(), cap=1024, end=2)
    )
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(digests, cap=1024)


#: name: (query, equivalent SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_shards": (op1_shards, None),
    "op2_quality": (op2_quality, None),
    "op3_pii": (op3_pii, None),
    "op4_passages": (op4_passages, None),
    "op5_tokens": (op5_tokens, None),
    "op6_bpe": (op6_bpe, None),
    "op7_pivots": (op7_pivots, OP7_SQL),
    "op8_urls": (op8_urls, OP8_SQL),
    "op9_minhash": (op9_minhash, None),
    "op10_mix": (op10_mix, OP10_SQL),
    "op11_filters": (op11_filters, OP11_SQL),
    "op12_centroids": (op12_centroids, OP12_SQL),
    "op13_packing": (op13_packing, None),
}
