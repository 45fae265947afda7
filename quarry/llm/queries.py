"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, licenses, mixing, packing, quality, rules, suffix, topk, urls, warc
from quarry.llm.common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).drop("crc")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).drop("bound")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8_mixing SQL can express: sizes, sizes of sources and targets, to a thousandth."""
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9_quality_rules SQL can express: the counts and the base rule."""
    return op9_quality_rules(spark, sf_dir).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = [op1_topk, op2_quality_classifier, op3_suffix_dedup, op4_jaccard_join, op5_best_fit_packing, op6_url_filter, op7_license_scan, op8_mixing, op9_quality_rules, op10_warc, mixing_targets, quality_counts]
    return {f.__name__: f for f in out}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5"""

OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id WHERE c.r <= l.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.r, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM c GROUP BY 1) m USING (doc_id)"""


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{h + p}', '{v}')" for h, p, v in urls.RULES)
_TWO_SQL = ", ".join(f"'{x}'" for x in urls.TWO_LABEL_SUFFIXES)


def _strength_sql(level: str) -> str:
    """The prior's strength over members with two outcomes or more, by moments."""
    return f"""select coalesce(least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * r, 1e-6) - 1, 1.0), 1000.0), 10.0) as k
  from (select avg(bad / n) as m, var_samp(bad / n) as v, avg(1 / n) as r from {level} where n >= 2)"""


OP6_SQL = f"""
WITH u AS (
  SELECT page_id, html, contains(coalesce(url, ''), '://') AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
p AS (
  SELECT page_id, html, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
t(rhost, rpath, rule, ruled) AS (VALUES {_RULES_SQL}),
f AS (
  SELECT p.*, (SELECT arg_max({{'rule': rule, 'ruled': ruled}}, length(rule)) FROM t WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS x FROM p),
j AS (
  SELECT page_id, host, path, x.rule AS rule, x.ruled AS ruled,
    coalesce(x.ruled = 'block', length(html) < 200 OR 50 * (length(html) - length(translate(html, '*$%#|~^', ''))) > length(html)) AS bad FROM f),
b AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare, count(bad)::DOUBLE AS n, coalesce(sum(bad::INTEGER), 0)::DOUBLE AS bad FROM j GROUP BY host),
l AS (SELECT *, string_split(bare, '.') AS s, regexp_matches(bare, '^([0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}|\\[.*\\])$') AS address FROM b),
hosts AS (
  SELECT host, n, bad, CASE WHEN address THEN host ELSE array_to_string(s[-(CASE WHEN two THEN 3 ELSE 2 END):], '.') END AS domain,
    CASE WHEN address THEN '{urls.ADDRESS}' ELSE array_to_string(s[-(CASE WHEN two THEN 2 ELSE 1 END):], '.') END AS suffix
  FROM (SELECT *, array_to_string(s[-2:], '.') IN ({_TWO_SQL}) AS two FROM l)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
k0 AS ({_strength_sql("hosts")}), k1 AS ({_strength_sql("domains")}), k2 AS ({_strength_sql("suffixes")}),
prior AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
sm AS (SELECT suffix, (bad + k2.k * m) / (n + k2.k) AS m FROM suffixes, k2, prior),
dm AS (SELECT domain, d.suffix, (bad + k1.k * sm.m) / (n + k1.k) AS m FROM domains d JOIN sm USING (suffix), k1),
post AS (SELECT host, bad + k0.k * m AS alpha, n - bad + k0.k * (1 - m) AS beta FROM hosts JOIN dm USING (domain, suffix), k0),
bound AS (SELECT host, alpha / (alpha + beta) - 2 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS bound FROM post)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN bound USING (host)"""

OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_transform(range(20), lambda i: ('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::INTEGER) || [0] AS b, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((b[i * 5 // 8 + 1] << 8) | b[i * 5 // 8 + 2]) >> (11 - i * 5 % 8)) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM b"""

_WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

MIXING_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS_SQL})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS i, sum(source_size) OVER () AS total FROM s),
w(i, rest, weights) AS (
  SELECT 0::BIGINT, (SELECT sum(source_size) FROM s)::DOUBLE, (SELECT sum(weight) FROM s)
  UNION ALL
  SELECT r.i, w.rest - 3 * r.source_size, w.weights - r.weight FROM w JOIN r ON r.i = w.i + 1 WHERE 3 * r.source_size / r.weight <= w.rest / w.weights),
e AS (SELECT max(i) AS i, arg_max(rest, i) AS rest, arg_max(weights, i) AS weights FROM w)
SELECT doc_id, size, source_size, round(CASE WHEN r.i <= e.i THEN 3.0::DOUBLE * source_size ELSE r.weight * (e.rest / e.weights) END, 3) AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, e"""

COUNTS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS_SQL} AS w FROM documents),
g AS (SELECT k, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
v AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i:i+7]) AS n FROM g),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM v, range(8) t(j) WHERE n > 1 GROUP BY k),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN rep USING (k) LEFT JOIN dup USING (k)"""


def oracle_sql() -> dict[str, str]:
    out = {"op1_topk": OP1_SQL, "op4_jaccard_join": OP4_SQL, "op6_url_filter": OP6_SQL, "op10_warc": OP10_SQL, "mixing_targets": MIXING_SQL, "quality_counts": COUNTS_SQL}
    return {k: v.strip() for k, v in out.items()}
