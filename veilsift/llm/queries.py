"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .htmltext import extracted
from .mixing import mix
from .orderminhash import fingerprinted
from .packing import packed
from .pitmanyor import scored as language_scores
from .quality import rules
from .simhash import linked
from .tokenfile import round_trip
from .toxicity import scored
from .urlfilter import judge

#: The public tokenizer file of the token queries, and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 2

#: Rules of the URL query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_toxicity": op3_toxicity,
    "op4_html_text": op4_html_text,
    "op5_mix_sources": op5_mix_sources,
    "op6_pack_documents": op6_pack_documents,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_token_files": op8_token_files,
    "op9_order_minhash": op9_order_minhash,
    "op10_url_filter": op10_url_filter,
}

OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5, 2, 1], 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS w FROM s),
r AS (SELECT *, source_size * 3 / w AS ratio, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
x AS (SELECT coalesce(arg_min(level, (ratio, -level)) FILTER (WHERE level <= ratio), 0.0) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio < water THEN (source_size * 3)::DOUBLE ELSE water * w END AS target FROM l, x),
g AS (SELECT d.source, floor(sqrt(size))::BIGINT AS root, sum(size)::BIGINT AS words FROM d GROUP BY 1, 2),
v AS (SELECT g.*, target, source_size,
             (target - 3 * coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY root DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / nullif(sum(root * words) OVER (PARTITION BY g.source ORDER BY root)::DOUBLE, 0) AS level
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, arg_max(level, root) FILTER (WHERE root > 0 AND level * root <= 3 + 1e-9) AS c FROM v GROUP BY source),
e AS (SELECT v.*, c, CASE WHEN root = 0 THEN 0.0 ELSE least(3.0::DOUBLE, coalesce(c * root, 3.0::DOUBLE)) END::DOUBLE AS times FROM v JOIN c ON v.source IS NOT DISTINCT FROM c.source),
f AS (SELECT source, root, source_size, target, times, floor(times + 1e-12::DOUBLE)::BIGINT AS whole,
             greatest(0.0::DOUBLE, target - (sum(floor(times + 1e-12::DOUBLE)::BIGINT * words) OVER (PARTITION BY source))::DOUBLE) AS rest FROM e),
p AS (SELECT d.*, source_size, target, whole, rest, times - whole AS p FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND floor(sqrt(d.size))::BIGINT = f.root),
q AS (SELECT *, CASE WHEN p > 1e-12::DOUBLE AND rest > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
o AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END)
                OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM q),
k AS (SELECT *, coalesce(upto <= rest, false) AS fits FROM o),
z AS (SELECT *, rest - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM k),
b AS (SELECT source, arg_min(rid, (abs(size - gap), q, doc_id, size, rid)) AS rid FROM z WHERE q IS NOT NULL AND NOT fits AND abs(size - gap) < gap GROUP BY source)
SELECT z.doc_id, z.size, z.source_size, z.target, (z.size * (whole + CASE WHEN fits OR b.rid IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM z LEFT JOIN b ON z.rid = b.rid
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM u),
p AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
r(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
        row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

ORACLE_SQL: dict[str, str] = {"op5_mix_sources": OP5_SQL, "op10_url_filter": OP10_SQL}
