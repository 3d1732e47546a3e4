"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, licenses, packing, secrets, sharding, simhash, substrings, toxicity, urls, winnowing

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_read(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"), urls.rule_table(spark, urls.BASE_RULES))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(_read(spark, sf_dir, "documents"), digest=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_licenses, op4_winnowing, op5_packing, op6_secrets, op7_toxicity, op8_sharding, op9_urls, op10_substrings, pipeline)}


#: SQL has no way to fill the lookup table turn by turn, so it gets the filled one, two hex digits a slot.
SHARDING = """
WITH placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT doc_id, slot, ('0x' || substr('{table}', CAST(2 * slot + 1 AS INTEGER), 2))::INTEGER AS shard FROM placed
"""

URLS = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
rests AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fitting AS (
  SELECT n, page_id, host, path, rule_host || rule_path AS rule, verdict FROM parts
  LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC NULLS LAST, rule) = 1
"""

SUBSTRINGS = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
words AS (SELECT n, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs),
windows AS (
  SELECT n, doc_id, place, word, count(*) OVER span AS size, md5(string_agg(word, ' ') OVER span) AS hash FROM words
  WINDOW span AS (PARTITION BY n ORDER BY place ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT hash, min(doc_id) AS low FROM windows WHERE size = 50 GROUP BY hash),
judged AS (
  SELECT n, place, word, max(CASE WHEN size = 50 AND low < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN firsts USING (hash)),
kept AS (SELECT n, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE gone = 0) AS rest FROM judged GROUP BY n)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_sharding": SHARDING.format(slots=sharding.SLOTS, table=bytes(sharding.fill_table(sharding.SHARDS)).hex()),
        "op9_urls": URLS.format(rules=", ".join(str(r) for r in urls.BASE_RULES)),
        "op10_substrings": SUBSTRINGS,
    }
