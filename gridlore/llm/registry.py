"""The llm queries of the registry, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, media, mixing, quality, simhash, token_counts, token_files, toxicity, url_filter
from .common import read_table

#: Fixed rules of the URL query: host, path, verdict.
URL_RULES = (
    url_filter.prefix_rule("com", "/en/", "block"),
    url_filter.prefix_rule("example.com", "/en/7", "allow"),
    url_filter.prefix_rule("net", "/de/", "allow"),
    url_filter.prefix_rule("example.net", "/de/8", "block"),
    url_filter.prefix_rule("org", "/es/", "block"),
)


#: The domains of the mixing queries: which sources belong to which; others are "other".
DOMAINS = {
    "web": [f"src{k}" for k in range(10)],
    "books": [f"src{k}" for k in range(10, 15)],
    "reference": [f"src{k}" for k in range(15, 18)],
    "forum": [f"src{k}" for k in range(18, 20)],
}
#: Target weights of domains and of languages in each of them; sources weigh their tokens to the power 0.8.
DOMAIN_WEIGHTS = {"web": 0.45, "books": 0.25, "reference": 0.2, "forum": 0.08, "other": 0.02}
LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
#: By path in the tree.
TARGET_WEIGHTS = {(d,): w for d, w in DOMAIN_WEIGHTS.items()} | {(d, k): w for d in DOMAIN_WEIGHTS for k, w in LANGUAGE_WEIGHTS.items()}


def mixture() -> dict:
    """Options of the production mix: one and a half times the corpus's tokens, no document more than four times."""
    return {"levels": mixing.grouped_sources(DOMAINS), "corpus_epochs": 1.5, "max_epochs": 4, "weights": TARGET_WEIGHTS}


def tokenizer(name: str) -> str:
    """Where a public vocabulary lies; the files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), **mixture())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"), with_media=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_quality, op2_mixing, op3_bpe, op4_exact_dedup, op5_simhash, op6_media, op7_toxicity, op8_token_files, op9_url_filter, op10_token_counts)
    return {f.__name__: f for f in made}


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id ASC NULLS LAST
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, keep_id IS NOT DISTINCT FROM doc_id AS kept, text_sha256 FROM r
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')

), named(n, label) AS (VALUES ('casino', 'casino'), ('free-bets', 'bets'), ('cheap-pills', 'pills'), ('spam-farm', 'spam')
), fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT page_id, host, path FROM u) AS u JOIN rules
    ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  GROUP BY page_id
), own AS (
  SELECT page_id, min(label) AS label
  FROM (SELECT DISTINCT page_id, host FROM u) AS u JOIN named
    ON regexp_matches(u.host, '(^|[^a-z0-9_])' || n || '([^a-z0-9_]|$)')
  GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, fit.rule,
       coalesce(fit.v, CASE WHEN own.label IS NOT NULL THEN 'block' END, 'allow') AS verdict, own.label AS pattern_rule
FROM u LEFT JOIN fit USING (page_id) LEFT JOIN own USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op9_url_filter": OP9_SQL}
