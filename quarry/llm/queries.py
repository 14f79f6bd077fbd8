"""Registered queries of the subpackage: thin digests over the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import html_text, jaccard_join, mixing, near_vectors, packing, prefix_trie, quality, secret_ledger, suffix_dedup, token_files, toxicity, url_rules, vector_codes
from quarry.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=4096, end_id=2)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(table(spark, sf_dir, "documents"), end_id=1)
    return token_files.read_tokens(spark, path, with_ids=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200, with_bytes=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents")).drop("node")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "source", "tokens", *[f"p_{d}" for d in mixing.DOMAINS], "rate", "copies")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.Ledger(spark).scan(table(spark, sf_dir, "documents"), keys=["doc_id"])
    return secret_ledger.digests(found)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))[0].select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"))[0]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_near_vectors": op4_near_vectors,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_rules": op8_url_rules,
    "op9_jaccard": op9_jaccard,
    "op10_mixing": op10_mixing,
    "op11_secrets": op11_secrets,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}


def _url_sql() -> str:
    """The verdicts by plain string functions for the explicit rules, and the patterns as they are."""
    rules = sorted(((len(r), r, v) for v, r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))), reverse=True)
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    names = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r, _ in rules)
    verdicts = " ".join(f"WHEN {fits(r)} THEN '{v}'" for _, r, v in rules)
    blocks = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in url_rules.PATTERNS)
    return f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), v AS (
  SELECT page_id,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
)
SELECT page_id, host, path, CASE {names} END AS rule,
  CASE {verdicts} WHEN {blocks} THEN 'block' ELSE 'allow' END AS verdict
FROM v"""


SQL: dict[str, str] = {"op8_url_rules": _url_sql()}
