"""The operators over the whole test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, decontaminate, exact_dedup, licenses, line_dedup, quality, simhash, substring_dedup, token_counts, toxicity

BYTE_BPE, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def tokenizer(name: str = BYTE_BPE) -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(_t(spark, sf_dir, "documents"), tokenizer(), with_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_t(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_t(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_t(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_t(spark, sf_dir, "documents"), tokenizer(BYTE_RANKS))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_t(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_toxicity, op3_substring_dedup, op4_decontamination, op5_quality, op6_line_dedup, op7_licenses, op8_simhash, op9_token_counts, op10_exact_dedup)}

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLE = {
    "op3_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id) AS low FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM h JOIN f USING (k) WHERE low < doc_id),
a AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w),
r AS (SELECT a.doc_id, count(*) AS n, count(c.p) AS gone, string_agg(word, ' ' ORDER BY a.p) FILTER (WHERE c.p IS NULL) AS kept
      FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p GROUP BY a.doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)""",
    "op7_licenses": licenses.oracle(),
    "op10_exact_dedup": rf"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS d FROM documents),
g AS (SELECT d, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d AS text_sha256 FROM n JOIN g USING (d)""",
}
