"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from objsql.llm.byte_bpe import encode_documents
from objsql.llm.common import fresh_path, read
from objsql.llm.decontamination import decontamination
from objsql.llm.line_dedup import dedup_lines
from objsql.llm.near_dedup import near_duplicates
from objsql.llm.ngram_lm import lm_scores
from objsql.llm.pii import replace_pii
from objsql.llm.quality import quality_filter
from objsql.llm.token_counts import token_counts
from objsql.llm.toxicity import fit_toxicity, toxicity
from objsql.llm.warc import archive_roundtrip


#: A deployment passes its own key; the driver's runs need one that doesn't change.
PII_KEY = "objsql-demo-key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(read(spark, sf_dir, "documents"), PII_KEY, count_col="n_entities").select("doc_id", "n_entities", "text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chain = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return toxicity(docs, chain, keep=("doc_id",))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_filter(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_roundtrip(read(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f
  FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         (CAST('0x' || substr(d, CAST(1 + 10 * (j // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (j % 8) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f < page_id THEN f END AS refers_to
FROM p
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_dropped")


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_toxicity, op3_near_dedup, op4_decontamination, op5_token_counts, op6_quality_rules, op7_warc, op8_byte_bpe, op9_lm_scoring, op10_line_dedup)}
ORACLE_SQL: dict[str, str] = {"op7_warc": OP7_SQL}
