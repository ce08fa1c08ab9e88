"""The corpus pipeline: filters, dedup, decontamination and encoding of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objsql.llm.byte_bpe import encode_documents
from objsql.llm.common import fresh_path
from objsql.llm.decontamination import drop_contaminated
from objsql.llm.line_dedup import dedup_lines
from objsql.llm.near_dedup import drop_near_duplicates
from objsql.llm.toxicity import fit_toxicity, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go; null and empty texts stay, repeated rows stay or go alike."""
    chain = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, chain, filter=True)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that had nothing else; n_chars follows the text.

    Of equally good lines that of the least document and line number stays. Null
    and empty texts and rows with a null id stay as they are.
    """
    dropped = "_n_dropped"
    while dropped in docs.columns:
        dropped += "_"
    out = dedup_lines(docs, count_col=dropped).where((F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col(dropped) > 0
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least id; null, empty and wordless texts and rows with a null id stay."""
    return drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null id or text stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is encoded, a null text as an empty one; the ids come out packed."""
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", encode_stage),
]

#: Fitted models and similarity groups can't be put as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
