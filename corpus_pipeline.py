"""The training-data pipeline: quality, near-duplicates, benchmark leaks, mixture, token ids.

Each stage takes the documents its predecessor kept, as reread from Parquet; all but the last
return the columns of ``documents``.  No SQL expresses it whole: the sampling of near-duplicate
candidates and the tokenizer have no counterpart there (``ORACLE_SQL`` is None; see tests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.llm import decontamination, mixing, near_dedup, quality_rules, token_ids
from ledgerlark.llm.storage import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = token_ids.stored(docs, public_tokenizers.path("word_bpe_49k.json"))
    return held.select(F.col("key").alias("doc_id"), "occurrence", "start", "n_tokens", token_ids.ids_crc32("payload").alias("ids_crc32"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark leaks", benchmark_leaks), ("mixture", mixture), ("token ids", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
