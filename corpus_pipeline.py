"""From raw documents to token ids: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaforge.llm import byte_bpe, decontamination, near_dedup, pii_surrogates, quality_rules
from kappaforge.llm.registry import surrogate_key, tokenizer_path
from kappaforge.llm.store import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the classifier learns from ``docs`` with the table labels."""
    return quality_rules.passing(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies."""
    return near_dedup.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the table benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data; n_chars follows the text."""
    done = pii_surrogates.rewrite(docs, surrogate_key(spark))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    return byte_bpe.digest(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality_rules", quality), ("probminhash", near), ("string_tiling", decontaminate), ("pii_surrogates", pii), ("byte_bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
