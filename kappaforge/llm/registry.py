"""Registered queries of the llm operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kappaforge.llm import byte_bpe, decontamination, lexical_search, license_templates, merkle_manifest, near_dedup, oracles, pii_surrogates, quality_gam, quality_rules, simhash, substring_dedup, token_counts, toxicity_pu
from kappaforge.llm.store import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret of spark.kappaforge.surrogate.key. Where none is set, as in tests, a published one that protects nothing."""
    return (spark.conf.get("spark.kappaforge.surrogate.key", None) or "published key of the registered queries").encode()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` outside passages of 50 words that a smaller doc_id has too. Nulls, ties and repeated rows are as the operator says."""
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every text of ``documents``, by phrase and by template. Nulls, ties and repeated rows are as the operator says."""
    return license_templates.scan(table(spark, sf_dir, "documents")).drop("places")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` with surrogates for personal data. Nulls, ties and repeated rows are as the operator says."""
    return pii_surrogates.surrogates(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of ``documents`` by an additive model of ``labels``. Nulls, ties and repeated rows are as the operator says."""
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text of ``documents``, and what they decode to. Nulls, ties and repeated rows are as the operator says."""
    return byte_bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every text of ``documents``. Nulls, ties and repeated rows are as the operator says."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned from positives of ``labels`` and unlabelled texts. Nulls, ties and repeated rows are as the operator says."""
    return toxicity_pu.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every row of ``documents``. Nulls, ties and repeated rows are as the operator says."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text of ``documents``. Nulls, ties and repeated rows are as the operator says."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of ``benchmark`` that texts of ``documents`` leak. Nulls, ties and repeated rows are as the operator says."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every row of ``documents`` by fingerprints. Nulls, ties and repeated rows are as the operator says."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of ``documents`` for every item of ``benchmark``. Nulls, ties and repeated rows are as the operator says."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof and drill of every row of ``documents`` against the manifest. Nulls, ties and repeated rows are as the operator says."""
    return merkle_manifest.drill(table(spark, sf_dir, "documents"))


_ALL = (
    op1_substring_dedup, op2_license_templates, op3_pii_surrogates, op4_quality_gam, op5_byte_bpe,
    op6_quality_rules, op7_toxicity_pu, op8_probminhash, op9_token_counts, op10_string_tiling,
    op11_simhash, op12_lexical_search, op13_merkle_manifest,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {"op1_substring_dedup": oracles.OP1, "op12_lexical_search": oracles.OP12, "op13_merkle_manifest": oracles.OP13}
