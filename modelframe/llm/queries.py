"""The corpus operators applied to whole tables with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modelframe.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.simhash import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"), width=3, radius=2)


def op2_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.context_tree import scored

    return scored(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.langid import identified

    return identified(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents"), shards=40)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.personal_data import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.bpe_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.vector_tree import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from modelframe.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_near_dedup,
        op2_context_tree_score,
        op3_html_text,
        op4_language_id,
        op5_sharding,
        op6_personal_data,
        op7_token_counts,
        op8_nearest_vectors,
        op9_decontamination,
        op10_best_fit_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
