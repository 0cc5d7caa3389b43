"""Queries over the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import bpe, embedding_dedup, exact_dedup, host_rules, html_text, language, lexical_search, packing, quality, shards, shingle_join, token_alignment, toxicity
from loomwell.llm.shared import new_folder
from loomwell.sources.tables import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, in four arrivals, as read from the shards of the version committed last.

    The store is this query's own, so nobody reads its older versions and they aren't kept.
    """
    store = shards.shard_corpus(table(spark, sf_dir, "documents"), new_folder(spark, "shards"), arrivals=4, keep_seconds=0)
    return shards.digests(store.read())


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's ``source`` is its host."""
    verdicts = host_rules.host_verdicts(table(spark, sf_dir, "documents"), F.col("source"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_alignment.align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_html_text": op3_html_text,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_shards": op5_shards,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_language": op7_language,
        "op8_toxicity": op8_toxicity,
        "op9_packing": op9_packing,
        "op10_shingle_join": op10_shingle_join,
        "op11_host_rules": op11_host_rules,
        "op12_lexical_search": op12_lexical_search,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op5_shards": shards.ORACLE, "op11_host_rules": host_rules.ORACLE, "op12_lexical_search": lexical_search.ORACLE}
