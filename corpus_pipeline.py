"""The corpus pipeline: five stages, each of which reads what the one before has kept.

Stages: toxicity (documents predicted toxic go), language ID (documents without a language
go), exact dedup (one of equal texts stays), n-gram Jaccard join (five-word shingles, 0.8; one
document of each group stays), packing (the result: one row per packed piece).
All but the last return the columns of documents.

Defined cases, for each stage: an empty table gives no rows; extra columns, whatever their names, go through all
stages but the last; texts of any length are read whole. Null and blank texts: the toxicity stage
keeps them (its score for texts without words is below the cut unless most such examples are toxic), the language stage drops
them, as it does texts without letters. Rows that repeat an id are judged by their own texts; of rows with equal id
and text the exact stage keeps one. Of equal texts the longest original stays, ties go to the smallest id; of
similar ones the smallest id of the group stays. A row without an id is kept by the exact stage, unless its text
has an equal, and packed under a null id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwell.llm import exact_dedup, language, packing, shingle_join, toxicity
from loomwell.llm.shared import forget, new_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_first(docs, k=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("shingle_join", near_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained stages nor the tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
