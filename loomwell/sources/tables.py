"""Parquet table access used by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open one table of a data folder; the folder may be any URI that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
