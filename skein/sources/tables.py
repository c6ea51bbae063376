"""Readers for the parquet tables. Everything goes through Spark's own readers, so any path Spark can open works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table under ``sf_dir``, lazily, with columns pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
