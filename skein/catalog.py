"""The registered queries of the library and their SQL, gathered from the modules of ``plans``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import duplicates, evidence, ingesting, measures, parsing, relational, selecting, texts, validating, vectors

MODULES = (relational, texts, vectors, measures, duplicates, evidence, ingesting, parsing, selecting, validating)
FLAGSHIP = "j5_topk_cosine"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
