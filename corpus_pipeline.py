"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.llm import compactwindows, orderminhash, packing, pii, quality
from skein.sources.scratch import delete, scope, scratch_folder
from skein.sources.tables import table

STAGES = [
    ("quality rules", quality.stage),
    ("near-duplicate documents", orderminhash.stage),
    ("repeated passages", compactwindows.stage),
    ("personal data", pii.stage),
    ("packing", packing.stage),
]
#: Several stages are beyond SQL (order min-hashing, compact windows, differencing): tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What lies between two of them is written to the shared folder of spark.checkpoint.dir; a
    stage's own tables, and its input, are deleted when its output has been written. The last input stays for whoever
    reads the result: ``skein.sources.scratch.release`` deletes it."""
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
