"""Configuration files and atomic writes, by any path that Spark can open."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_config(spark: SparkSession, path: str, required: Iterable[str] = ()) -> dict:
    """One JSON (or, where PyYAML is installed, YAML) file as a mapping that has all required fields."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"expected one file at {path}")
    text = rows[0][0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("YAML files need PyYAML") from missing
        try:
            value = yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ValueError(f"invalid YAML in {path}: {error}") from error
    else:
        try:
            value = json.loads(text)
        except json.JSONDecodeError as error:
            raise ValueError(f"invalid JSON in {path}: {error}") from error
    if not isinstance(value, dict):
        raise ValueError(f"{path} must be a mapping")
    if missing := sorted(set(required) - value.keys()):
        raise ValueError(f"{path} misses {', '.join(missing)}")
    return value


def missing_fields(config: Column, required: Iterable[str]) -> Column:
    """Of a JSON object in a column, the required fields that it does not have; null if it is no object."""
    keys = F.json_object_keys(config)
    return F.when(keys.isNotNull(), F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys)))


def write_atomic(df: DataFrame, path: str, file_format: str = "json") -> None:
    """Replace what is at ``path`` by ``df``: readers see the old files or all of the new ones. The rows are written
    beside it and take its name when they are complete."""
    spark = df.sparkSession
    fresh, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.format(file_format).save(fresh)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = files.exists(at(path))
    if had and not files.rename(at(path), at(old)):
        raise OSError(f"{path} cannot be moved away")
    if not files.rename(at(fresh), at(path)):
        if had:
            files.rename(at(old), at(path))
        raise OSError(f"{fresh} cannot become {path}")
    if had:
        files.delete(at(old), True)
