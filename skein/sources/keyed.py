"""A table of one row a key on shared storage that batches are merged into.

Rows lie in buckets by a hash of their key, each a folder of Parquet files. A manifest names the folder of each bucket
and, for each writer, its last batch. A batch writes new folders for the buckets that it touches and then the next
manifest, which takes its name by one rename: readers see the table before the batch or after it, and a batch that ends
half-way leaves folders that no manifest names. Two writers that start from one manifest cannot both rename: the second
gets an error and may try again. ``vacuum`` deletes what the newest manifests do not name.

Defined results. Batches of a writer are numbered in rising order; one that is not above the last is a repetition and
changes nothing. Of the rows of one key in a batch the greatest by the order columns stays, then by all other columns.
Rows whose key has a null in it are an error. An empty batch only takes its number. Columns are those of the table, by
name; others are an error.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class KeyedTable:
    """``buckets`` is fixed when the table is made: choose it for its full size, about a gigabyte a bucket. A bucket is
    written by ``tasks`` tasks at most."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._configuration)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], buckets: int = 64, tasks: int = 8) -> KeyedTable:
        """An empty table; one that is there already is an error."""
        if missing := [k for k in key if k not in schema.names]:
            raise ValueError(f"the schema lacks the key columns {missing}")
        if BUCKET in schema.names:
            raise ValueError(f"{BUCKET} is the name of a column of the table's own")
        made = cls(spark, path)
        made._commit({"version": 0, "schema": schema.json(), "key": list(key), "buckets": buckets, "tasks": tasks, "folders": {}, "batches": {}})
        return made

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        manifests = self._at("manifests")
        if not self._files.exists(manifests):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._files.listStatus(manifests) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.path}")
        number = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        """The manifest takes its name by one rename, which fails if another writer has taken it."""
        fresh, name = self._at(f"manifests/{uuid.uuid4().hex}.tmp"), self._at(f"manifests/{manifest['version']:012d}.json")
        out = self._files.create(fresh, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(fresh.toUri(), self._configuration)
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(fresh, name, none)
        except Exception as error:
            self._files.delete(fresh, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was taken by another writer") from error

    def _folders(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        names = [f"{self.path}/data/{f}" for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, as of a version that ``vacuum`` has not deleted."""
        return self._folders(self.manifest(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys: only buckets that hold some are read."""
        manifest = self.manifest()
        wanted = keys.select(*manifest["key"]).distinct()
        touched = [r[0] for r in wanted.select(_bucket(manifest)).distinct().collect()]
        return self._folders(manifest, touched).join(wanted, manifest["key"], "left_semi")

    def merge(self, batch: DataFrame, writer: str, number: int, order: Sequence[str | Column] = (), keep: str = "new") -> bool:
        """Rows of the batch take the place of those of their key (``keep`` "new") or give way to them ("old": only keys
        that the table lacks are added). Returns whether the batch changed the table; False for a repetition."""
        if keep not in ("new", "old"):
            raise ValueError('keep is "new" or "old"')
        manifest = self.manifest()
        if number <= manifest["batches"].get(writer, number - 1):
            return False
        names, key = StructType.fromJson(json.loads(manifest["schema"])).names, manifest["key"]
        if sorted(batch.columns) != sorted(names):
            raise ValueError(f"a batch has the columns {names}, not {batch.columns}")
        missing = functools.reduce(operator.or_, [F.col(k).isNull() for k in key])
        checked = batch.select(*[F.when(missing, F.raise_error(F.lit("a key has a null"))).otherwise(F.col(c)).alias(c) if c in key else c for c in names], F.struct(*order, *names).alias("_order"))
        fresh = checked.groupBy(*key).agg(F.max_by(F.struct(*names), "_order").alias("_row")).select("_row.*")
        staged = f"{self.path}/data/staged-{uuid.uuid4().hex}"
        fresh.withColumn(BUCKET, _bucket(manifest)).write.parquet(staged)
        fresh = self.spark.read.parquet(staged)
        # At most as many as the table has buckets.
        touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
        folders = dict(manifest["folders"])
        if touched:
            old, new = self._folders(manifest, touched), fresh.select(*names)
            merged = old.join(new, key, "left_anti").unionByName(new) if keep == "new" else new.join(old, key, "left_anti").unionByName(old)
            place = f"{manifest['version'] + 1}-{uuid.uuid4().hex}"
            part = F.pmod(F.xxhash64(F.lit(1), *key), F.lit(manifest["tasks"]))
            merged.withColumn(BUCKET, _bucket(manifest)).repartition(BUCKET, part).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{place}")
            folders |= {str(b): f"{place}/{BUCKET}={b}" for b in touched}
        self._commit({**manifest, "version": manifest["version"] + 1, "folders": folders, "batches": {**manifest["batches"], writer: number}})
        self._files.delete(self._hadoop.Path(staged), True)
        return True

    def sink(self, writer: str, order: Sequence[str | Column] = (), keep: str = "new"):
        """For ``writeStream.foreachBatch``: a batch that is run again after a restart changes nothing."""
        return lambda batch, number: self.merge(batch, writer, number, order, keep) and None

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` manifests and the folders that they do not name. No writer may be at work,
        nor readers of older versions."""
        versions = self.versions()
        named = {f.split("/")[0] + "/" + f.split("/")[1] for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        for version in versions[:-keep]:
            self._files.delete(self._at(f"manifests/{version:012d}.json"), False)
        data = self._at("data")
        for folder in self._files.listStatus(data) if self._files.exists(data) else []:
            top = folder.getPath().getName()
            inside = [f.getPath().getName() for f in self._files.listStatus(folder.getPath())]
            kept = [name for name in inside if f"{top}/{name}" in named]
            for name in inside if kept else []:
                if name.startswith(BUCKET) and name not in kept:
                    self._files.delete(self._at(f"data/{top}/{name}"), True)
            if not kept:
                self._files.delete(folder.getPath(), True)


def _bucket(manifest: dict) -> Column:
    return F.pmod(F.xxhash64(*manifest["key"]), F.lit(manifest["buckets"])).cast("int").alias(BUCKET)
