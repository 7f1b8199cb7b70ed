"""Results stored by the fingerprint of what they were made from: made once, read ever after."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def namespace(config: dict) -> str:
    """Digest of a configuration as JSON with sorted names: another configuration never meets its results."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def key(space: str, *parts: Column) -> Column:
    """A row's key: the namespace's beginning and the digest of path, size and time, parted by a control character."""
    return F.concat(F.lit(space[:16] + "/"), F.sha2(F.concat_ws("\u0001", *parts), 256))


class Cache:
    """A folder of Parquet files with a ``key`` column. Runs add files of their own, so none waits for another."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), f"key string, {schema}"

    def read(self) -> DataFrame:
        """One row per key: of equal work done twice the rows are equal, so any will do."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.root).dropDuplicates(["key"])

    def through(self, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``make`` over those ``rows`` (key, ...) whose key isn't stored; returns the stored and the new rows of all keys."""
        there = self.read()
        missing = rows.join(there.select("key"), "key", "left_anti")
        made = make(missing)
        made.select(*[c.split()[0] for c in self.schema.split(", ")]).write.parquet(f"{self.root}/{uuid.uuid4().hex}")
        return self.read().join(rows.select("key").distinct(), "key", "left_semi")

    def invalidate(self, keys: DataFrame) -> None:
        """Forget keys: what stays is written anew, and then the old files go."""
        left, old = self.read().join(keys.select("key"), "key", "left_anti"), self.root
        fresh = f"{old}.{uuid.uuid4().hex}"
        left.write.parquet(f"{fresh}/{uuid.uuid4().hex}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        store = path(old).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        store.delete(path(old), True)
        store.rename(path(fresh), path(old))
