"""Incremental results: compute what is missing, keep what is there, by a hash of the parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def missing_keys(targets: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Targets without a result."""
    return targets.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` with a key that ``new`` lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


class HashedStore:
    """Results in Parquet, one partition for each hash of the parameters that they depend on.

    A key is what a result depends on besides: identity and coordinates, so that
    an object that moved is computed again. Only the partition of the current
    hash is read; results of other parameters stay until they are dropped.
    """

    def __init__(self, spark: SparkSession, path: str, params_hash: str, keys: list[str]) -> None:
        self.spark, self.path, self.hash, self.keys = spark, path, params_hash, keys

    def read(self) -> DataFrame | None:
        """The results of the current parameters, or None if there are none yet."""
        try:
            rows = self.spark.read.parquet(self.path).where(F.col("params_hash") == self.hash)
        except AnalysisException:
            return None
        return None if rows.isEmpty() else rows.drop("params_hash")

    def refreshed(self, targets: DataFrame, compute: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
        """Results of all targets, after computing and adding those that are missing.

        ``force`` computes all targets again and puts them in place of the whole
        partition.
        """
        done = None if force else self.read()
        todo = targets if done is None else missing_keys(targets, done, self.keys)
        if done is None:
            self._write(compute(todo), "overwrite")
        elif not todo.isEmpty():
            self._write(compute(todo), "append")
        return self.read_of(targets)

    def read_of(self, targets: DataFrame) -> DataFrame:
        """Stored results of the targets."""
        rows = self.spark.read.parquet(self.path).where(F.col("params_hash") == self.hash).drop("params_hash")
        return rows.join(targets.select(*self.keys).distinct(), self.keys, "left_semi")

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.withColumn("params_hash", F.lit(self.hash)).write.mode(mode).partitionBy("params_hash")
        # overwriting replaces the partition of this hash only
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def drop_others(self) -> None:
        """Delete results of other parameters."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if fs.exists(root):
            for status in fs.listStatus(root):
                name = status.getPath().getName()
                if name.startswith("params_hash=") and name != f"params_hash={self.hash}":
                    fs.delete(status.getPath(), True)
