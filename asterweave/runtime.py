"""What operators share at run time: shared storage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, shared by all executors.

    It is ``spark.checkpoint.dir`` of the session, or else the checkpoint
    folder of the context. Only a session of one machine gets a temporary one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    set_by_hand = spark.sparkContext.getCheckpointDir()
    if set_by_hand:
        return set_by_hand.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="asterweave-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts the lineage like ``checkpoint()``, survives the loss of executors, and
    unlike it computes the plan once and keeps columns prunable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/asterweave/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(file).getParent()
        fs = at.getFileSystem(conf)
        if "/asterweave/" in at.toString() and fs.exists(at):
            fs.delete(at, True)
        break


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are at most ``limit``.

    ``df`` should be cheap to count, as a materialized table is. Beyond the
    limit the join is left to the optimizer, which shuffles and splits skew.
    """
    rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def number(value: Column) -> Column:
    """``value`` as double with NaN and infinities as null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
