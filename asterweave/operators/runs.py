"""Runs and crossings in sampled series, in array and in row form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(mask: Column, step: float) -> Column:
    """Array of (start, end) of the maximal runs of true in an array of booleans, one sample every ``step``.

    A run up to the last sample ends where the next sample would begin. A null
    sample counts as false; a null or empty array has no runs. ``mask`` should be
    a column of its input: an expression would be computed again at every sample.
    """
    n = F.size(mask)
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def true_at(i: Column) -> Column:
        return (i >= 0) & (i < n) & F.coalesce(F.get(mask, i), F.lit(False))

    starts = F.filter(places, lambda i: true_at(i) & ~true_at(i - 1))
    ends = F.filter(places, lambda i: true_at(i) & ~true_at(i + 1))
    return F.when(n > 0, F.zip_with(starts, ends, lambda s, e: F.struct((s * step).alias("start"), ((e + 1) * step).alias("end")))).otherwise(
        F.array().cast("array<struct<start:double,end:double>>")
    )


def crossings(series: Column, at: Callable[[Column], Column]) -> Column:
    """Array of interpolated places where a series changes its sign; ``at`` gives the value of a fractional index.

    ``series`` should be a column of its input, as for ``segments``.
    """
    n = F.size(series)
    pairs = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    changed = F.filter(pairs, lambda i: (n > 1) & ((F.get(series, i) < 0) != (F.get(series, i + 1) < 0)))

    def place(i: Column) -> Column:
        y0, y1 = F.get(series, i), F.get(series, i + 1)
        return at(i + y0 / (y0 - y1))

    return F.transform(changed, place)


def row_segments(df: DataFrame, keys: list[str], order: str, mask: Column) -> DataFrame:
    """(keys, start, end, n): the maximal runs of rows of a key, in ``order``, where ``mask`` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    flags = df.select(*keys, F.col(order).alias("__o"), F.coalesce(mask, F.lit(False)).alias("__m"))
    w = Window.partitionBy(*keys).orderBy("__o")
    begins = (F.col("__m") & ~F.coalesce(F.lag("__m").over(w), F.lit(False))).cast("int")
    runs = flags.withColumn("__b", begins).withColumn("__run", F.sum("__b").over(w)).where("__m")
    return runs.groupBy(*keys, "__run").agg(F.min("__o").alias("start"), F.max("__o").alias("end"), F.count("*").alias("n")).drop("__run")


def row_crossings(df: DataFrame, keys: list[str], order: str, value: Column, limit: float) -> DataFrame:
    """(keys, at): interpolated places in ``order`` (a number) where ``value`` crosses ``limit`` between neighbouring rows."""
    rows = df.select(*keys, F.col(order).cast("double").alias("__o"), (value - limit).alias("__y"))
    w = Window.partitionBy(*keys).orderBy("__o")
    pairs = rows.withColumns({"__o2": F.lead("__o").over(w), "__y2": F.lead("__y").over(w)})
    crossed = pairs.where((F.col("__y") < 0) != (F.col("__y2") < 0))
    share = F.col("__y") / (F.col("__y") - F.col("__y2"))
    return crossed.select(*keys, (F.col("__o") + share * (F.col("__o2") - F.col("__o"))).alias("at"))
