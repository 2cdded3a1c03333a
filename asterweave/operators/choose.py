"""Which objects go on: size and number limits, what charts draw, and how objects are marked and named there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions.stated import blank_trim, type_code
from asterweave.runtime import number

# The types of objects that a chart draws, by their codes, and its limits of magnitude and size.
CHART_TYPES = ("OCL", "G", "GPAIR", "GTRPL", "GGROUP", "GCL", "NEB", "EMN", "RFN", "PN", "HII", "CL+N", "DRKN")
CHART_MAG, TRUE_SIZE_FROM, OUTLINE_BELOW = 16.0, 1.0, 3000.0
STAR_MAGS = {"map": 14.0, "chart": 12.0, "wide": 11.0}
# Marks of a measured and of an estimated value.
MEASURED, ESTIMATED = "●", "○"


def large_enough(df: DataFrame, least: float) -> DataFrame:
    """Rows of at least ``least`` arcmin; a size that is no number is not large enough."""
    return df.where(number(F.col("size")) >= least)


def first_objects(df: DataFrame, n: int | None = None, key: str = "id") -> DataFrame:
    """The ``n`` best objects: highest score, then largest size, then key. All if ``n`` is None. Each partition sends its best ``n``."""
    if n is None:
        return df
    return df.orderBy(F.col("score").desc_nulls_last(), number(F.col("size")).desc_nulls_last(), F.col(key)).limit(n)


def drawn_stars(mag: Column, kind: str = "chart") -> Column:
    """Whether a star of this magnitude is drawn on a kind of map (``STAR_MAGS``); one without magnitude is not."""
    return F.coalesce(number(mag) < STAR_MAGS[kind], F.lit(False))


def drawn(kind: Column, mag: Column) -> Column:
    """Whether a chart draws an object: a type of ``CHART_TYPES``, not fainter than its limit; without magnitude it does."""
    return F.coalesce(type_code(kind).isin(*CHART_TYPES), F.lit(False)) & F.coalesce(number(mag) < CHART_MAG, F.lit(True))


def true_size(size: Column) -> Column:
    """Whether an object is drawn in its true size, not as a sign."""
    return F.coalesce(number(size) > TRUE_SIZE_FROM, F.lit(False))


def outlined(size: Column) -> Column:
    """Whether an object gets an outline: its size is known and not absurd."""
    return F.coalesce((number(size) > 0) & (number(size) < OUTLINE_BELOW), F.lit(False))


def chart_label(names: Column, ident: Column, name: Column) -> Column:
    """The first common name, else the id of the NGC and then of the IC catalogue, else the name."""
    first = F.nullif(blank_trim(F.get(F.split(F.coalesce(names, F.lit("")), ","), F.lit(0))), F.lit(""))
    own = F.upper(blank_trim(ident))
    return F.coalesce(first, F.when(own.rlike(r"^(NGC|IC)\s*\d"), F.regexp_replace(own, r"\s+", "")), F.nullif(blank_trim(name), F.lit("")))


def marked(value: Column, estimated: Column, unit: str = "") -> Column:
    """A value with one decimal behind the mark of how it is known; null for no value."""
    return F.when(value.isNotNull(), F.concat(F.when(estimated, ESTIMATED).otherwise(MEASURED), F.format_string("%.1f", value.cast("double")), F.lit(unit)))


def good_months(monthly: DataFrame, min_hours: float) -> DataFrame:
    """(id, months): in how many months an object has at least ``min_hours``; 0 where it has none."""
    return monthly.groupBy("id").agg(F.count_if(F.coalesce(F.col("best_q_hours") >= min_hours, F.lit(False))).alias("months"))
