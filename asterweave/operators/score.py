"""Completing, scoring and profiling catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions import lookups, text
from asterweave.runtime import number


def imputed(df: DataFrame) -> DataFrame:
    """``df`` with mag and size filled by type, and mag_source, size_source (measured or estimated).

    A size that is zero or negative counts as missing. Types are compared
    exactly, apart from outer spaces; an unknown or null type takes the default
    of others.
    """
    kind = F.trim(F.coalesce(F.col("type"), F.lit("Other")))
    mag, size = number(F.col("mag")), number(F.col("size"))
    size = F.when(size > 0, size)
    default_mag = lookups.lookup(lookups.DEFAULT_MAG, kind, lookups.DEFAULT_MAG_OTHER)
    default_size = lookups.lookup(lookups.DEFAULT_SIZE, kind, lookups.DEFAULT_SIZE_OTHER)
    return df.withColumns(
        {
            "mag": F.coalesce(mag, default_mag),
            "size": F.coalesce(size, default_size),
            "mag_source": F.when(mag.isNull(), "estimated").otherwise("measured"),
            "size_source": F.when(size.isNull(), "estimated").otherwise("measured"),
        }
    )


def scorecard(kind: Column, flags: dict[str, Column], narrowband: bool = False, bortle: int = 9) -> Column:
    """A struct of points (famous, filter_type, bortle_type, quality) of an imputed row."""
    code = F.upper(F.trim(F.coalesce(kind, F.lit("Other"))))
    known = F.when(code.isin(*lookups.SCORECARD), code).otherwise("OTHER")

    def column(i: int) -> Column:
        return lookups.lookup({k: float(v[i]) for k, v in lookups.SCORECARD.items()}, known)

    famous = F.lit(0.0)
    for name in ("herschel", "caldwell", "messier"):
        famous = F.when(flags[f"is_{name}"], lookups.FAME_POINTS[name]).otherwise(famous)
    quality = sum((F.when(F.col(f"{c}_source") == "measured", lookups.MEASURED_POINTS).otherwise(0.0) for c in ("mag", "size")), F.lit(0.0))
    return F.struct(
        famous.alias("famous"), column(1 if narrowband else 0).alias("filter_type"),
        column(2 if bortle <= 5 else 3).alias("bortle_type"), quality.alias("quality"),
    )


def scored(df: DataFrame, narrowband: bool = False, bortle: int = 9) -> DataFrame:
    """Imputed rows with fame flags, score_breakdown and final_score."""
    flags = text.fame_flags(F.col("extra_info"))
    rows = imputed(df).withColumns(flags)
    rows = rows.withColumn("score_breakdown", scorecard(F.col("type"), {n: F.col(n) for n in flags}, narrowband, bortle))
    b = F.col("score_breakdown")
    total = b["famous"] + b["filter_type"] + b["bortle_type"] + b["quality"]
    return rows.withColumns({"final_score": total, "is_catalog_famous": F.col("is_messier") | F.col("is_caldwell") | F.col("is_herschel")})


def soft_cut(df: DataFrame, floor: float = 10.0, from_rows: int = 500, share: float = 0.3) -> DataFrame:
    """Rows with a score above ``floor`` and, if these are ``from_rows`` or more, above their exact 30th percentile."""
    rows = df.where(F.col("final_score") > floor)
    limit = rows.agg(F.count("*").alias("__n"), F.percentile("final_score", F.lit(share)).alias("__p"))
    cut = rows.crossJoin(F.broadcast(limit)).where((F.col("__n") < from_rows) | (F.col("final_score") > F.col("__p")))
    return cut.select(*df.columns)


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, 100.0 * part / whole), 4)


def profile(df: DataFrame) -> DataFrame:
    """One row that describes completeness and ranges of a catalogue, in one pass."""
    mag, size = number(F.col("mag")), number(F.col("size"))
    kind = F.nullif(F.trim("type"), F.lit(""))
    n = F.count("*")
    aggs: dict[str, Column] = {"n_rows": n}
    for name, x in (("mag", mag), ("size", size)):
        aggs |= {
            f"{name}_present": F.count(x), f"{name}_missing": n - F.count(x), f"{name}_present_pct": _share(F.count(x), n),
            f"{name}_min": F.min(x), f"{name}_max": F.max(x), f"{name}_mean": F.round(F.avg(x), 6), f"{name}_median": F.median(x),
        }
    for q in (25, 50, 75, 90):
        aggs[f"size_p{q}"] = F.round(F.percentile(size, F.lit(q / 100)), 6)
    aggs |= {
        "positioned": F.count_if(number(F.col("ra")).isNotNull() & number(F.col("dec")).isNotNull()),
        "complete": F.count_if(mag.isNotNull() & size.isNotNull()),
        "mag_without_size": F.count_if(mag.isNotNull() & size.isNull()),
        "size_without_mag": F.count_if(mag.isNull() & size.isNotNull()),
        "large_without_mag": F.count_if((size > 10) & mag.isNull()),
        "bright_without_size": F.count_if((mag < 10) & size.isNull()),
        "without_type": F.count_if(kind.isNull()),
        "too_small_pct": _share(F.count_if(size < 18.0), F.count(size)),
    }
    return df.agg(*(c.alias(name) for name, c in aggs.items()))


#: Borders of the histograms of a profile.
MAG_BORDERS, SIZE_BORDERS = (5.0, 8.0, 12.0), (5.0, 20.0, 60.0, 180.0)


def histogram(df: DataFrame, column: str, borders: tuple[float, ...]) -> DataFrame:
    """(bucket, n, pct): values below the first border, from each border on, as a share of those present; empty buckets too."""
    x = number(F.col(column))
    bucket = sum(((x >= b).cast("int") for b in borders), F.lit(0))
    counts = df.where(x.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(borders) + 1).select(F.col("id").cast("int").alias("bucket"))
    total = counts.agg(F.sum("n").alias("all"))
    filled = every.join(F.broadcast(counts), "bucket", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return filled.select("bucket", n.alias("n"), F.round(100.0 * n / F.col("all"), 4).alias("pct"))


def value_counts(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """(value, n) of the commonest values, most first, then by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.where("value is not null").orderBy(F.desc("n"), "value").limit(limit)


def famous_counts(df: DataFrame) -> DataFrame:
    """Rows with a Messier, Caldwell or Herschel designation in its strict form."""
    flags = text.fame_flags(F.col("extra_info"), strict=True)
    return df.agg(*(F.count_if(c).alias(name.replace("is_", "n_")) for name, c in flags.items()))


def imputation_stats(df: DataFrame) -> DataFrame:
    """How many of the imputed rows had a measured magnitude, size, or both, and their share."""
    m, s = F.col("mag_source") == "measured", F.col("size_source") == "measured"
    n = F.count("*")
    parts = {"mag": m, "size": s, "both": m & s}
    aggs = [n.alias("n_rows")]
    for name, c in parts.items():
        aggs += [F.count_if(c).alias(f"n_{name}"), _share(F.count_if(c), n).alias(f"pct_{name}")]
    return df.agg(*aggs)
