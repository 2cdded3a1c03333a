"""Regions that contain points, and points near other points.

Regions are covered by cells of an adaptive grid: large cells where a cell lies
wholly inside, finer ones along the edge. A point meets the cells by an
equi-join; inside an interior cell the match is accepted at once, in a boundary
cell the exact test decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions import sky
from asterweave.runtime import materialize, number, small_side

#: Levels of the grid that a cover may use. Bands at level L are 180 / 2^L degrees high.
LEVELS = (2, 4, 6, 8, 10, 12, 14)
#: A cover is refined until cells are this many times smaller than the region.
FINENESS = 4


def _parts(level: int, band: int) -> int:
    """Cells of a band: a power of two, so that cells of finer levels nest."""
    h = 180.0 / (1 << level)
    low, high = -90.0 + band * h, -90.0 + (band + 1) * h
    near = max(low, -high, 0.0)
    x = 2.0 * (1 << level) * math.cos(math.radians(near))
    return 1 << max(0, math.floor(math.log2(x) + 1e-9))


def grid_cell(ra: Column, dec: Column, level: int) -> Column:
    """The cell at ``level`` holding a position, packed into one long; the same rule as ``_parts``."""
    bands, h = 1 << level, 180.0 / (1 << level)
    band = F.least(F.floor((dec + 90.0) / h), F.lit(bands - 1).cast("long"))
    near = F.greatest(band * h - 90.0, 90.0 - (band + 1) * h, F.lit(0.0))
    power = F.floor(F.log2(2.0 * bands * F.cos(F.radians(near))) + 1e-9)
    parts = F.pow(F.lit(2.0), F.greatest(power, F.lit(0).cast("long")).cast("double"))
    at = F.least(F.floor(ra / (F.lit(360.0) / parts)), parts.cast("long") - 1)
    return F.lit(level << 56) + band * F.lit(1 << 28) + at


def _pieces(ra_min: float, ra_max: float) -> list[tuple[float, float]]:
    return [(ra_min, ra_max)] if ra_min <= ra_max else [(ra_min, 360.0), (0.0, ra_max)]


def _place(region: dict, a0: float, a1: float, d0: float, d1: float) -> int:
    """1: the closed cell lies inside the region, 0: it may meet its edge, -1: it lies outside."""
    if region["shape"] == "circle":
        ca, cd = (a0 + a1) / 2, (d0 + d1) / 2
        near = max(d0, -d1, 0.0)
        reach = (d1 - d0) / 2 + (a1 - a0) / 2 * math.cos(math.radians(near)) + 1e-9
        p1, p2, dl = math.radians(region["dec"]), math.radians(cd), math.radians(ca - region["ra"])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
        apart = math.degrees(2 * math.asin(min(1.0, math.sqrt(h))))
        radius = region["radius"]
        return 1 if apart + reach <= radius else -1 if apart - reach > radius else 0
    if d1 < region["dec_min"] or d0 > region["dec_max"]:
        return -1
    met = [(lo, hi) for lo, hi in _pieces(region["ra_min"], region["ra_max"]) if a1 >= lo and a0 <= hi]
    if not met:
        return -1
    tall = d0 >= region["dec_min"] and d1 <= region["dec_max"]
    return 1 if tall and any(a0 >= lo and a1 <= hi for lo, hi in met) else 0


def cover(region: dict) -> Iterator[tuple[int, bool]]:
    """(packed cell, interior) of the adaptive cover of one region."""
    if region["shape"] == "circle":
        extent = 2 * region["radius"]
    else:
        mid = math.cos(math.radians(min(89.0, (abs(region["dec_min"]) + abs(region["dec_max"])) / 2)))
        wide = sum(hi - lo for lo, hi in _pieces(region["ra_min"], region["ra_max"])) * mid
        extent = max(min(region["dec_max"] - region["dec_min"], wide), max(region["dec_max"] - region["dec_min"], wide) / 30)
    finest = next((lv for lv in LEVELS if 180.0 / (1 << lv) <= extent / FINENESS), LEVELS[-1])
    todo = [(LEVELS[0], b, a) for b in range(1 << LEVELS[0]) for a in range(_parts(LEVELS[0], b))]
    while todo:
        level, band, at = todo.pop()
        h, w = 180.0 / (1 << level), 360.0 / _parts(level, band)
        place = _place(region, at * w, (at + 1) * w, -90 + band * h, -90 + (band + 1) * h)
        if place < 0:
            continue
        if place > 0 or level >= finest:
            yield (level << 56) + (band << 28) + at, place > 0
            continue
        finer = LEVELS[LEVELS.index(level) + 1]
        times = 1 << (finer - level)
        for b in range(band * times, (band + 1) * times):
            many = _parts(finer, b)
            share = many // _parts(level, band)
            todo += [(finer, b, a) for a in range(at * share, (at + 1) * share)]


def _inside(p: str = "__p_", r: str = "__r_") -> Column:
    """The exact test: closed circles by great-circle distance, closed boxes by both coordinates."""
    ra, dec = F.col(f"{p}ra"), F.col(f"{p}dec")
    apart = sky.separation(F.col(f"{r}ra"), F.col(f"{r}dec"), ra, dec) * 60.0
    lo, hi = F.col(f"{r}ra_min"), F.col(f"{r}ra_max")
    across = F.when(lo <= hi, ra.between(lo, hi)).otherwise((ra >= lo) | (ra <= hi))
    box = across & dec.between(F.col(f"{r}dec_min"), F.col(f"{r}dec_max"))
    return F.when(F.col(f"{r}shape") == "circle", apart <= F.col(f"{r}radius") * 60.0).otherwise(box)


def regions_of_points(
    points: DataFrame, regions: DataFrame, point_id: str = "row_id", region_id: str = "field_id"
) -> DataFrame:
    """(point_id, region_id) for every point inside a region.

    ``points`` has ``ra`` and ``dec`` in degrees, right ascension modulo 360.
    ``regions`` has ``shape`` (circle or box, in any letter case), ``ra``,
    ``dec``, ``radius_arcmin`` or ``ra_min``, ``ra_max``, ``dec_min``,
    ``dec_max``; a box with ra_min > ra_max runs through 0. Edges belong to a
    region.

    Points without a usable position are in no region; a region with a missing
    limit, a negative radius, an unknown shape or a null id holds nothing.
    Repeated points or regions give repeated rows for each of their rows only
    once per id pair. Other columns are ignored. Empty inputs give no rows.
    """
    kind = F.lower(F.trim("shape"))
    r = regions.select(
        F.col(region_id).alias("__r_id"), kind.alias("__r_shape"), sky.usable_ra(F.col("ra")).alias("__r_ra"),
        sky.usable_dec(F.col("dec")).alias("__r_dec"), (number(F.col("radius_arcmin")) / 60.0).alias("__r_radius"),
        *(number(F.col(c)).alias(f"__r_{c}") for c in ("ra_min", "ra_max", "dec_min", "dec_max")),
    ).where(
        "__r_id is not null and (__r_shape = 'circle' and __r_ra is not null and __r_dec is not null and __r_radius >= 0"
        " or __r_shape = 'box' and __r_ra_min is not null and __r_ra_max is not null and __r_dec_min <= __r_dec_max)"
    ).dropDuplicates()
    columns = [c[4:] for c in r.columns]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                region = dict(zip(columns, row, strict=True))
                found = list(cover(region))
                out = pd.DataFrame({"__cell": [c for c, _ in found], "__interior": [i for _, i in found]})
                for name, value in region.items():
                    out[f"__r_{name}"] = value
                yield out[["__cell", "__interior", *(f"__r_{c}" for c in columns)]]

    schema = f"__cell long, __interior boolean, {', '.join(f'{n} {t}' for n, t in r.dtypes)}"
    covers = materialize(r.mapInPandas(cells, schema), "cover")
    levels = [row[0] for row in covers.select(F.shiftright("__cell", 56).cast("int").alias("l")).distinct().collect()]
    p = points.select(
        F.col(point_id).alias("__p_id"), sky.usable_ra(F.col("ra")).alias("__p_ra"), sky.usable_dec(F.col("dec")).alias("__p_dec")
    ).where("__p_ra is not null and __p_dec is not null")
    keys = F.array(*(grid_cell(F.col("__p_ra"), F.col("__p_dec"), lv) for lv in sorted(levels)))
    keys = keys if levels else F.array().cast("array<bigint>")
    probes = p.select("*", F.explode(keys).alias("__cell"))
    met = probes.join(small_side(covers), "__cell").where(F.col("__interior") | _inside())
    # the cells of one region don't overlap, so a pair of rows meets once; ids may repeat
    return met.select(F.col("__p_id").alias(point_id), F.col("__r_id").alias(region_id)).distinct()


def near_pairs(points: DataFrame, arcmin: float, point_id: str = "row_id", strict: bool = False) -> DataFrame:
    """(a, b, sep_arcmin), a < b, of all points at most ``arcmin`` apart (``strict``: less).

    A cell of the grid is as wide as the distance, so each point is compared
    with its own cell and 13 of its 26 neighbours by an equi-join, the others
    being compared with it; the straight-line distance of unit vectors decides.
    There is no special case at the poles or at right ascension 0. Points
    without a usable position or id have no pairs.
    """
    r = sky.chord(arcmin)
    side = max(r, 4.0 / (1 << sky.AXIS_BITS))
    at = points.select(
        F.col(point_id).alias("id"), sky.usable_ra(F.col("ra")).alias("ra"), sky.usable_dec(F.col("dec")).alias("dec")
    ).where("id is not null and ra is not null and dec is not null")
    x, y, z = sky.unit_vector(F.col("ra"), F.col("dec"))
    at = at.select("id", x.alias("x"), y.alias("y"), z.alias("z")).withColumn("cell", sky.cell_of(F.col("x"), F.col("y"), F.col("z"), side))
    right = at.select(F.col("id").alias("id2"), *(F.col(c).alias(f"{c}2") for c in "xyz"), "cell")
    shifts = [(i << (2 * sky.AXIS_BITS)) + (j << sky.AXIS_BITS) + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    steps = F.array(*(F.lit(s) for s in shifts if s >= 0))
    left = at.select("id", "x", "y", "z", F.col("cell").alias("home"), F.explode(F.transform(steps, lambda s: s + F.col("cell"))).alias("cell"))
    d2 = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    once = F.when(F.col("home") == F.col("cell"), F.col("id") < F.col("id2")).otherwise(F.col("id") != F.col("id2"))
    pairs = left.join(right, "cell").where(once).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), d2.alias("d2"))
    pairs = pairs.where(F.col("d2") < r * r) if strict else pairs.where(F.col("d2") <= r * r)
    return pairs.select("a", "b", (F.degrees(2 * F.asin(F.sqrt("d2") / 2)) * 60).alias("sep_arcmin"))
