"""A year of visibility: night grids, hours by night and month, daily records.

The sky of a site (sidereal times, altitudes of Sun and Moon) depends on time
only; it is one small table that is broadcast. An object's altitudes are arrays
of one day, never rows of their own, so that a year of an object is 365 rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asterweave.functions import ephem
from asterweave.functions.sky import separation
from asterweave.operators.runs import crossings, segments
from asterweave.runtime import materialize

#: The daily grid: samples from 14:00, over so many hours.
SAMPLES, START_HOUR, RANGE_HOURS = 204, 14.0, 17.0
#: Spacing of sampled instants, and the length that a sample counts for.
SPACING, STEP = RANGE_HOURS / (SAMPLES - 1), RANGE_HOURS / SAMPLES
#: Samples of a whole day, both ends included, in which crossings are sought.
DAY_SAMPLES = 1440


@dataclass(frozen=True)
class Site:
    """An observing site and its limits."""

    lat: float = 52.4095
    lon: float = 16.9319
    tz: str = "Europe/Warsaw"
    year: int = 2026
    min_alt: float = 25.0
    sun_limit: float = -12.0
    min_hours: float = 3.0


def days_of_year(spark: SparkSession, year: int) -> DataFrame:
    """(day): every date of a year."""
    return spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31)))).alias("day"))


def _noon(day: Column) -> Column:
    """Julian date of 12:00 UTC of a date."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("double") + 2440588.0


def night_grid(spark: SparkSession, site: Site, step_minutes: int = 15, scan_minutes: int = 2) -> DataFrame:
    """(night_id, jd, month, lst): instants of darkness, every ``step_minutes`` from each dusk, before the dawn after it.

    Dusk is the first time after noon UTC at which the Sun sinks below the limit,
    dawn its next rise; both are interpolated on a grid of ``scan_minutes``. A
    day without dusk and dawn within two days has no night. ``month`` is the UTC
    month from 0; nights are numbered in order.
    """
    n = 48 * 60 // scan_minutes
    scan = days_of_year(spark, site.year).select("day", _noon(F.col("day")).alias("noon"))
    scan = scan.select("day", "noon", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"))
    jd = F.col("noon") + F.col("i") * (scan_minutes / 1440.0)
    ra, dec = ephem.sun(jd)
    heights = scan.withColumn("y0", ephem.altitude(ephem.local_sidereal(jd, site.lon), ra, dec, site.lat) - site.sun_limit)
    pairs = heights.withColumn("y1", F.lead("y0").over(Window.partitionBy("day").orderBy("i")))
    crossed = pairs.where((F.col("y0") < 0) != (F.col("y1") < 0)).select(
        "day", "i", (F.col("y0") >= 0).alias("sets"),
        (F.col("noon") + (F.col("i") + F.col("y0") / (F.col("y0") - F.col("y1"))) * (scan_minutes / 1440.0)).alias("jd"),
    )
    dusk = crossed.where("sets").groupBy("day").agg(F.min(F.struct("i", "jd")).alias("dusk"))
    after = crossed.where("not sets").join(dusk, "day").where(F.col("i") > F.col("dusk.i"))
    nights = after.groupBy("day").agg(F.first("dusk.jd").alias("dusk"), F.min(F.struct("i", "jd"))["jd"].alias("dawn"))
    # at most one row for each day of the year
    nights = nights.withColumn("night_id", F.row_number().over(Window.orderBy("day")) - 1)
    step = step_minutes / 1440.0
    count = F.ceil((F.col("dawn") - F.col("dusk")) / step - 1e-9).cast("int")
    rows = nights.where(count > 0).select("night_id", F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.col("dusk") + i * step)).alias("jd"))
    month = F.month(F.timestamp_micros(((F.col("jd") - 2440587.5) * 86_400_000_000.0).cast("long"))) - 1
    return rows.select("night_id", "jd", month.alias("month"), ephem.local_sidereal(F.col("jd"), site.lon).alias("lst"))


def reachable(objects: DataFrame, site: Site) -> DataFrame:
    """Objects whose upper transit reaches the least altitude; as a range of declinations, which a scan can use."""
    low, high = ephem.dec_band(site.lat, site.min_alt)
    return objects.where(F.col("dec").between(low, high))


def hours_by_night(objects: DataFrame, grid: DataFrame, site: Site, key: str = "id", step_minutes: int = 15) -> DataFrame:
    """(key, night_id, month, hours) above the least altitude, of nights and months with any."""
    seen = objects.select(key, "ra", "dec").crossJoin(F.broadcast(grid))
    seen = seen.where(ephem.altitude(F.col("lst"), F.col("ra"), F.col("dec"), site.lat) >= site.min_alt)
    return seen.groupBy(key, "night_id", "month").agg((F.count("*") * (step_minutes / 60.0)).alias("hours"))


def yearly_visibility(objects: DataFrame, grid: DataFrame, site: Site, key: str = "id", step_minutes: int = 15) -> DataFrame:
    """(key, nights, m0 ... m11): nights with enough hours, and hours by month, of objects with at least one such night.

    The grid of a year is about 16,000 rows and is broadcast; partial sums keep
    one number for each object, night and month.
    """
    by_night = hours_by_night(objects, grid, site, key, step_minutes)
    per_night = by_night.groupBy(key, "night_id").agg(
        F.sum("hours").alias("hours"), *(F.sum(F.when(F.col("month") == m, F.col("hours")).otherwise(0.0)).alias(f"m{m}") for m in range(12))
    )
    out = per_night.groupBy(key).agg(
        F.count_if(F.col("hours") >= site.min_hours).alias("nights"), *(F.round(F.sum(f"m{m}"), 6).alias(f"m{m}") for m in range(12))
    )
    return out.where("nights > 0")


def sky_days(spark: SparkSession, site: Site) -> DataFrame:
    """(day, noon, lst, sun_alt, moon_alt): the sky of a site on the grid of each day of the year; at most 366 rows."""
    places = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    noon = _noon(F.col("day"))

    def jd(i: Column) -> Column:
        return noon + (2.0 + i * SPACING) / 24.0

    def height(body) -> Column:
        def at(i: Column) -> Column:
            ra, dec = body(jd(i))
            return ephem.altitude(ephem.local_sidereal(jd(i), site.lon), ra, dec, site.lat)

        return F.transform(places, at)

    return days_of_year(spark, site.year).select(
        "day", noon.alias("noon"), F.transform(places, lambda i: ephem.local_sidereal(jd(i), site.lon)).alias("lst"),
        height(ephem.sun).alias("sun_alt"), height(ephem.moon).alias("moon_alt"),
    )


def _object_days(objects: DataFrame, sky: DataFrame, site: Site, key: str) -> DataFrame:
    """Objects times days: coordinates at the equinox of the day, sidereal time at noon, and horizon crossings.

    Crossings are the sign changes among the samples of 24 hours from noon UTC,
    both ends included. Of the samples only those beside the analytic rising and
    setting can change the sign, so no others are computed.
    """
    rows = objects.select(F.col(key).alias("obj_id"), "ra", "dec").crossJoin(F.broadcast(sky))
    ra, dec = ephem.precessed(F.col("ra"), F.col("dec"), F.col("noon"))
    rows = rows.withColumns({"ra_d": ra, "dec_d": dec, "lst0": ephem.local_sidereal(F.col("noon"), site.lon)})
    rate = 360.98564736629 / (DAY_SAMPLES - 1)

    def alt(lst: Column) -> Column:
        return ephem.altitude(lst, F.col("ra_d"), F.col("dec_d"), site.lat)

    half = _half_arc(0.0, site)
    roots = [F.pmod(sign * half + F.col("ra_d") - F.col("lst0"), F.lit(360.0)) / rate for sign in (-1, 1)]
    near = F.array(*(F.floor(root + turn * 360.0 / rate).cast("int") + beside for root in roots for turn in (-1, 0, 1) for beside in (-1, 0, 1)))
    places = F.array_sort(F.array_distinct(F.filter(near, lambda k: (k >= 0) & (k < DAY_SAMPLES - 1))))
    sampled = F.transform(places, lambda k: F.struct(k.alias("k"), alt(F.col("lst0") + k * rate).alias("y0"), alt(F.col("lst0") + (k + 1) * rate).alias("y1")))
    changed = F.filter(sampled, lambda p: (p["y0"] < 0) != (p["y1"] < 0))
    midday = F.col("day").cast("timestamp_ntz").cast("timestamp")
    stamp = lambda x: F.timestamp_micros(F.unix_micros(midday) + F.round((12.0 + x * (24.0 / (DAY_SAMPLES - 1))) * 3.6e9).cast("long"))
    return rows.withColumn("obj_pts", F.transform(changed, lambda p: stamp(p["k"] + p["y0"] / (p["y0"] - p["y1"]))))


def _half_arc(height: float, site: Site) -> Column:
    """Hour angle in degrees at which an object of ``dec_d`` is at a height: 0 if it never is above, 180 if always."""
    d, phi = F.radians("dec_d"), math.radians(site.lat)
    cos_h = (math.sin(math.radians(height)) - F.sin(d) * math.sin(phi)) / (F.cos(d) * math.cos(phi))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_h))))


def raw_visibility(objects: DataFrame, site: Site, key: str = "id") -> DataFrame:
    """(obj_id, ra, dec, day, alt, obj_pts): altitudes on the daily grid and horizon crossings of each object and day.

    Coordinates are carried to the equinox of the day. One narrow pass without a
    shuffle. What needs no single altitudes should come from ``daily_records``.
    """
    sky = sky_days(objects.sparkSession, site).select("day", "noon", "lst")
    rows = _object_days(objects, sky, site, key)
    alt = F.transform("lst", lambda t: ephem.altitude(t, F.col("ra_d"), F.col("dec_d"), site.lat))
    return rows.select("obj_id", "ra", "dec", "day", alt.alias("alt"), "obj_pts")


def _sky_of_days(spark: SparkSession, site: Site) -> DataFrame:
    """The sky of each day with what the Sun and Moon decide alone: dusk and dawn, dark runs, running counts without Moon."""
    midnight = F.unix_micros(F.col("day").cast("timestamp_ntz").cast("timestamp"))
    stamp = lambda h: F.timestamp_micros(midnight + F.round(h * 3.6e9).cast("long"))
    sky = materialize(sky_days(spark, site).withColumn("over", F.transform("sun_alt", lambda s: s - site.sun_limit)), "sky")
    found = crossings(F.col("over"), lambda x: stamp(START_HOUR + x * SPACING))
    mean = F.aggregate("over", F.lit(0.0), lambda a, x: a + x)
    none = F.when(mean > 0, F.array(stamp(F.lit(START_HOUR)), stamp(F.lit(START_HOUR)))).otherwise(F.array().cast("array<timestamp>"))
    dark = F.transform("over", lambda s: s < 0)
    moonless = F.zip_with("over", "moon_alt", lambda s, m: ((s < 0) & (m < 0)).cast("int"))
    sky = materialize(sky.withColumns({"sun_pts": F.when(F.size(found) > 0, found).otherwise(none), "dark": dark, "moonless": moonless}), "sky")
    runs = F.transform(segments(F.col("dark"), 1.0), lambda s: F.struct(s["start"].cast("int").alias("i"), (s["end"] - 1).cast("int").alias("j")))
    sums = F.aggregate("moonless", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    return materialize(sky.select("day", "noon", "lst", "sun_pts", runs.alias("dark"), sums.alias("moonless")), "sky")


def daily_records(objects: DataFrame, site: Site, key: str = "id") -> DataFrame:
    """The daily record of each object, equal to ``daily_visibility(raw_visibility(objects))``, without an altitude for each sample.

    The samples above the least altitude are runs around the upper transits.
    Their ends follow from the hour angle of that altitude and are settled by the
    samples beside them; hours are then counts over the overlap with dark runs.
    Rows are objects times days, computed by a few dozen operations each; only
    the sky of the year is broadcast, at most 366 rows.
    """
    rows = _object_days(objects, _sky_of_days(objects.sparkSession, site), site, key)
    rows = rows.withColumns({"half": _half_arc(site.min_alt, site), "ha": F.pmod(F.get("lst", F.lit(0)) - F.col("ra_d") + 180.0, F.lit(360.0)) - 180.0})
    rate, last = 360.98564736629 / 24.0 * SPACING, SAMPLES - 1

    def alt(i: Column) -> Column:
        return ephem.altitude(F.get("lst", i), F.col("ra_d"), F.col("dec_d"), site.lat)

    def above(i: Column) -> Column:
        return (i >= 0) & (i <= last) & F.coalesce(alt(i) > site.min_alt, F.lit(False))

    def run(turn: int) -> Column:
        x, y = (F.col("ha") * -1 - F.col("half") + 360.0 * turn) / rate, (F.col("ha") * -1 + F.col("half") + 360.0 * turn) / rate
        f = F.greatest(F.floor(x).cast("int"), F.lit(0))
        g = F.least(F.ceil(y).cast("int"), F.lit(last))
        i = F.when(above(f), f).when(above(f + 1), f + 1).otherwise(f + 2)
        j = F.when(above(g), g).when(above(g - 1), g - 1).otherwise(g - 2)
        return F.struct(i.alias("i"), j.alias("j"))

    turns = (-1, 0, 1)
    rows = rows.withColumn("runs", F.array(*(run(t) for t in turns)))
    always = F.array(F.struct(F.lit(0).alias("i"), F.lit(last).alias("j")))
    runs = F.filter("runs", lambda r: (r["i"] <= r["j"]) & (r["i"] <= last) & (r["j"] >= 0) & above(r["i"]))
    empty = F.array().cast("array<struct<i:int,j:int>>")
    rows = rows.withColumn("runs", F.when(F.col("half") >= 180.0, always).when(F.col("half") <= 0.0, empty).otherwise(runs))

    def joined(acc: Column, r: Column) -> Column:
        # runs that touch are one
        before = F.element_at(acc, -1)
        touching = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(before["i"].alias("i"), r["j"].alias("j"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["j"] + 1 >= r["i"]), touching).otherwise(F.array_append(acc, r))

    rows = rows.withColumn("runs", F.aggregate("runs", empty, joined))
    overlaps = F.flatten(
        F.transform("runs", lambda r: F.transform("dark", lambda d: F.struct(F.greatest(r["i"], d["i"]).alias("i"), F.least(r["j"], d["j"]).alias("j"))))
    )
    rows = rows.withColumn("overlaps", F.filter(overlaps, lambda o: o["i"] <= o["j"]))
    n = F.aggregate("overlaps", F.lit(0), lambda a, o: a + o["j"] - o["i"] + 1)
    m = F.aggregate("overlaps", F.lit(0), lambda a, o: a + F.get("moonless", o["j"] + 1) - F.get("moonless", o["i"]))
    peaks = [F.floor((F.col("ha") * -1 + 360.0 * t) / rate).cast("int") + b for t in turns for b in (0, 1)]
    peaks = F.filter(F.array(F.lit(0), F.lit(last), *peaks), lambda i: (i >= 0) & (i <= last))
    top = F.array_max(F.transform(peaks, lambda i: F.struct(alt(i).alias("alt"), (-i).alias("minus"))))
    return rows.select(
        "obj_id", "day", "sun_pts", "obj_pts", (-top["minus"] * STEP).alias("transit_rel"), (n * STEP).alias("q_hours"), (m * STEP).alias("m_hours"),
        F.transform("overlaps", lambda o: F.struct((o["i"] * STEP).alias("start"), ((o["j"] + 1) * STEP).alias("end"))).alias("qual_segments"),
        ephem.utc_offset_hours(F.col("day"), site.tz).alias("tz_offset"),
    )


def daily_visibility(raw: DataFrame, site: Site) -> DataFrame:
    """The daily record of each object: hours of quality and without Moon, transit, segments, dusk and dawn, zone offset.

    A sample is of quality if the object is above the least altitude and the Sun
    below its limit, both strictly. ``sun_pts`` are the interpolated crossings
    of the Sun's limit; without one, 14:00 twice where the Sun is above it on
    average, else none.
    """
    sky = _sky_of_days(raw.sparkSession, site).select("day", "sun_pts")
    sky = sky.join(sky_days(raw.sparkSession, site).select("day", "sun_alt", "moon_alt"), "day")
    rows = raw.join(F.broadcast(sky), "day")
    quality = F.zip_with("alt", "sun_alt", lambda a, s: (a > site.min_alt) & (s < site.sun_limit))
    rows = rows.withColumn("quality", quality)
    dark = F.zip_with("quality", "moon_alt", lambda q, m: q & (m < 0))
    hours = lambda mask: F.size(F.filter(mask, lambda m: m)) * STEP
    return rows.select(
        "obj_id", "day", "sun_pts", "obj_pts",
        ((F.array_position("alt", F.array_max("alt")) - 1) * STEP).alias("transit_rel"),
        hours(F.col("quality")).alias("q_hours"), hours(dark).alias("m_hours"), segments(F.col("quality"), STEP).alias("qual_segments"),
        ephem.utc_offset_hours(F.col("day"), site.tz).alias("tz_offset"),
    )


def darkest_day(spark: SparkSession, year: int) -> DataFrame:
    """(month, day, separation): of days 1 to 28 of each month the one with the least separation of Sun and Moon at noon UTC, the first on a tie."""
    days = days_of_year(spark, year).where(F.dayofmonth("day") <= 28)
    noon = _noon(F.col("day"))
    (a1, d1), (a2, d2) = ephem.sun(noon), ephem.moon(noon)
    sep = separation(a1, d1, a2, d2)
    return days.select(F.month("day").alias("month"), "day", sep.alias("sep")).groupBy("month").agg(
        F.min_by("day", F.struct("sep", "day")).alias("day"), F.min("sep").alias("separation")
    )


def night_lengths(spark: SparkSession, site: Site) -> DataFrame:
    """(day, hours, minutes) of darkness between 0 and 24 h UTC, in samples of five minutes."""
    places = F.sequence(F.lit(0), F.lit(287))
    midnight = _noon(F.col("day")) - 0.5

    def dark(i: Column) -> Column:
        jd = midnight + i * (5.0 / 1440.0)
        ra, dec = ephem.sun(jd)
        return ephem.altitude(ephem.local_sidereal(jd, site.lon), ra, dec, site.lat) < site.sun_limit

    n = F.size(F.filter(places, dark)) * 5
    return days_of_year(spark, site.year).select("day", F.floor(n / 60).cast("int").alias("hours"), (n % 60).cast("int").alias("minutes"))
