"""Astronomy as column expressions: sidereal time, altitude, Sun, Moon, precession, small geometry.

Positions of Sun and Moon follow public almanac series (about 0.01 and 0.3
degrees). Angles are degrees, times Julian dates in UTC.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

J2000 = 2451545.0


def julian_date(ts: Column) -> Column:
    """The Julian date of a timestamp without zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0) + 2440587.5


def gmst(jd: Column) -> Column:
    """Greenwich mean sidereal time in degrees."""
    d = jd - J2000
    t = d / 36525.0
    return F.pmod(280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0, F.lit(360.0))


def local_sidereal(jd: Column, lon: float) -> Column:
    """Local sidereal time in degrees at an eastern longitude."""
    return F.pmod(gmst(jd) + lon, F.lit(360.0))


def altitude(lst: Column, ra: Column, dec: Column, lat: float) -> Column:
    """Geometric altitude in degrees; no refraction."""
    phi, d, h = math.radians(lat), F.radians(dec), F.radians(lst - ra)
    s = F.sin(d) * math.sin(phi) + F.cos(d) * math.cos(phi) * F.cos(h)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def highest_altitude(dec: Column, lat: float) -> Column:
    """Altitude at upper transit: 90 - |lat - dec|."""
    return 90.0 - F.abs(F.lit(lat) - dec)


def dec_band(lat: float, min_alt: float) -> tuple[float, float]:
    """Declinations that rise to ``min_alt``; a range that a scan can use."""
    return lat - (90.0 - min_alt), lat + (90.0 - min_alt)


def sun(jd: Column) -> tuple[Column, Column]:
    """Apparent right ascension and declination of the Sun."""
    n = jd - J2000
    g = F.radians(F.pmod(357.528 + 0.9856003 * n, F.lit(360.0)))
    mean = F.pmod(280.460 + 0.9856474 * n, F.lit(360.0))
    lam = F.radians(mean + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    return _equatorial(lam, F.lit(0.0), n)


def moon(jd: Column) -> tuple[Column, Column]:
    """Geocentric right ascension and declination of the Moon, by the leading terms of its series."""
    n = jd - J2000
    t = n / 36525.0

    def arg(a: float, b: float) -> Column:
        return F.radians(a + b * t)

    lam = (
        218.32 + 481267.881 * t + 6.29 * F.sin(arg(135.0, 477198.87)) - 1.27 * F.sin(arg(259.3, -413335.36))
        + 0.66 * F.sin(arg(235.7, 890534.22)) + 0.21 * F.sin(arg(269.9, 954397.74))
        - 0.19 * F.sin(arg(357.5, 35999.05)) - 0.11 * F.sin(arg(186.5, 966404.03))
    )
    beta = (
        5.13 * F.sin(arg(93.3, 483202.02)) + 0.28 * F.sin(arg(228.2, 960400.89))
        - 0.28 * F.sin(arg(318.3, 6003.15)) - 0.17 * F.sin(arg(217.6, -407332.21))
    )
    return _equatorial(F.radians(F.pmod(lam, F.lit(360.0))), F.radians(beta), n)


def _equatorial(lam: Column, beta: Column, n: Column) -> tuple[Column, Column]:
    eps = F.radians(23.439 - 0.0000004 * n)
    x = F.cos(beta) * F.cos(lam)
    y = F.cos(eps) * F.cos(beta) * F.sin(lam) - F.sin(eps) * F.sin(beta)
    z = F.sin(eps) * F.cos(beta) * F.sin(lam) + F.cos(eps) * F.sin(beta)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(z))


def precessed(ra: Column, dec: Column, jd: Column) -> tuple[Column, Column]:
    """J2000 coordinates carried to the equinox of a date (rigorous rotation with the usual angles)."""
    t = (jd - J2000) / 36525.0
    zeta = F.radians((2306.2181 * t + 0.30188 * t * t + 0.017998 * t * t * t) / 3600.0)
    z = F.radians((2306.2181 * t + 1.09468 * t * t + 0.018203 * t * t * t) / 3600.0)
    theta = F.radians((2004.3109 * t - 0.42665 * t * t - 0.041833 * t * t * t) / 3600.0)
    a, d = F.radians(ra), F.radians(dec)
    p = F.cos(d) * F.sin(a + zeta)
    q = F.cos(theta) * F.cos(d) * F.cos(a + zeta) - F.sin(theta) * F.sin(d)
    r = F.sin(theta) * F.cos(d) * F.cos(a + zeta) + F.cos(theta) * F.sin(d)
    return F.pmod(F.degrees(F.atan2(p, q) + z), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))


def twilight(sun_alt: Column) -> Column:
    """day, civil, nautical, astronomical or night, by the Sun's altitude."""
    return F.when(sun_alt > 0, "day").when(sun_alt > -6, "civil").when(sun_alt > -12, "nautical").when(sun_alt > -18, "astronomical").otherwise("night")


def utc_offset_hours(local_midnight: Column, tz: str) -> Column:
    """Hours by which a zone is ahead of UTC at a local time, summer time included."""
    naive = local_midnight.cast("timestamp_ntz")
    return (F.unix_micros(naive.cast("timestamp")) - F.unix_micros(F.to_utc_timestamp(naive.cast("timestamp"), tz))) / F.lit(3_600_000_000.0)


def projection(dec: Column) -> Column:
    """Map projection for a declination."""
    return F.when(F.abs(dec) <= 60, "Mercator").when(F.abs(dec) <= 75, "Miller").otherwise("Lambert")


def circle(ra: Column, dec: Column, radius: Column, points: int = 101) -> Column:
    """An array of (ra, dec) around a position, widened by the declination and clamped at the poles."""
    wide = F.greatest(F.abs(F.cos(F.radians(dec))), F.lit(0.001))

    def at(i: Column) -> Column:
        a = i * (2 * math.pi / (points - 1))
        return F.struct((ra + radius * F.cos(a) / wide).alias("ra"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), dec + radius * F.sin(a))).alias("dec"))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def crosshair(ra: Column, dec: Column, half: float = 0.15) -> Column:
    """The ends (left, right, bottom, top) of a cross at a position."""
    wide = half / F.greatest(F.abs(F.cos(F.radians(dec))), F.lit(0.01))
    return F.struct((ra - wide).alias("left"), (ra + wide).alias("right"), (dec - half).alias("bottom"), (dec + half).alias("top"))


def sky_box(ra: Column, dec: Column, center_ra: Column, center_dec: Column, half: float = 10.0) -> Column:
    """Whether a position lies in the box of ``half`` degrees around a centre, through right ascension 0 too."""
    apart = F.abs(F.pmod(ra - center_ra + 180.0, F.lit(360.0)) - 180.0)
    return (apart <= half) & dec.between(F.greatest(F.lit(-90.0), center_dec - half), F.least(F.lit(90.0), center_dec + half))


def field_of_view(focal: Column, width: Column, height: Column) -> dict[str, Column]:
    """Fields of view of a camera: sides in degrees (two formulas), the diagonal in arcmin."""
    return {
        "fov_w": 57.3 * width / focal, "fov_h": 57.3 * height / focal,
        "diagonal": 2 * F.atan(F.hypot(width, height) / (2 * focal)) * 3437.75,
        "title_w": 2 * 180.0 / 3.14159 * (width / 2) / focal, "title_h": 2 * 180.0 / 3.14159 * (height / 2) / focal,
    }


def smallest_size(focal: Column, width: Column, height: Column, percent: Column) -> Column:
    """The size in arcmin that fills ``percent`` of the shorter side."""
    fov = field_of_view(focal, width, height)
    return F.least(fov["fov_w"], fov["fov_h"]) * percent / 100.0 * 60.0


def surface_brightness(mag: Column, size: Column) -> Column:
    """Magnitude spread over a disc of the given diameter; 99 for no size."""
    return F.when(size <= 0, 99.0).otherwise(mag + 2.5 * F.log10(math.pi * F.pow(size / 2, 2)))
