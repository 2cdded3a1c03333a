"""Positions on the sphere: usable coordinates, unit vectors, distances, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from asterweave.runtime import number


def usable_ra(ra: Column) -> Column:
    """Right ascension in degrees modulo 360, or null where it is not finite."""
    r = F.pmod(number(ra), F.lit(360.0))
    return F.when(r >= 360.0, F.lit(0.0)).otherwise(r)


def usable_dec(dec: Column) -> Column:
    """Declination in degrees, or null outside -90 to 90."""
    d = number(dec)
    return F.when(d.between(-90.0, 90.0), d)


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """x, y, z of a direction given in degrees."""
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def chord(arcmin: float) -> float:
    """Straight-line length between unit vectors ``arcmin`` apart."""
    return 2.0 * math.sin(math.radians(arcmin / 60.0) / 2.0)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees (haversine form, exact for small angles)."""
    h = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(
        F.sin(F.radians(ra2 - ra1) / 2), 2
    )
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


#: Cells are numbered per axis with so many bits and packed into one long.
AXIS_BITS = 21


def packed(ix: Column, iy: Column, iz: Column) -> Column:
    """One long for three cell indices, each offset to be non-negative."""
    off = 1 << (AXIS_BITS - 1)

    def up(i: Column) -> Column:
        return i.cast("long") + F.lit(off)

    return up(ix) * F.lit(1 << (2 * AXIS_BITS)) + up(iy) * F.lit(1 << AXIS_BITS) + up(iz)


def cell_of(x: Column, y: Column, z: Column, side: float) -> Column:
    """The packed index of the cubic cell of ``side`` that holds a unit vector."""
    if side < 2.5 / (1 << AXIS_BITS):
        raise ValueError("cells this small cannot be numbered")
    return packed(F.floor(x / side), F.floor(y / side), F.floor(z / side))
