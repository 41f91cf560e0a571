"""Places on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def chord(radius_arcsec: float) -> float:
    return 2 * math.sin(math.radians(radius_arcsec / 3600) / 2)


def arcsec(squared_chord: Column) -> Column:
    """Arc seconds of a squared chord; null for null, which least() alone would pass over."""
    return F.when(squared_chord.isNotNull(), F.degrees(2 * F.asin(F.least(F.sqrt(squared_chord) / 2, F.lit(1.0)))) * 3600)


def _spread(x: Column) -> Column:
    """The bits of x, one to every second place: its binary digits read in base 4."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def nested_pixel(ra: Column, dec: Column, order: int) -> Column:
    """The nested HEALPix pixel of a place in degrees, order 0 to 29. A pixel's parent is the pixel shifted right by 2 bits.

    Equatorial places lie on two diagonals of their face, polar ones on two edges towards the pole.
    """
    side = 1 << order
    z, turn = F.sin(F.radians(dec)), F.pmod(ra, F.lit(360.0)) / 90.0
    whole = lambda c: F.floor(c).cast("long")
    down, up = whole(side * (0.5 + turn - 0.75 * z)), whole(side * (0.5 + turn + 0.75 * z))
    f_down, f_up = F.shiftright(down, order), F.shiftright(up, order)
    belt_face = F.when(f_down == f_up, f_down % 4 + 4).when(f_down < f_up, f_down).otherwise(f_up + 8)
    belt_x, belt_y = up % side, side - 1 - down % side
    corner = F.least(whole(turn), F.lit(3).cast("long"))
    reach = side * F.sqrt(3.0 * (1.0 - F.abs(z)))
    last = F.lit(side - 1).cast("long")
    a, b = F.least(whole((turn - corner) * reach), last), F.least(whole((corner + 1 - turn) * reach), last)
    belt, north = F.abs(z) <= 2.0 / 3.0, z > 0
    face = F.when(belt, belt_face).when(north, corner).otherwise(corner + 8)
    x = F.when(belt, belt_x).when(north, last - b).otherwise(a)
    y = F.when(belt, belt_y).when(north, last - a).otherwise(b)
    return face * (side * side) + _spread(x) + F.shiftleft(_spread(y), 1)
