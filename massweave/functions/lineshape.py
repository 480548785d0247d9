"""Line shapes as column expressions: a peak's profile from its centre, width at half height and height."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian(x: Column, centre: Column, fwhm: Column, height: Column) -> Column:
    z = (x - centre) / fwhm
    return height * F.exp(-4 * math.log(2) * (z * z))


def lorentzian(x: Column, centre: Column, fwhm: Column, height: Column) -> Column:
    z = (x - centre) / fwhm
    return height / (1 + 4 * (z * z))


def pseudo_voigt(x: Column, centre: Column, fwhm: Column, height: Column, fraction: float | Column = 0.5) -> Column:
    """A share ``fraction`` of the Lorentzian, the rest of the Gaussian of the same width and height."""
    r = F.lit(fraction) if isinstance(fraction, float | int) else fraction
    return r * lorentzian(x, centre, fwhm, height) + (1 - r) * gaussian(x, centre, fwhm, height)


def grid(centre: Column, fwhm: Column, reach: int = 2, points: int = 4) -> Column:
    """m/z values around a centre: ``points`` a width, ``reach`` widths to either side."""
    n = reach * points
    return F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda i: centre + fwhm * i / points)


def profile(centre: Column, fwhm: Column, height: Column, shape=gaussian, reach: int = 2, points: int = 4) -> Column:
    """array<struct<mz, abundance>> of one simulated peak."""
    return F.transform(grid(centre, fwhm, reach, points), lambda x: F.struct(x.alias("mz"), shape(x, centre, fwhm, height).alias("abundance")))
