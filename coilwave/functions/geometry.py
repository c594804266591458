"""Rotation of three-axis recordings and map projections, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]

#: Radians in one unit.
RADIANS = {"mrad": 0.001, "milliradians": 0.001, "rad": 1.0, "radians": 1.0, "deg": math.pi / 180, "degrees": math.pi / 180}


def radian_factor(units: str) -> float:
    """Radians in one of `units`; ValueError for an unknown unit."""
    try:
        return RADIANS[units]
    except KeyError:
        raise ValueError(f"unknown unit of angles: {units}") from None


def squared_sines(a: Column, b: Column, c: Column, units: str = "rad") -> tuple[Column, Column, Column]:
    """Squares of the sines of the inclinations of three axes at right angles, scaled so that they add up to one."""
    k = radian_factor(units)
    squares = [F.sin(x * k) ** 2 for x in (a, b, c)]
    return tuple(x / (squares[0] + squares[1] + squares[2]) for x in squares)


def corrected_inclinations(a: Column, b: Column, c: Column, units: str = "rad") -> tuple[Column, Column, Column]:
    """Inclinations of three axes at right angles, whose sines are scaled to unit norm."""
    k = radian_factor(units)
    s = [F.sin(x * k) for x in (a, b, c)]
    norm = F.sqrt(s[0] ** 2 + s[1] ** 2 + s[2] ** 2)
    return tuple(F.asin(x / norm) / k for x in s)


def triaxial_to_geomagnetic(a: Column, b: Column, c: Column, units: str = "rad") -> Matrix:
    """Matrix from three inclined axes at right angles to north, east and down; the horizontal part of the first axis points to magnetic south.

    Inclinations are corrected first and taken as downward. Down is the sum of the axes times their sines, north what is left of the
    first axis turned round, and east closes the frame. A vertical first axis has no direction: its matrix is null."""
    q1, q2, q3 = squared_sines(a, b, c, units)
    s1, s2, s3 = F.sqrt(q1), F.sqrt(q2), F.sqrt(q3)
    flat = F.sqrt(q2 + q3)
    across = F.nullif(flat, F.lit(0.0))
    return [[-flat, s1 * s2 / across, s1 * s3 / across], [F.lit(0.0), -s3 / across, s2 / across], [s1, s2, s3]]


def transposed(m: Matrix) -> Matrix:
    return [list(r) for r in zip(*m, strict=True)]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]


def geomagnetic_to_geographic(declination: Column, units: str = "rad") -> Matrix:
    """Turns magnetic north to true north, about the vertical."""
    d = declination * radian_factor(units)
    zero = F.lit(0.0)
    return [[F.cos(d), -F.sin(d), zero], [F.sin(d), F.cos(d), zero], [zero, zero, F.lit(1.0)]]


def triaxial_to_geographic(a: Column, b: Column, c: Column, declination: Column, units: str = "rad") -> Matrix:
    return product(geomagnetic_to_geographic(declination, units), triaxial_to_geomagnetic(a, b, c, units))


def applied(m: Matrix, x: Column, y: Column, z: Column) -> list[Column]:
    return [r[0] * x + r[1] * y + r[2] * z for r in m]


def azimuths(m: Matrix, units: str = "rad") -> list[Column]:
    """Azimuth of each axis: the direction of its column of the matrix seen from above."""
    k = radian_factor(units)
    return [F.atan2(m[1][j], m[0][j]) / k for j in range(3)]


#: The WGS 84 ellipsoid, and the scale on a zone's middle meridian.
AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def utm(lat: Column, lon: Column, zone: int = 13) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees of latitude and longitude, by Krueger's series to the third order (northern half)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t**2))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + SCALE * radius * east, SCALE * radius * north


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres on the map sheets of the web."""
    return AXIS * F.radians(lon), AXIS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
