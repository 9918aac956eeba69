"""Map projections of WGS 84 as column expressions: the cylindrical equal-area grid of EPSG:6933 and UTM.

Degrees in, metres out, and back. Everything is arithmetic on columns, so it stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84: semi-major axis and flattening; the equal-area grid's standard parallel; UTM's scale and false origin.
A, FLATTENING = 6378137.0, 1 / 298.257223563
PARALLEL = 30.0
SCALE, EASTING, NORTHING = 0.9996, 500000.0, 10000000.0
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _q(sine: Column) -> Column:
    """The authalic function of a latitude's sine."""
    return (1 - _E2) * (sine / (1 - _E2 * sine * sine) - F.log((1 - _E * sine) / (1 + _E * sine)) / (2 * _E))


_QP = (1 - _E2) * (1 / (1 - _E2) - math.log((1 - _E) / (1 + _E)) / (2 * _E))
_K0 = math.cos(math.radians(PARALLEL)) / math.sqrt(1 - _E2 * math.sin(math.radians(PARALLEL)) ** 2)


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x, y in EPSG:6933."""
    return F.radians(lon) * (A * _K0), _q(F.sin(F.radians(lat))) * (A / (2 * _K0))


def from_equal_area(x: Column, y: Column) -> tuple[Column, Column]:
    """lon, lat of a place in EPSG:6933; the latitude by the series of the authalic latitude, exact to a millimetre."""
    beta = F.asin(y * (2 * _K0 / (A * _QP)))
    e4, e6 = _E2**2, _E2**3
    lat = beta + (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    return F.degrees(x / (A * _K0)), F.degrees(lat)


_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_CONFORMAL = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def _meridian(zone: Column) -> Column:
    return zone.cast("double") * 6 - 183


def utm(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """easting, northing in the UTM zone (that of lon if none is given), by Krueger's series; south of the equator with the false northing."""
    zone = utm_zone(lon) if zone is None else zone
    sine, away = F.sin(F.radians(lat)), F.radians(lon - _meridian(zone))
    t = F.sinh(F.atanh(sine) - _E * F.atanh(_E * sine))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        east, north = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * _RADIUS * east, F.when(lat < 0, NORTHING).otherwise(0.0) + SCALE * _RADIUS * north


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """lon, lat."""
    xi, eta = (northing - F.when(south, NORTHING).otherwise(0.0)) / (SCALE * _RADIUS), (easting - EASTING) / (SCALE * _RADIUS)
    a, b = xi, eta
    for j, c in enumerate(_BACK, 1):
        a, b = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta), b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(_CONFORMAL, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + _meridian(zone), F.degrees(lat)


def project_ring(ring: str, to) -> Column:
    """A ring (array<struct<x, y>> of degrees) in another projection: to(lon, lat) gives x, y."""
    return F.transform(ring, lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", to(p["x"], p["y"]), strict=True)]))
