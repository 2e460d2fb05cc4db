"""Coordinate systems of points as column expressions: geographic, Web Mercator and the transverse
Mercator family. Datums count as one (WGS84 and ETRS89 differ by less than a metre)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoids and the published zones.
WGS84, GRS80 = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101)


@dataclass(frozen=True)
class TransverseMercator:
    """Central meridian in degrees, scale on it, false easting and northing, (axis, flattening)."""

    meridian: float
    scale: float
    easting: float
    northing: float
    ellipsoid: tuple[float, float] = GRS80

    @property
    def _third(self) -> float:
        return self.ellipsoid[1] / (2 - self.ellipsoid[1])

    @property
    def _radius(self) -> float:
        n = self._third
        return self.scale * self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Series in the third flattening to the fourth order: well below a millimetre in a zone."""
        n, f = self._third, self.ellipsoid[1]
        ecc = (f * (2 - f)) ** 0.5
        s, away = F.sin(F.radians(lat)), F.radians(lon - self.meridian)
        t = F.sinh(F.atanh(s) - ecc * F.atanh(ecc * s))
        u, v = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) ** 2))
        terms = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        north = u + sum(k * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, k in enumerate(terms, 1))
        east = v + sum(k * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, k in enumerate(terms, 1))
        return self._radius * east + self.easting, self._radius * north + self.northing

    def unproject(self, x: Column, y: Column) -> tuple[Column, Column]:
        n = self._third
        v, u = (x - self.easting) / self._radius, (y - self.northing) / self._radius
        terms = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        up = u - sum(k * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, k in enumerate(terms, 1))
        out = v - sum(k * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, k in enumerate(terms, 1))
        chi = F.asin(F.sin(up) / F.cosh(out))
        back = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
        lat = chi + sum(k * F.sin(2 * j * chi) for j, k in enumerate(back, 1))
        return F.degrees(F.atan2(F.sinh(out), F.cos(up))) + self.meridian, F.degrees(lat)


@dataclass(frozen=True)
class Geographic:
    """Degrees, longitude first."""

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    unproject = project


@dataclass(frozen=True)
class WebMercator:
    radius: float = WGS84[0]

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.radians(lon) * self.radius, F.asinh(F.tan(F.radians(lat))) * self.radius

    def unproject(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(x / self.radius), F.degrees(F.atan(F.sinh(y / self.radius)))


def system(code: str):
    """The system of an EPSG code: 4326, 4258, 3857, UTM (326xx, 327xx, 258xx), 2180, 2176 to 2179."""
    found = re.fullmatch(r"(?:EPSG:)?(\d{4,5})", code.strip(), re.IGNORECASE)
    number = int(found[1]) if found else 0
    zone = number % 100
    if number in (4326, 4258):
        return Geographic()
    if number == 3857:
        return WebMercator()
    if number // 100 in (326, 327) and 1 <= zone <= 60:
        return TransverseMercator(6 * zone - 183, 0.9996, 500000.0, 0.0 if number < 32700 else 10000000.0, WGS84)
    if 25828 <= number <= 25838:
        return TransverseMercator(6 * zone - 183, 0.9996, 500000.0, 0.0)
    if number == 2180:
        return TransverseMercator(19, 0.9993, 500000.0, -5300000.0)
    if 2176 <= number <= 2179:
        return TransverseMercator(3 * (number - 2171), 0.999923, 1e6 * (number - 2171) + 5e5, 0.0)
    raise ValueError(f"no coordinate system {code!r}")


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates in another system; as they are if either system is unknown ("") or both agree."""
    if not source or not target or source == target:
        return x, y
    return system(target).project(*system(source).unproject(x, y))
