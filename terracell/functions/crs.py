"""Map projections in closed form, on plain numbers and on Columns alike (J. P. Snyder, Map Projections: A Working Manual, 1987)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = SimpleNamespace(sin=math.sin, cos=math.cos, asin=math.asin, atan2=math.atan2, sqrt=math.sqrt, log=math.log, sinh=math.sinh, cosh=math.cosh, atanh=math.atanh, floor=math.floor, abs=abs, positive=lambda a: max(a, 0.0), divide=lambda a, b: a / b)
COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, asin=F.asin, atan2=F.atan2, sqrt=F.sqrt, log=F.log, sinh=F.sinh, cosh=F.cosh, atanh=F.atanh, floor=F.floor, abs=F.abs, positive=lambda a: F.greatest(a, F.lit(0.0)), divide=lambda a, b: F.try_divide(F.lit(a), b))

# Semi-major axis in metres and inverse flattening of the ellipsoids.
GRS80 = (6378137.0, 298.257222101)
WGS84 = (6378137.0, 298.257223563)


def wrapped(turn: Any, m: SimpleNamespace, period: float = 360.0) -> Any:
    """An angle moved by whole turns into [-period / 2, period / 2)."""
    return turn - period * m.floor((turn + period / 2) / period)


class Transform:
    """From longitude and latitude in degrees to a projection's x and y in metres, and back.

    Outside of a projection's domain, columns are NULL and plain numbers raise ValueError.
    """

    def project(self, lon: Any, lat: Any, m: SimpleNamespace) -> tuple[Any, Any]:
        raise NotImplementedError

    def unproject(self, x: Any, y: Any, m: SimpleNamespace) -> tuple[Any, Any]:
        raise NotImplementedError

    def room(self, lon: Any, lat: Any, m: SimpleNamespace) -> list[Any]:
        """All positive where a longitude and latitude can be projected."""
        return []

    def inverse_room(self, x: Any, y: Any, m: SimpleNamespace) -> list[Any]:
        """All positive where x and y stand for a place."""
        return []

    def point(self, lon: float, lat: float) -> tuple[float, float]:
        return _numbers(self.project, self.room, lon, lat)

    def inverse_point(self, x: float, y: float) -> tuple[float, float]:
        return _numbers(self.unproject, self.inverse_room, x, y)

    def columns(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return _nulls(self.project, self.room, lon, lat)

    def inverse_columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        return _nulls(self.unproject, self.inverse_room, x, y)


def _numbers(f: Any, room: Any, a: float, b: float) -> tuple[float, float]:
    try:
        if all(r > 0 for r in room(a, b, PLAIN)) and all(map(math.isfinite, out := f(a, b, PLAIN))):
            return out
    except (ZeroDivisionError, OverflowError):
        pass
    raise ValueError(f"({a}, {b}) is outside of the projection")


def _nulls(f: Any, room: Any, a: Column, b: Column) -> tuple[Column, Column]:
    x, y = f(a, b, COLUMNS)
    for r in room(a, b, COLUMNS):
        x, y = F.when((r > 0) & ~F.isnan(r), x), F.when((r > 0) & ~F.isnan(r), y)
    return x, y


@dataclass(frozen=True)
class Geographic(Transform):
    """Longitude and latitude themselves."""

    def project(self, lon, lat, m):
        return lon, lat

    def unproject(self, x, y, m):
        return x, y

    def columns(self, lon, lat):
        return lon, lat

    def inverse_columns(self, x, y):
        return x, y


def _square_eccentricity(ellipsoid: tuple[float, float]) -> float:
    f = 1 / ellipsoid[1]
    return f * (2 - f)


def _q(sine, e: float, m):
    """Snyder's q (3-12), of a latitude's sine."""
    return (1 - e * e) * (sine / (1 - e * e * sine * sine) - m.log((1 - e * sine) / (1 + e * sine)) / (2 * e))


def _latitude(s, e2: float, m):
    """Latitude of an authalic latitude's sine (3-18, its multiple angles as powers of the sine)."""
    a, b, c = e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360
    s2 = s * s
    return m.asin(s) + s * m.sqrt(m.positive(1 - s2)) * ((2 * a + 4 * b + 6 * c) - s2 * ((8 * b + 32 * c) - s2 * (32 * c)))


@dataclass(frozen=True)
class EqualAreaAzimuthal(Transform):
    """Lambert azimuthal equal-area on an ellipsoid (24-17 to 24-26); up to some tenths of a degree from the antipode."""

    lat0: float
    lon0: float
    easting: float = 0.0
    northing: float = 0.0
    ellipsoid: tuple[float, float] = GRS80

    def _constants(self):
        a, e2 = self.ellipsoid[0], _square_eccentricity(self.ellipsoid)
        e, s = math.sqrt(e2), math.sin(math.radians(self.lat0))
        qp, q0 = _q(1.0, e, PLAIN), _q(s, e, PLAIN)
        beta, rq = math.asin(q0 / qp), a * math.sqrt(qp / 2)
        return e2, e, qp, beta, rq, a * math.cos(math.radians(self.lat0)) / math.sqrt(1 - e2 * s * s) / (rq * math.cos(beta))

    def project(self, lon, lat, m):
        _, e, qp, b0, rq, d = self._constants()
        turn = (lon - self.lon0) * (math.pi / 180)
        s = _q(m.sin(lat * (math.pi / 180)), e, m) / qp  # of the authalic latitude
        c = m.sqrt(m.positive(1 - s * s))
        k = m.sqrt(m.divide(2.0, 1 + math.sin(b0) * s + math.cos(b0) * c * m.cos(turn)))
        return (rq * d) * k * c * m.sin(turn) + self.easting, (rq / d) * k * (math.cos(b0) * s - math.sin(b0) * c * m.cos(turn)) + self.northing

    def room(self, lon, lat, m):
        lat0, turn = math.radians(self.lat0), (lon - self.lon0) * (math.pi / 180)
        return [1 - 1e-5 + math.sin(lat0) * m.sin(lat * (math.pi / 180)) + math.cos(lat0) * m.cos(lat * (math.pi / 180)) * m.cos(turn)]

    def inverse_room(self, x, y, m):
        _, _, _, _, rq, d = self._constants()
        u, v = (x - self.easting) / (2 * rq * d), (y - self.northing) * (d / (2 * rq))
        return [1 - u * u - v * v]

    def unproject(self, x, y, m):
        e2, _, _, b0, rq, d = self._constants()
        u, v = (x - self.easting) / (rq * d), (y - self.northing) * (d / rq)
        k2 = (u * u + v * v) / 4  # the squared sine of half the distance from the centre
        far, near = m.sqrt(m.positive(1 - k2)), 1 - 2 * k2
        turn = m.atan2(u * far, math.cos(b0) * near - math.sin(b0) * v * far)
        return turn * (180 / math.pi) + self.lon0, _latitude(math.sin(b0) * near + math.cos(b0) * v * far, e2, m) * (180 / math.pi)


@dataclass(frozen=True)
class TransverseMercator(Transform):
    """Transverse Mercator on an ellipsoid by Krueger's series in the third flattening to its fourth power: there and back again it is below a millimetre within 55 degrees from the meridian, two decimetres at REACH degrees."""

    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0
    ellipsoid: tuple[float, float] = WGS84

    REACH = 70.0

    def _constants(self):
        """Metres a unit, eccentricity, and the series' coefficients: forward, inverse, and from conformal to geodetic latitude."""
        a, f = self.ellipsoid[0], 1 / self.ellipsoid[1]
        n = f / (2 - f)
        forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        inverse = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
        return self.scale * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), math.sqrt(_square_eccentricity(self.ellipsoid)), forward, inverse, latitude

    def _raw(self, turn, lat, m):
        """(xi, eta) of degrees from the meridian and of latitude, without scale and offsets."""
        _, e, forward, _, _ = self._constants()
        s = m.sin(lat * (math.pi / 180))
        t = m.sinh(m.atanh(s) - e * m.atanh(e * s))
        xi = m.atan2(t, m.cos(turn * (math.pi / 180)))
        eta = m.atanh(m.sin(turn * (math.pi / 180)) / m.sqrt(1 + t * t))
        north, east = xi, eta
        for j, c in enumerate(forward, 1):
            north = north + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
            east = east + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        return north, east

    def project(self, lon, lat, m):
        unit = self._constants()[0]
        north, east = self._raw(wrapped(lon - self.lon0, m), lat, m)
        return unit * east + self.easting, unit * (north - self._raw(0.0, self.lat0, PLAIN)[0]) + self.northing

    def room(self, lon, lat, m):
        return [self.REACH - m.abs(wrapped(lon - self.lon0, m))]

    def inverse_room(self, x, y, m):
        unit = self._constants()[0]
        far = self._raw(self.REACH, 0.0, PLAIN)[1]
        return [far - m.abs((x - self.easting) / unit), math.pi / 2 - m.abs((y - self.northing) / unit + self._raw(0.0, self.lat0, PLAIN)[0])]

    def unproject(self, x, y, m):
        unit, _, _, inverse, latitude = self._constants()
        xi, eta = (y - self.northing) / unit + self._raw(0.0, self.lat0, PLAIN)[0], (x - self.easting) / unit
        north, east = xi, eta
        for j, c in enumerate(inverse, 1):
            north = north - c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
            east = east - c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        chi = m.asin(m.sin(north) / m.cosh(east))
        lat = chi
        for j, c in enumerate(latitude, 1):
            lat = lat + c * m.sin(2 * j * chi)
        return m.atan2(m.sinh(east), m.cos(north)) * (180 / math.pi) + self.lon0, lat * (180 / math.pi)


@dataclass(frozen=True)
class EqualAreaConic(Transform):
    """Albers equal-area conic on an ellipsoid (14-1 to 14-21)."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    easting: float = 0.0
    northing: float = 0.0
    ellipsoid: tuple[float, float] = WGS84

    def _constants(self):
        a, e2 = self.ellipsoid[0], _square_eccentricity(self.ellipsoid)
        e = math.sqrt(e2)
        sines = [math.sin(math.radians(v)) for v in (self.lat1, self.lat2, self.lat0)]
        q1, q2, q0 = (_q(s, e, PLAIN) for s in sines)
        m1, m2 = (math.cos(math.radians(v)) / math.sqrt(1 - e2 * s * s) for v, s in zip((self.lat1, self.lat2), sines))
        n = sines[0] if self.lat1 == self.lat2 else (m1 * m1 - m2 * m2) / (q2 - q1)
        c = m1 * m1 + n * q1
        return a, e2, e, n, c, a * math.sqrt(c - n * q0) / n

    def project(self, lon, lat, m):
        a, _, e, n, c, rho0 = self._constants()
        rho = a * m.sqrt(c - n * _q(m.sin(lat * (math.pi / 180)), e, m)) / n
        turn = n * wrapped(lon - self.lon0, m) * (math.pi / 180)
        return rho * m.sin(turn) + self.easting, rho0 - rho * m.cos(turn) + self.northing

    def inverse_room(self, x, y, m):
        a, _, e, n, c, rho0 = self._constants()
        sign, u, v = 1 if n > 0 else -1, x - self.easting, rho0 - (y - self.northing)
        return [math.pi * abs(n) - m.abs(m.atan2(sign * u, sign * v)), 1 - m.abs((c - (u * u + v * v) * (n * n / (a * a))) / (n * _q(1.0, e, PLAIN)))]

    def unproject(self, x, y, m):
        a, e2, e, n, c, rho0 = self._constants()
        u, v = x - self.easting, rho0 - (y - self.northing)
        sign = 1 if n > 0 else -1
        q = (c - (u * u + v * v) * (n * n / (a * a))) / n
        return m.atan2(sign * u, sign * v) / n * (180 / math.pi) + self.lon0, _latitude(q / _q(1.0, e, PLAIN), e2, m) * (180 / math.pi)


ELLIPSOIDS = {"WGS84": WGS84, "GRS80": GRS80}


def described(text: str) -> Transform:
    """The projection of a +proj string: longlat, laea, aea or utm, on WGS84 or GRS80, in metres."""
    given = dict(x.lstrip("+").partition("=")[::2] for x in text.split() if x.startswith("+"))
    number = lambda k: float(given.get(k, 0.0))
    ellipsoid = ELLIPSOIDS.get(given.get("ellps", given.get("datum", "WGS84")))
    if ellipsoid is not None and given.get("units", "m") == "m":
        if given["proj"] == "longlat":
            return Geographic()
        if given["proj"] == "laea":
            return EqualAreaAzimuthal(number("lat_0"), number("lon_0"), number("x_0"), number("y_0"), ellipsoid)
        if given["proj"] == "aea":
            return EqualAreaConic(number("lat_1"), number("lat_2"), number("lat_0"), number("lon_0"), number("x_0"), number("y_0"), ellipsoid)
        if given["proj"] == "utm":
            return TransverseMercator(6.0 * int(given["zone"]) - 183, northing=10_000_000.0 if "south" in given else 0.0, ellipsoid=ellipsoid)
    raise ValueError(f"no projection known for {text!r}")


def named(crs: str) -> Transform:
    """The projection of a +proj string, or of an EPSG code: 4326, 3035, 31977-31985 (SIRGAS 2000 / UTM, south), and the UTM zones of 258xx, 326xx and 327xx."""
    if "+proj=" in crs:
        return described(crs)
    m = re.fullmatch(r"(?:EPSG:)?(\d{4,5})", crs.strip(), re.IGNORECASE)
    code = int(m[1]) if m else 0
    if code == 4326:
        return Geographic()
    if code == 3035:
        return EqualAreaAzimuthal(52.0, 10.0, 4_321_000.0, 3_210_000.0)
    zone, family = code % 100, code // 100
    if family in (258, 326, 327) and 1 <= zone <= 60:
        return TransverseMercator(6.0 * zone - 183, northing=10_000_000.0 if family == 327 else 0.0, ellipsoid=GRS80 if family == 258 else WGS84)
    if 31977 <= code <= 31985:
        return TransverseMercator(6.0 * (code - 31960) - 183, northing=10_000_000.0, ellipsoid=GRS80)
    raise ValueError(f"no projection known for {crs!r}")
