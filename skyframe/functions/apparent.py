"""Apparent places: nutation, aberration, precession; planets near enough for the barycentre."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.sky import ARCSEC, J2000, PI, cartesian, precess, spherical
from skyframe.functions.when import delta_t, ecliptic_to_equatorial, sun_low_precision


def nutated(ra: Column, dec: Column, jd: Column) -> tuple[Column, Column]:
    """Equatorial position with nutation in longitude and obliquity (five terms each)."""
    t = (jd - J2000) / 36525.0
    turn = lambda a, b: 2 * PI * F.pmod(a + b * t, F.lit(1.0))
    ls, d, f, n = turn(0.993133, 99.997306), turn(0.827362, 1236.853087), turn(0.259089, 1342.227826), turn(0.347346, -5.372447)
    eps = 0.4090928 - 2.2696e-4 * t
    dpsi = (-17.200 * F.sin(n) - 1.319 * F.sin(2 * (f - d + n)) - 0.227 * F.sin(2 * (f + n)) + 0.206 * F.sin(2 * n) + 0.143 * F.sin(ls)) * ARCSEC
    deps = (9.203 * F.cos(n) + 0.574 * F.cos(2 * (f - d + n)) + 0.098 * F.cos(2 * (f + n)) - 0.090 * F.cos(2 * n)) * ARCSEC
    x, y, z = cartesian(F.lit(1.0), ra, dec)
    c, s = dpsi * F.cos(eps), dpsi * F.sin(eps)
    _, lon, lat = spherical(x - (c * y + s * z), y + (c * x - deps * z), z + (s * x + deps * y))
    return lon, lat


def earth_velocity(jd: Column) -> tuple[Column, Column, Column]:
    """Heliocentric, J2000 equator, AU a day."""
    lon, r, nu, e = sun_low_precision(jd)
    t = (jd - J2000) / 36525.0
    lon = lon + PI - (5028.796195 * t + 1.1054348 * t * t) * ARCSEC
    dnu = 360.0 / 365.256363004 * (PI / 180) * F.pow(1 + e * F.cos(nu), F.lit(2.0)) / F.pow(1 - e * e, F.lit(1.5))
    dr = r * e * F.sin(nu) * dnu / (1 + e * F.cos(nu))
    return ecliptic_to_equatorial(dr * F.cos(lon) - r * F.sin(lon) * dnu, dr * F.sin(lon) + r * F.cos(lon) * dnu, F.lit(0.0))


def aberrated(ra: Column, dec: Column, jd: Column) -> tuple[Column, Column]:
    """Moved towards the Earth's motion."""
    x, y, z = cartesian(F.lit(1.0), ra, dec)
    vx, vy, vz = earth_velocity(jd)
    k = 0.00577552  # days of light for an AU
    _, lon, lat = spherical(x + vx * k, y + vy * k, z + vz * k)
    return lon, lat


def with_apparent(df: DataFrame, ra: str, dec: str, jd: str) -> DataFrame:
    """Columns ra and dec (J2000) replaced by the place of date jd (universal time). Each step is a column of its own, so
    that expressions don't grow with the number of steps."""

    def step(df: DataFrame, moved: tuple[Column, Column]) -> DataFrame:
        return df.withColumns({"__ra": moved[0], "__dec": moved[1]}).withColumns({ra: F.col("__ra"), dec: F.col("__dec")}).drop("__ra", "__dec")

    df = df.withColumn("__jde", F.col(jd) + delta_t(F.col(jd)))
    df = df.withColumns(dict(zip(("__vx", "__vy", "__vz"), earth_velocity(F.col("__jde")), strict=True)))
    x, y, z = cartesian(F.lit(1.0), F.col(ra), F.col(dec))
    k = 0.00577552
    df = df.withColumns({"__x": x + F.col("__vx") * k, "__y": y + F.col("__vy") * k, "__z": z + F.col("__vz") * k})
    df = step(df, spherical(F.col("__x"), F.col("__y"), F.col("__z"))[1:])
    df = step(df, precess(F.col(ra), F.col(dec), F.lit(J2000), F.col("__jde")))
    df = step(df, nutated(F.col(ra), F.col(dec), F.col("__jde")))
    return df.drop("__jde", "__vx", "__vy", "__vz", "__x", "__y", "__z")


def parallax(x: Column, y: Column, z: Column, sidereal: Column, latitude: float, height_m: float = 100.0) -> tuple[Column, Column, Column]:
    """Geocentric AU to topocentric."""
    flat, au, radius = 0.99664719, 149597870.700, 6378.14
    u = math.atan(flat * math.tan(latitude))
    s = flat * math.sin(u) + height_m * math.sin(latitude) / 6378140.0
    c = math.cos(u) + height_m * math.cos(latitude) / 6378140.0
    return x - radius / au * c * F.cos(sidereal), y - radius / au * c * F.sin(sidereal), z - radius / au * s
