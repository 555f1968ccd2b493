"""Time as column expressions: Julian dates, delta T, the Sun and the Earth."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyframe.functions.sky import ARCSEC, J2000, PI, precess, turn


def trunc(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def julian(year: Column, month: Column, day: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    """Julian date; the calendar changes after 1582-10-04."""
    early = month <= 2
    y = F.when(early, year - 1).otherwise(year).cast("double")
    m = F.when(early, month + 12).otherwise(month).cast("double")
    d = day + hours / 24.0 + minutes / 1440.0 + seconds / 86400.0
    a = trunc(y / 100.0)
    b = F.when(year + month / 100.0 + d / 10000.0 < 1582.10149999, 0.0).otherwise(2.0 - a + trunc(a / 4.0))
    return trunc(365.25 * y - F.when(y < 0, 0.75).otherwise(0.0)) + trunc(F.lit(30.6001) * (m + 1)) + d + b + 1720994.5


def julian_of(ts: Column) -> Column:
    """Of a timestamp."""
    return julian(F.year(ts).cast("double"), F.month(ts).cast("double"), F.dayofmonth(ts).cast("double"), F.hour(ts).cast("double"), F.minute(ts).cast("double"), F.second(ts).cast("double"))


def julian_of_text(text: Column, exposure: Column | None = None) -> Column:
    """Of a date such as 2024-05-06T07:08:09.5, half an exposure later if given; null if a field is no number."""
    part = lambda a, n: F.substring(text, a, n).try_cast("double")
    jd = julian(part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 7))
    return jd if exposure is None else jd + exposure / (2.0 * 86400.0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), for which value is worked out once: as a plain column it would be repeated at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _calendar(jd: Column) -> tuple[Column, Column, Column, Column]:
    """Year, month, day and the part of the day, half a second on."""

    def gregorian(z: Column) -> Column:
        return _let(trunc((z - 1867216.25) / 36524.25), lambda g: F.when(z < 2299160.5, z).otherwise(z + 1 + g - trunc(g / 4.0)))

    def date(c: Column, rest: Column, e: Column) -> Column:
        month = F.when(e < 14, e - 1).otherwise(e - 13)
        return F.struct(F.when(month > 2, c - 4716).otherwise(c - 4715).alias("y"), month.alias("m"), (rest - trunc(30.6001 * e)).alias("d"))

    def from_march(b: Column) -> Column:
        return _let(trunc((b - 122.1) / 365.25), lambda c: _let(b - trunc(365.25 * c), lambda rest: _let(trunc(rest / 30.6001), lambda e: date(c, rest, e))))

    noon = jd + (0.5 / 86400.0) + 0.5
    z = trunc(noon)
    found = _let(gregorian(z) + 1524.0, from_march)
    return found["y"], found["m"], found["d"], noon - z


def two(x: Column) -> Column:
    """At least two digits."""
    return F.lpad(x.cast("long").cast("string"), 2, "0")


def date_of(jd: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS."""
    y, m, d, f = _calendar(jd)
    s = F.floor(f * 86400.0).cast("double")
    h = trunc(s / 3600)
    mi = trunc((s - h * 3600) / 60)
    return F.concat(F.lpad(y.cast("long").cast("string"), 4, " "), F.lit("-"), two(m), F.lit("-"), two(d), F.lit("T"), two(h), F.lit(":"), two(mi), F.lit(":"), two(s - h * 3600 - mi * 60))


def mpc_date(jd: Column) -> Column:
    """YYYY MM DD.ddddd."""
    y, m, d, f = _calendar(jd)
    return F.concat(F.lpad(y.cast("long").cast("string"), 4, " "), F.lit(" "), two(m), F.lit(" "), F.lpad(F.format_string("%.5f", d + f), 8, "0"))


def julian_of_unix(seconds: Column) -> Column:
    return seconds / 86400.0 + 2440587.5


def delta_t(jd: Column) -> Column:
    """Terrestrial less universal time, days."""
    y = 2000.0 + (jd - 2451544.5) / 365.25
    year = F.floor(y + 0.5)
    u, t = (y - 1820.0) / 100.0, y - 2000.0
    s = (
        F.when(year.between(2016, 2020), 68.3 + (y - 2016.0) * 0.54)
        .when(year.between(2021, 2024), 71.0 + (y - 2021.0) * 0.5)
        .when(year.between(2025, 2049), 61.46 + t * (0.32217 + t * 0.005589))
        .when(year.between(2050, 2149), -20.0 + 32.0 * u * u - 0.5788 * (2150.0 - y))
        .when(year.between(2150, 2999), -20.0 + 32.0 * u * u)
        .otherwise(60.0)
    )
    return s / 86400.0


def sun_of_date(jd: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the Sun for the equinox of date, to about an arc minute."""
    cos_e, sin_e = 0.9174369450421712, 0.3977769691456674
    t = (jd - J2000) / 36525.0
    m = 2 * PI * F.pmod(0.993133 + 99.997361 * t, F.lit(1.0))
    dl = 6893.0 * F.sin(m) + 72.0 * F.sin(2.0 * m)
    lon = 2 * PI * F.pmod(0.7859453 + m / (2 * PI) + (6191.2 * t + dl) / 1296.0e3, F.lit(1.0))
    z = sin_e * F.sin(lon)
    return turn(F.atan2(cos_e * F.sin(lon), F.cos(lon))), F.asin(z)


def sun_side_days(jd: Column, ra: Column, dec: Column) -> Column:
    """Days that light takes from a J2000 position's plane through the Sun to the Earth: 500 s along the line to the Sun."""
    sra, sdec = precess(*sun_of_date(jd), jd, F.lit(J2000))
    return 500.0 / 86400.0 * (F.sin(dec) * F.sin(sdec) + F.cos(dec) * F.cos(sdec) * F.cos(ra - sra))


def heliocentric(jd: Column, ra: Column, dec: Column) -> Column:
    """HJD of a J2000 position."""
    return jd - sun_side_days(jd, ra, dec)


def sun_low_precision(jd: Column) -> tuple[Column, Column, Column, Column]:
    """True longitude, distance, true anomaly and eccentricity."""
    t = (jd - J2000) / 36525.0
    m = (357.52911 + 35999.05029 * t - 0.0001537 * t * t) * (PI / 180)
    e = 0.016708634 - 0.000042037 * t - 0.0000001267 * t * t
    c = ((1.914602 - 0.004817 * t - 0.000014 * t * t) * F.sin(m) + (0.019993 - 0.000101 * t) * F.sin(2.0 * m) + 0.000289 * F.sin(3.0 * m)) * (PI / 180)
    nu = m + c
    lon = (280.46646 + 36000.76983 * t + 0.0003032 * t * t) * (PI / 180) + c
    return turn(lon), 1.000001018 * (1.0 - e * e) / (1.0 + e * F.cos(nu)), nu, e


#: J2000 obliquity of the ecliptic, radians.
OBLIQUITY = 84381.448 * ARCSEC


def ecliptic_to_equatorial(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    c, s = math.cos(OBLIQUITY), math.sin(OBLIQUITY)
    return x, c * y - s * z, s * y + c * z


def earth_position(jd: Column) -> tuple[Column, Column, Column]:
    """Heliocentric, J2000 equator, AU."""
    lon, r, _, _ = sun_low_precision(jd)
    t = (jd - J2000) / 36525.0
    lon = lon + PI - (5028.796195 * t + 1.1054348 * t * t) * ARCSEC
    return ecliptic_to_equatorial(r * F.cos(lon), r * F.sin(lon), F.lit(0.0))
