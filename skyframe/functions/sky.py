"""Sky geometry as column expressions. Angles are radians unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
TWO_PI = 2 * math.pi
ARCSEC = math.pi / (180 * 3600)
J2000 = 2451545.0

#: J2000 north galactic pole and the position angle of the node, radians.
POLE_RA = (12 + 51 / 60 + 26.27549 / 3600) * math.pi / 12
POLE_DEC = (27 + 7 / 60 + 41.7043 / 3600) * math.pi / 180
NODE_PA = (122.93191857 - 90) * math.pi / 180
#: Sidereal angle at J2000 and its daily rate, radians.
SIDEREAL_2000 = 280.46061837 * math.pi / 180
SIDEREAL_RATE = TWO_PI * 1.00273790935


def turn(x: Column, whole: float = TWO_PI) -> Column:
    """x in [0, whole)."""
    return F.pmod(x, F.lit(whole))


def half_turn(x: Column, whole: float = TWO_PI) -> Column:
    """x in [-whole/2, whole/2)."""
    return F.pmod(x + whole / 2, F.lit(whole)) - whole / 2


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def ang_sep(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    return F.acos(clamp(F.sin(dec1) * F.sin(dec2) + F.cos(dec1) * F.cos(dec2) * F.cos(ra1 - ra2), -1.0, 1.0))


def position_angle(ra1: Column, dec1: Column, ra0: Column, dec0: Column) -> Column:
    """Direction of point 1 as seen from point 0, north through east."""
    return F.atan2(F.cos(dec1) * F.sin(ra1 - ra0), F.sin(dec1) * F.cos(dec0) - F.cos(dec1) * F.sin(dec0) * F.cos(ra1 - ra0))


def galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Longitude (not normalised) and latitude."""
    sin_b = F.cos(dec) * math.cos(POLE_DEC) * F.cos(ra - POLE_RA) + F.sin(dec) * math.sin(POLE_DEC)
    lon = F.atan2(F.sin(dec) - sin_b * math.sin(POLE_DEC), F.cos(dec) * math.cos(POLE_DEC) * F.sin(ra - POLE_RA)) + NODE_PA
    return lon, F.asin(clamp(sin_b, -1.0, 1.0))


def precess(ra: Column, dec: Column, jd_from: Column, jd_to: Column) -> tuple[Column, Column]:
    """IAU 1976 precession between two epochs."""
    c = (jd_from - J2000) / 36525.0
    t = (jd_to - jd_from) / 36525.0
    both = (2306.2181 + 1.39656 * c - 0.000139 * c * c) * t
    zeta = (both + (0.30188 - 0.000344 * c) * t * t + 0.017998 * t * t * t) * ARCSEC
    z = (both + (1.09468 + 0.000066 * c) * t * t + 0.018203 * t * t * t) * ARCSEC
    theta = ((2004.3109 - 0.85330 * c - 0.000217 * c * c) * t - (0.42665 + 0.000217 * c) * t * t - 0.041833 * t * t * t) * ARCSEC
    a = F.cos(dec) * F.sin(ra + zeta)
    b = F.cos(theta) * F.cos(dec) * F.cos(ra + zeta) - F.sin(theta) * F.sin(dec)
    s = F.sin(theta) * F.cos(dec) * F.cos(ra + zeta) + F.cos(theta) * F.sin(dec)
    return turn(F.atan2(a, b) + z), F.asin(clamp(s, -1.0, 1.0))


def to_standard(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Gnomonic standard coordinates about (ra0, dec0)."""
    d = F.sin(dec) * F.sin(dec0) + F.cos(dec) * F.cos(dec0) * F.cos(ra - ra0)
    return F.cos(dec) * F.sin(ra - ra0) / d, (F.sin(dec) * F.cos(dec0) - F.cos(dec) * F.sin(dec0) * F.cos(ra - ra0)) / d


def from_standard(x: Column, y: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    d = F.cos(dec0) - y * F.sin(dec0)
    ra = turn(ra0 + F.atan2(x, d))
    return ra, F.atan2((F.sin(dec0) + y * F.cos(dec0)), F.sqrt(x * x + d * d))


def distorted(u: Column, v: Column, terms: tuple[dict, dict]) -> tuple[Column, Column]:
    """u and v plus their SIP polynomials: for each a dict of factors by the powers (of u, of v)."""
    power = lambda c, n: c if n == 1 else c * power(c, n - 1)

    def term(factor: float, i: int, j: int) -> Column:
        out = F.lit(float(factor))
        for c, n in ((u, i), (v, j)):
            out = out * power(c, n) if n else out
        return out

    return tuple(sum((term(f, *ij) for ij, f in t.items()), c) for c, t in zip((u, v), terms, strict=True))


def to_pixel(ra: Column, dec: Column, w: dict) -> tuple[Column, Column]:
    """World to pixel (counted from 1). w: ra0, dec0, crpix1, crpix2 and cd1_1 .. cd2_2 in degrees, columns or numbers;
    sip and sip_inverse, if there, are the distortion's terms (see `distorted`)."""
    xi, eta = to_standard(ra, dec, F.lit(w["ra0"]), F.lit(w["dec0"]))
    xi, eta = xi * (180 / PI), eta * (180 / PI)
    det = w["cd1_1"] * w["cd2_2"] - w["cd1_2"] * w["cd2_1"]
    u, v = (w["cd2_2"] * xi - w["cd1_2"] * eta) / det, (w["cd1_1"] * eta - w["cd2_1"] * xi) / det
    u, v = distorted(u, v, w["sip_inverse"]) if "sip_inverse" in w else (u, v)
    return w["crpix1"] + u, w["crpix2"] + v


def to_sky(x: Column, y: Column, w: dict) -> tuple[Column, Column]:
    u, v = x - w["crpix1"], y - w["crpix2"]
    u, v = distorted(u, v, w["sip"]) if "sip" in w else (u, v)
    return from_standard((w["cd1_1"] * u + w["cd1_2"] * v) * (PI / 180), (w["cd2_1"] * u + w["cd2_2"] * v) * (PI / 180), F.lit(w["ra0"]), F.lit(w["dec0"]))


def horizontal(ra: Column, dec: Column, lat: Column, sidereal: Column) -> tuple[Column, Column]:
    """Azimuth (from north through east) and altitude at local sidereal angle."""
    h = ra - sidereal
    x = F.cos(dec) * F.sin(lat) * F.cos(h) - F.sin(dec) * F.cos(lat)
    y = F.cos(dec) * F.sin(h)
    z = F.cos(dec) * F.cos(lat) * F.cos(h) + F.sin(dec) * F.sin(lat)
    return turn(F.lit(PI) - turn(F.atan2(y, x))), F.atan2(z, F.sqrt(x * x + y * y))


def equatorial(az: Column, alt: Column, lat: Column, sidereal: Column) -> tuple[Column, Column]:
    x = F.cos(alt) * F.sin(lat) * F.cos(az) - F.sin(alt) * F.cos(lat)
    y = F.cos(alt) * F.sin(az)
    z = F.cos(alt) * F.cos(lat) * F.cos(az) + F.sin(alt) * F.sin(lat)
    return turn(F.lit(PI) - turn(F.atan2(y, x)) + sidereal), F.atan2(z, F.sqrt(x * x + y * y))


def sidereal(jd: Column, longitude: Column) -> Column:
    return turn(longitude + SIDEREAL_2000 + (jd - J2000) * SIDEREAL_RATE)


def refraction(altitude_deg: Column, pressure: float = 1010.0, temperature: float = 10.0) -> Column:
    """Degrees to add to a true altitude; 100 degrees of temperature or more mean that it isn't known."""
    temperature = 10.0 if temperature >= 100 else temperature
    a = (altitude_deg + 10.3 / (altitude_deg + 5.11)) * (PI / 180)
    return (pressure / 1010.0 * 283.0 / (273.0 + temperature)) * (1.02 / 60.0) / (F.sin(a) / F.cos(a))


def airmass(altitude_deg: Column) -> Column:
    """999 at or below the horizon."""
    up = altitude_deg >= 1.0e-7
    a = F.when(up, altitude_deg).otherwise(F.lit(90.0))
    return F.when(up, 1.0 / F.sin((PI / 180) * (a + 244.0 / (165.0 + 47.0 * F.pow(a, F.lit(1.1)))))).otherwise(F.lit(999.0))


def extinction(air: Column) -> Column:
    """Magnitudes lost to ozone, molecules and aerosol."""
    return air * 0.016 + air * 0.1451 + air * 0.120


def sky_quality(mzero: Column, background: Column, pedestal: Column, pixel_arcsec: Column, altitude_deg: Column) -> Column:
    """Magnitudes per square arc second at the zenith; null where it isn't defined."""
    flux = (background - pedestal) / (pixel_arcsec * pixel_arcsec)
    ok = (flux > 0) & (altitude_deg > 0)
    return F.when(ok, mzero - F.log(F.when(ok, flux).otherwise(1.0)) * (2.5 / math.log(10)) + extinction(airmass(altitude_deg)) - 0.28)


#: The least brightness of each class, and its name.
BORTLE = [
    (21.99, "Bortle 1, excellent dark-sky site"),
    (21.89, "Bortle 2, truly dark site"),
    (21.69, "Bortle 3, dark rural sky"),
    (21.25, "Bortle 4, rural sky"),
    (20.49, "Bortle 4.5, rural/suburban sky"),
    (19.50, "Bortle 5, suburban sky"),
    (18.94, "Bortle 6, bright suburban sky"),
    (18.38, "Bortle=7, suburban/urban sky"),
    (17.80, "Bortle 8, city sky"),
]
BORTLE_LAST = "Bortle 9, inner-city sky"


def bortle(sqm: Column) -> Column:
    out = F.lit(BORTLE_LAST)
    for least, name in reversed(BORTLE):
        out = F.when(sqm > least, name).otherwise(out)
    return out


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Radius, longitude in [0, 2 pi), latitude."""
    return F.sqrt(x * x + y * y + z * z), turn(F.atan2(y, x)), F.atan2(z, F.sqrt(x * x + y * y))


def cartesian(r: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat)


def separation_text(sep_deg: Column) -> Column:
    """Arc seconds, minutes or degrees by size."""
    fixed = lambda x: F.format_string("%.2f", x)
    return F.when(sep_deg < 1 / 60, F.concat(F.floor(sep_deg * 3600 + 0.5).cast("string"), F.lit('"'))).when(sep_deg < 1, F.concat(fixed(sep_deg * 60), F.lit("'"))).otherwise(F.concat(fixed(sep_deg), F.lit("°")))


def line_distance(x: Column, y: Column, slope: Column, intercept: Column) -> Column:
    return F.abs(slope * x - y + intercept) / F.sqrt(slope * slope + 1)
