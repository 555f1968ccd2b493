"""Photometry and colour as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From broad-band G and BP - RP to a passband; bounds of BP - RP (open or closed), coefficients by power.
GAIA = {
    "V": (-0.5, 5.0, True, [0.02704, -0.01424, 0.2156, -0.01426]),
    "R": (0.0, 4.0, False, [0.02275, -0.3961, 0.1243, 0.01396, -0.003775]),
    "SR": (0.0, 3.0, False, [0.09837, -0.08592, -0.1907, 0.1701, -0.02263]),
    "SI": (0.5, 2.0, False, [0.293, -0.6404, 0.09609, 0.002104]),
    "SG": (0.3, 3.0, False, [-0.2199, 0.6365, 0.1548, -0.0064]),
}
#: Tycho V and B, of which Johnson B is made.
TYCHO_V = [0.01077, 0.0682, 0.2387, -0.02342]
TYCHO_B = [0.004288, 0.8547, -0.1244, 0.9085, -0.4843, 0.06814]


def polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = c + x * out
    return out


def gaia_magnitude(band: str, g: Column, bp: Column, rp: Column) -> Column:
    """0 where it isn't defined: a magnitude is missing, stray light, or the colour is out of bounds."""
    if band == "BP":
        return bp
    c = bp - rp
    flux = lambda m: F.pow(F.lit(10.0), (22.0 - m) / 2.5)
    known = (g != 0) & (bp != 0) & (rp != 0)
    stray = ((flux(bp) + flux(rp)) / flux(g) > 4.0) & (g > bp)
    if band == "B":
        inside = (c > -0.3) & (c < 3.0)
        value = g + polynomial(c, GAIA["V"][3]) + 0.850 * (polynomial(c, TYCHO_B) - polynomial(c, TYCHO_V))
    else:
        low, high, closed, p = GAIA[band]
        inside = c.between(low, high) if closed else (c > low) & (c < high)
        value = g + polynomial(c, p)
    return F.when(known & ~stray & inside, value).otherwise(F.lit(0.0))


def passband(filter_name: Column, database: Column) -> Column:
    """Passband for a filter's name if the database is chosen automatically, else the database's own."""
    f, has = F.upper(filter_name), lambda c, s: F.contains(c, F.lit(s))
    sloan = F.when(has(f, "G"), "SG").when(has(f, "R"), "SR").when(has(f, "I"), "SI").otherwise("BP")
    auto = F.when((f == "") | has(f, "CV"), "BP").when(has(f, "S"), sloan).when(has(f, "G") | has(f, "V"), "V").when(has(f, "B"), "B").when(has(f, "R"), "R").otherwise("BP")
    # the Sloan bands' names hold those of others, so they are looked for first
    own = F.when(has(database, "BP"), "BP")
    for band in ("SG", "SR", "SI", "V", "B", "R"):
        own = own.when(has(database, band), band)
    return F.when(has(database, "auto") | has(database, "Local"), auto).otherwise(own.otherwise("??"))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation, value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(top == low, 1.0).otherwise(top - low)
    h = F.when(top == low, 0.0).when(r == top, 60.0 * (g - b) / d).when(g == top, 60.0 * (2.0 + (b - r) / d)).otherwise(60.0 * (4.0 + (r - g) / d))
    return F.when(h < 0, h + 360.0).otherwise(h), F.when(top == 0, 0.0).otherwise((top - low) / F.when(top == 0, 1.0).otherwise(top)), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Each channel is v less its share of the chroma, by its distance in hue."""

    def channel(n: float) -> Column:
        k = F.pmod(n + h / 60.0, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0)))

    return channel(5.0), channel(3.0), channel(1.0)


def channels_of(colour: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a packed colour (red lowest)."""
    return colour.bitwiseAND(255), F.shiftright(colour, 8).bitwiseAND(255), F.shiftright(colour, 16).bitwiseAND(255)


def kelvin(red: Column, blue: Column) -> Column:
    """Colour temperature as text; empty where the light is too weak or the ratio out of bounds."""
    ok = (blue >= 18) & (red >= 18)
    x = blue / F.when(red == 0, 1.0).otherwise(red)
    t = polynomial(x, [2189.8, -2082.2, 12922.0, -7126.7, -4194.2, 4817.4])
    return F.when(ok & (x > 0.04) & (x < 1.55), F.concat(F.floor(t + 0.5).cast("string"), F.lit("K"))).otherwise("")


def phase_magnitude(g: Column, angle: Column) -> Column:
    """Magnitudes that a minor planet of slope g loses at a phase angle (radians)."""
    t = F.log(F.tan(angle / 2) + 1e-8)
    p1, p2 = F.exp(-3.33 * F.exp(0.63 * t)), F.exp(-1.87 * F.exp(1.22 * t))
    return F.log((1.0 - g) * p1 + g * p2) * (-2.5 / math.log(10))


def illumination(planet: tuple, earth: tuple) -> tuple[Column, Column, Column, Column, Column]:
    """From heliocentric positions: distance to the Sun and to the Earth, elongation and phase angle in degrees, and the
    lit share in per cent."""
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    rs, re, rp = norm(planet), norm(earth), norm([p - e for p, e in zip(planet, earth, strict=True)])
    cos_phase = (rp * rp + rs * rs - re * re) / (2.0 * rp * rs)
    return rs, rp, F.degrees(F.acos((rp * rp + re * re - rs * rs) / (2.0 * rp * re))), F.degrees(F.acos(cos_phase)), 50.0 * (1.0 + cos_phase)


def stretch(v: Column, black: float, white: float, gamma: float = 0.5) -> Column:
    """Display value in 0..1."""
    x = (v - black) / (white - black)
    return F.pow(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)), F.lit(gamma))


def hyperbola(position: Column, at: Column, low: Column, width: Column) -> Column:
    """HFD at a focus position: a hyperbola with its least value `low` at `at`."""
    x = (position - at) / width
    return low * F.sqrt(1 + x * x)


def steps_to_focus(hfd: Column, low: Column, width: Column) -> Column:
    k = F.greatest(hfd / low, F.lit(1.0))
    return width * F.sqrt(k * k - 1)


def electrons(adu: Column, gain: Column, bits: int = 16) -> Column:
    """Electrons of a level; a gain of 0 is unknown and counts as 1 electron for each unit of the converter."""
    return adu * F.when(gain > 0, gain).otherwise(F.lit(1.0)) / float(1 << (16 - bits))
