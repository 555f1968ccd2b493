"""Smaller scalar rules: colours of a pixel, modes of an overlay, gains, queries by address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def green_purple(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Where green is the most or the least of the three, it takes the stronger (or weaker) of red and blue; the
    luminance stays, and their ratio is kept up to 30."""
    light = r + g + b
    hi, lo = F.greatest(r, b), F.least(r, b)
    k = F.least(hi / F.greatest(lo, F.lit(0.001)), F.lit(30.0))
    most, least = (g > r) & (g > b), (g < r) & (g < b)
    # most: stronger and green k parts, weaker 1; least: as it was measured, the stronger one part with green, the other k
    strong = F.when(most, light * k / (2 * k + 1)).when(least, light / (2 + k))
    weak = F.when(most, light / (2 * k + 1)).when(least, light * k / (2 + k))
    red = r >= b
    return F.coalesce(F.when(red, strong).otherwise(weak), r), F.coalesce(strong, g), F.coalesce(F.when(red, weak).otherwise(strong), b)


def spectrum_distance(r: Column, g: Column, b: Column) -> Column:
    """How far colour ratios lie from those of stars: 1 out of bounds, 0 where the light is too weak."""
    x = r / F.when(g == 0, 1.0).otherwise(g)
    d = F.abs(b / F.when(g == 0, 1.0).otherwise(g) - (0.6427 * x * x - 2.868 * x + 3.3035))
    return F.when((b < 18 / 255 * r) | (b > 255 / 173 * r), 1.0).when((r <= 1) | (g <= 1) | (b <= 1), 0.0).otherwise(d)


def overlay_limit(mode: Column) -> Column:
    """Faintest magnitude of an overlay mode (4 to 15, by its place in a group of four)."""
    return F.when(mode.between(4, 15), F.element_at(F.array(F.lit(11), F.lit(13), F.lit(15), F.lit(99)), (mode % 4 + 1).cast("int"))).otherwise(F.when(mode < 4, -99).otherwise(99))


def periodic_only(mode: Column) -> Column:
    return mode < 8


def refetch(separation: Column, width: Column, scale_deg: Column) -> Column:
    """Whether a field moved by its own width or more since it was fetched."""
    return separation >= width * scale_deg * (3.141592653589793 / 180)


def unbinned_gain(gain_text: Column, factor: Column, default: float) -> Column:
    """Electrons a unit from a header's text; the default where it has none, 0 where the factor is."""
    g = F.coalesce(gain_text.try_cast("double"), F.lit(0.0))
    return F.when(factor != 0, F.when(g == 0, default).otherwise(g) / F.when(factor == 0, 1.0).otherwise(factor)).otherwise(0.0)


def observed_band(name: Column) -> Column:
    """Band of a comparison star's table for a filter."""
    return F.when(name.isin("V", "TG"), "V").when(name.isin("B", "TB"), "B").when(name.isin("R", "TR"), "R").when(name.isin("SG", "SR", "SI"), name).otherwise("?")


def region_query(ra_deg: Column, dec_deg: Column, width_as: Column, height_as: Column) -> Column:
    """The region part of a catalogue query: a box about a centre, sizes in arc seconds."""
    sign = F.when(dec_deg >= 0, "%2B").otherwise("%2D")
    f = lambda x, n: F.format_string(f"%.{n}f", x)
    return F.concat(F.lit("region(box,"), f(ra_deg, 6), F.lit("d"), sign, f(F.abs(dec_deg), 6), F.lit("d,+"), f(width_as, 4), F.lit("s+"), f(height_as, 4), F.lit("s)"))


def solution_text(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    return F.format_string("Solution[px] x:=%.6fx+ %.6fy+ %.6f,  y:=%.6fx+ %.6fy+ %.6f", a, b, c, d, e, f)


def border_weight(x: Column, y: Column, width: int, height: int) -> Column:
    """Distance to the nearest edge."""
    return F.least(x, y, width - 1 - x, height - 1 - y)


def luma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601 in whole numbers: Y, Cb and Cr of 8-bit channels."""
    y = F.shiftright(66 * r + 129 * g + 25 * b + 128, 8) + 16
    u = F.shiftright(-38 * r - 74 * g + 112 * b + 128, 8) + 128
    v = F.shiftright(112 * r - 94 * g - 18 * b + 128, 8) + 128
    return y, u, v


def position_text(frame: Column, lon_deg: Column, lat_deg: Column) -> Column:
    """A position in degrees with the name of its frame (0 equatorial, 1 of date, 2 galactic, 3 horizontal)."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("J2000", "date", "galactic", "horizontal")]), (frame + 1).cast("int"))
    return F.format_string("%s %.4f %.4f", name, lon_deg, lat_deg)
