"""Sky tiles: declination rings, each parted in right ascension, numbered from the south pole."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
#: Cells of each ring from the pole to the equator, and the declinations (degrees) that bound the rings.
CELLS_290 = [1, 4, 8, 12, 16, 20, 24, 28, 32]
BOUNDS_290 = [0.0, 12.79440589, 24.53348115, 35.54307745, 46.03163067, 56.14497387, 65.99286637, 75.66348756, 85.23224404, 90.0]
CELLS_1476 = [1, 3, 9, 15, 21, 27, 33, 38, 43, 48, 52, 56, 60, 63, 65, 67, 68, 69]


def scheme(n: int) -> tuple[list[int], list[float]]:
    """Cells of all rings, south to north, and their bounds in radians. The rings of 1476 are 36/7 degrees high but for
    the caps, which are half as high."""
    half = CELLS_290 if n == 290 else CELLS_1476
    north = BOUNDS_290 if n == 290 else [*(k * 36 / 7 for k in range(18)), 90.0]
    degrees = [-d for d in reversed(north[1:])] + north
    return half + half[::-1], [math.radians(d) for d in degrees]


def tile(ra: Column, dec: Column, n: int = 290) -> Column:
    """Number (from 1) of the tile that holds a position; a ring's northern bound belongs to it."""
    cells, bounds = scheme(n)
    first = [0, *accumulate(cells)]
    out = F.lit(1)
    for ring in range(1, len(cells)):
        inside = F.lit(first[ring] + 1) + F.floor(ra * (cells[ring] / TWO_PI)).cast("int")
        out = F.when(dec > bounds[ring], inside if cells[ring] > 1 else F.lit(first[ring] + 1)).otherwise(out)
    return out.cast("long")


def tile_file(number: int, n: int = 290) -> str:
    """File name of a tile: ring and cell, two digits each (from 1)."""
    cells, _ = scheme(n)
    first = [0, *accumulate(cells)]
    ring = next(r for r in range(len(cells)) if number <= first[r + 1])
    return f"{ring + 1:02d}{number - first[ring]:02d}.{n}"


def tiles_of_field(ra: Column, dec: Column, field: float, n: int = 290) -> Column:
    """The distinct tiles at the four corners of a square field (radians)."""
    h = field / 2
    beyond = lambda d: F.least(F.greatest(d, F.lit(-TWO_PI / 4)), F.lit(TWO_PI / 4))  # noqa: E731  past a pole it's the pole's tile
    corner = lambda s, w: tile(F.pmod(ra + w * h / F.cos(dec + s * h), F.lit(TWO_PI)), beyond(dec + s * h), n)
    return F.array_sort(F.array_distinct(F.array(*[corner(s, w) for s in (1, -1) for w in (1, -1)])))


#: The widest field (degrees) whose corners can't pass over a tile.
WIDEST = {290: 9.53, 1476: 5.142857}


def corner_shares(ra: Column, dec: Column, field: Column, n: int = 290) -> Column:
    """The tiles at the corners NE, NW, SE, SW of a square field (radians) with the share of the field that each covers:
    array of (tile, share). A tile counts once, at its first corner, and shares under 1 % are left out."""
    cells, bounds = scheme(n)
    rings = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(c).alias("cells"), F.lit(f).alias("first")) for low, high, c, f in zip(bounds[:-1], bounds[1:], cells, accumulate([0, *cells]), strict=False)])
    inner = F.array(*[F.lit(b) for b in bounds[1:-1]])
    field = F.least(field, F.lit(math.radians(WIDEST[n])))
    half = field / 2
    corners = F.array(*[F.struct(F.lit(float(s)).alias("north"), F.lit(float(w)).alias("east")) for s, w in ((1, 1), (1, -1), (-1, 1), (-1, -1))])
    # step by step, so that each value is worked out once
    at = F.transform(corners, lambda c: F.struct(c["north"].alias("north"), c["east"].alias("east"), (dec + c["north"] * half).alias("d")))
    at = F.transform(at, lambda c: F.struct(c["north"].alias("north"), c["east"].alias("east"), c["d"].alias("d"), (ra + c["east"] * half / F.cos(c["d"])).alias("r"), F.get(rings, F.size(F.filter(inner, lambda b: c["d"] > b))).alias("ring")))
    turns = lambda c: F.when(c["r"] < 0, c["r"] + TWO_PI).when(c["r"] >= TWO_PI, c["r"] - TWO_PI).otherwise(c["r"]) * c["ring"]["cells"] / TWO_PI
    at = F.transform(at, lambda c: F.struct(c["north"].alias("north"), c["east"].alias("east"), c["d"].alias("d"), c["ring"].alias("ring"), turns(c).alias("turn")))

    def covered(c: Column) -> Column:
        away = c["turn"] - F.floor(c["turn"])
        cap = c["ring"]["cells"] == 1
        width = F.when(cap, TWO_PI).otherwise(F.when(c["east"] > 0, away).otherwise(1 - away) * TWO_PI / c["ring"]["cells"] * F.cos(c["d"]))
        height = F.when(c["north"] > 0, c["d"] - c["ring"]["low"]).otherwise(c["ring"]["high"] - c["d"])
        number = c["ring"]["first"] + 1 + F.when(cap, 0).otherwise(F.floor(c["turn"]))
        return F.struct(number.cast("long").alias("tile"), (F.least(width, field) * F.least(height, field) / (field * field)).alias("share"))

    def add(out: Column, t: Column) -> Column:
        return F.when(F.exists(out, lambda u: u["tile"] == t["tile"]), out).otherwise(F.concat(out, F.array(t)))

    once = F.aggregate(F.transform(at, covered), F.expr("cast(array() as array<struct<tile:bigint,share:double>>)"), add)
    return F.filter(once, lambda t: t["share"] >= 0.01)


def _cells_of(band: Column, size: Column) -> Column:
    """How many cells a band of declination has: none is narrower than size at any declination of it or a band beside it."""
    low, high = (band - 1) * size - math.pi / 2, (band + 2) * size - math.pi / 2
    thin = F.greatest(F.least(F.when(low > -math.pi / 2, F.cos(low)).otherwise(0.0), F.when(high < math.pi / 2, F.cos(high)).otherwise(0.0)), F.lit(0.0))
    return F.greatest(F.lit(1), F.floor(thin * TWO_PI / size)).cast("long")


def sky_cell(ra: Column, dec: Column, size: Column) -> Column:
    """The cell of a grid over the sky, by bands of declination of that height (radians), each cut in right ascension."""
    band = F.floor((dec + math.pi / 2) / size)
    n = _cells_of(band, size)
    return band * (1 << 31) + F.pmod(F.floor(ra / TWO_PI * n), n)


def sky_cells_around(ra: Column, dec: Column, size: Column) -> Column:
    """The cells that may hold a point p with |ra difference| * cos(dec) < size and |dec difference| < size."""
    at = F.floor((dec + math.pi / 2) / size)
    out = []
    for step in (-1, 0, 1):
        n = _cells_of(at + step, size)
        own = F.floor(ra / TWO_PI * n)
        out += [(at + step) * (1 << 31) + F.pmod(own + k, n) for k in (-1, 0, 1)]
    return F.array_distinct(F.array(*out))


def sky_cells_of_box(ra: Column, dec: Column, half: Column, size: Column) -> Column:
    """The cells, of any size, that may hold a point p with |ra difference| * cos(dec) < half and |dec difference| < half."""
    half = half * (1 + 1e-9) + 1e-12  # what rounding may take away
    band = lambda d: F.floor((F.least(F.greatest(d, F.lit(-math.pi / 2)), F.lit(math.pi / 2)) + math.pi / 2) / size)
    wide = F.least(half / F.greatest(F.cos(dec), F.lit(1e-9)), F.lit(math.pi))

    def across(b: Column) -> Column:
        n = _cells_of(b, size)
        first, last = F.floor((ra - wide) / TWO_PI * n), F.floor((ra + wide) / TWO_PI * n)
        return F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda k: b * (1 << 31) + F.pmod(k, n))

    return F.flatten(F.transform(F.sequence(band(dec - half), band(dec + half)), across))
