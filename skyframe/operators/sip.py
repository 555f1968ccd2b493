"""Distortion of frames: cubic least squares in both directions for many frames at once, and the header cards of it.

A frame's normal equations are sums of monomials, taken in one aggregate for all frames; a frame is then one row, whose
two 10 x 10 systems are solved as array expressions. Coordinates are taken in units of `unit` pixels, so that the sums
are of like size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions import sky
from skyframe.operators.fit import POWERS

N = len(POWERS)
LEAST = 20  # pairs that a frame needs


def monomial(x: Column, y: Column, i: int, j: int) -> Column:
    out = F.lit(1.0)
    for c, n in ((x, i), (y, j)):
        for _ in range(n):
            out = out * c
    return out


def eliminated(matrix: Column, n: int, tiny: Column) -> Column:
    """Gauss-Jordan on an array of n rows of n + r numbers, symmetric positive definite in the first n columns: the rows'
    last r numbers are the solutions. Null where a pivot is not above `tiny`."""

    def step(m: Column, k: Column) -> Column:
        p = F.get(m, k)
        pivot = F.get(p, k)
        row = lambda r, i: F.when(i == k, F.transform(p, lambda v: v / pivot)).otherwise(F.zip_with(r, p, lambda v, q: v - F.get(r, k) / pivot * q))
        return F.when(pivot > tiny, F.transform(m, row))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, step)


def cubics(pairs: DataFrame, by: list[str], fits: dict[str, tuple[str, str, str, str]], unit: float) -> DataFrame:
    """fits: name -> the columns (x, y, u, v) of u and v as cubics of x and y. For each group: n, and for each name two
    arrays of ten factors in the order of POWERS, `<name>_u` and `<name>_v`, in pixels; null for fewer than ten points or
    points on a curve of third degree."""
    aggs = []
    for name, (x, y, u, v) in fits.items():
        cx, cy = F.col(x) / unit, F.col(y) / unit
        aggs += [F.sum(monomial(cx, cy, i, j)).alias(f"{name}_{i}{j}") for i in range(7) for j in range(7 - i)]
        aggs += [F.sum(monomial(cx, cy, i, j) * F.col(q) / unit).alias(f"{name}_{k}{i}{j}") for k, q in (("u", u), ("v", v)) for i, j in POWERS]
    sums = pairs.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
    out = {}
    for name in fits:
        rows = F.array(*[F.array(*[F.col(f"{name}_{i + a}{j + b}") for a, b in POWERS], F.col(f"{name}_u{i}{j}"), F.col(f"{name}_v{i}{j}")) for i, j in POWERS])
        sums = sums.withColumn(f"{name}_solved", eliminated(rows, N, F.col("n") * 1e-14))
        for k, q in enumerate("uv"):
            out[f"{name}_{q}"] = F.when(F.col(f"{name}_solved").isNotNull(), F.array(*[F.get(F.get(f"{name}_solved", F.lit(r)), F.lit(N + k)) * F.lit(float(unit) ** (1 - i - j)) for r, (i, j) in enumerate(POWERS)]))
    return sums.select(*by, "n", *[c.alias(k) for k, c in out.items()])


def applied(factors: Column, x: Column, y: Column) -> Column:
    return sum((F.get(factors, F.lit(r)) * monomial(x, y, i, j) for r, (i, j) in enumerate(POWERS)), F.lit(0.0))


def pairs_of(stars: DataFrame, wcs: dict) -> DataFrame:
    """stars with x, y (pixels from 1) and ra, dec of the catalogue star there -> also px, py, the measured place from the
    reference pixel, and sx, sy, where the linear solution puts the star."""
    sx, sy = sky.to_pixel(F.col("ra"), F.col("dec"), {k: v for k, v in wcs.items() if not k.startswith("sip")})
    return stars.withColumns({"px": F.col("x") - wcs["crpix1"], "py": F.col("y") - wcs["crpix2"], "sx": sx - wcs["crpix1"], "sy": sy - wcs["crpix2"]})


def fitted(pairs: DataFrame, by: list[str], unit: float = 1000.0) -> DataFrame:
    """pairs (px, py, sx, sy) -> for each group n, status, and the arrays a, b (pixel to sky) and ap, bp (sky to pixel) in
    the order of POWERS: what is added to a place. A group of fewer than LEAST pairs has no arrays."""
    both = cubics(pairs, by, {"f": ("px", "py", "sx", "sy"), "r": ("sx", "sy", "px", "py")}, unit)
    less = lambda c, own: F.transform(c, lambda v, k: F.when(k == POWERS.index(own), v - 1.0).otherwise(v))
    arrays = {"a": less(F.col("f_u"), (1, 0)), "b": less(F.col("f_v"), (0, 1)), "ap": less(F.col("r_u"), (1, 0)), "bp": less(F.col("r_v"), (0, 1))}
    good = F.col("n") >= LEAST
    status = F.when(~good, "too few pairs").when(F.col("f_u").isNull() | F.col("r_u").isNull(), "singular").otherwise("ok")
    return both.select(*by, "n", status.alias("status"), *[F.when(good, c).alias(k) for k, c in arrays.items()])


def residuals(pairs: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """For each group the root mean square distance (pixels) of the fitted places from the given ones in both directions,
    and the largest distance between a place and itself there and back."""
    p = pairs.join(fits.filter("status = 'ok'").select(*by, "a", "b", "ap", "bp"), by)
    x, y, u, v = (F.col(c) for c in ("px", "py", "sx", "sy"))
    p = p.withColumns({"fx": x + applied(F.col("a"), x, y), "fy": y + applied(F.col("b"), x, y), "gx": u + applied(F.col("ap"), u, v), "gy": v + applied(F.col("bp"), u, v)})
    p = p.withColumns({"hx": F.col("fx") + applied(F.col("ap"), F.col("fx"), F.col("fy")), "hy": F.col("fy") + applied(F.col("bp"), F.col("fx"), F.col("fy"))})
    far = lambda a, b, c, d: (a - c) * (a - c) + (b - d) * (b - d)
    c = {n: F.col(n) for n in ("fx", "fy", "gx", "gy", "hx", "hy")}
    return p.groupBy(*by).agg(F.sqrt(F.avg(far(c["fx"], c["fy"], u, v))).alias("forward"), F.sqrt(F.avg(far(c["gx"], c["gy"], x, y))).alias("inverse"), F.sqrt(F.max(far(c["hx"], c["hy"], x, y))).alias("there_and_back"))


def coefficients(fits: DataFrame, by: list[str]) -> DataFrame:
    """fits -> a row for each factor: key (A_2_1, BP_0_3, ...) and value."""
    each = [F.struct(F.lit(f"{k.upper()}_{i}_{j}").alias("key"), F.get(k, F.lit(POWERS.index((i, j)))).alias("value")) for k in ("a", "b", "ap", "bp") for i, j in POWERS]
    return fits.filter("status = 'ok'").select(*by, F.explode(F.array(*each)).alias("c")).select(*by, "c.key", "c.value")


def cards(fits: DataFrame, by: list[str]) -> DataFrame:
    """The header cards of the distortion: the order (3) of each polynomial, then its factors; pos counts from 0."""
    each = []
    for k, says in (("a", "axis 1, pixel to sky"), ("b", "axis 2, pixel to sky"), ("ap", "axis 1, sky to pixel"), ("bp", "axis 2, sky to pixel")):
        card = lambda key, value, note: F.rpad(F.concat(F.rpad(F.lit(key), 8, " "), F.lit("= "), F.lpad(value, 20, " "), F.lit(f" / {note}")), 80, " ")
        each.append(F.struct(F.lit(f"{k.upper()}_ORDER").alias("key"), card(f"{k.upper()}_ORDER", F.lit("3"), f"Polynomial order, {says}").alias("text")))
        for i, j in sorted(POWERS, key=lambda p: (p[0] + p[1], -p[0])):
            key = f"{k.upper()}_{i}_{j}"
            each.append(F.struct(F.lit(key).alias("key"), card(key, F.format_string("%.12E", F.get(k, F.lit(POWERS.index((i, j))))), "SIP coefficient").alias("text")))
    return fits.filter("status = 'ok'").select(*by, F.posexplode(F.array(*each)).alias("pos", "card")).select(*by, F.col("pos").cast("long").alias("pos"), "card.key", "card.text")
