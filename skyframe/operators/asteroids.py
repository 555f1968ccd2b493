"""Minor planets and comets in the fields of many frames.

Each orbit is followed once for each night that frames are of, not for each frame. From its place and distance at the
middle of the day follows how far it can be from there when any frame of that day was taken; if that is little, the join
with the frames is on the day and a sky cell. What is fast, close to the Sun or the Earth, or near a pole meets all times
of its day. Exact places (light time, parallax, magnitude) are worked out once for an orbit and a time, however many frames
are of that time; they meet the frames on the time and a finer sky cell."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions import apparent, light, sky, tiles, when
from skyframe.kernels import orbit
from skyframe.operators.scratch import stored

#: light's days for an AU, the Earth's pace (AU a day, a little over its greatest), days after which elements
#: of a minor planet count as outdated.
LIGHT_DAYS, EARTH_PACE, OUTDATED = 0.0057755183, 0.0176, 120.0
ELEMENTS = ("q", "e", "incl", "node", "peri")


def orbits(elements: DataFrame) -> DataFrame:
    """elements of minor planets as catalogues give them (id, epoch, anomaly, peri, node, incl in degrees, e, axis, h, g) or
    of comets (axis null, q and epoch of the perihelion) -> id, comet, q, e, incl, node, peri (radians), t0 (Julian date of the
    perihelion), epoch, h, g."""
    comet = F.col("axis").isNull()
    q = F.when(comet, F.col("q")).otherwise(F.col("axis") * (1 - F.col("e")))
    t0 = F.when(comet, F.col("epoch")).otherwise(F.col("epoch") - F.radians("anomaly") * F.pow("axis", F.lit(1.5)) / orbit.GAUSS)
    return elements.select("id", comet.alias("comet"), q.alias("q"), "e", *[F.radians(c).alias(c) for c in ("incl", "node", "peri")], t0.alias("t0"), "epoch", "h", "g")


SEEN = "ra double, dec double, delta double, sun double, phase double, pace double"


def _seen(q: pd.Series, e: pd.Series, incl: pd.Series, node: pd.Series, peri: pd.Series, dt: pd.Series, ex: pd.Series, ey: pd.Series, ez: pd.Series, ox: pd.Series, oy: pd.Series, oz: pd.Series) -> pd.DataFrame:
    x, y, z, vx, vy, vz = orbit.state(*(c.to_numpy(float) for c in (q, e, incl, node, peri, dt)))
    c, s = math.cos(when.OBLIQUITY), math.sin(when.OBLIQUITY)
    turned = lambda x, y, z: np.stack([x, c * y - s * z, s * y + c * z])  # noqa: E731  to the equator
    norm = lambda v: np.sqrt((v * v).sum(0))
    at, pace = turned(x, y, z), turned(vx, vy, vz)
    earth, observer = (np.stack([k.to_numpy(float) for k in v]) for v in ((ex, ey, ez), (ox, oy, oz)))
    from_earth = at - earth
    top = from_earth - LIGHT_DAYS * norm(from_earth) * pace + observer
    sun, away = norm(at), norm(from_earth)
    phase = np.arccos(np.clip((away**2 + sun**2 - norm(earth) ** 2) / (2 * away * sun), -1, 1))
    return pd.DataFrame({"ra": np.mod(np.arctan2(top[1], top[0]), 2 * np.pi), "dec": np.arctan2(top[2], np.hypot(top[0], top[1])), "delta": norm(top), "sun": sun, "phase": phase, "pace": norm(pace)})


def observed(times: DataFrame, jd: Column, sidereal: Column, latitude: float) -> DataFrame:
    """times with a column `from`: jd, the Earth's place (AU) and the observer's, from its centre, to be added. A row for
    each frame or night; written, as what follows uses it for each orbit."""
    ex, ey, ez = when.earth_position(jd)
    zero = F.lit(0.0)
    ox, oy, oz = apparent.parallax(zero, zero, zero, sidereal, latitude)
    return stored(times.withColumn("from", F.struct(jd.alias("jd"), *[c.alias(n) for n, c in (("ex", ex), ("ey", ey), ("ez", ez), ("ox", ox), ("oy", oy), ("oz", oz))])), "observed")


def seen(rows: DataFrame) -> DataFrame:
    """rows with an orbit's columns and `from` -> also ra, dec, delta (AU from the observer), sun (AU from the Sun), phase
    (radians) and pace (AU a day). Light time is taken out along the orbit's velocity."""
    at = F.pandas_udf(_seen, SEEN)(*[F.col(c).cast("double") for c in ELEMENTS], (F.col("from.jd") - F.col("t0")).cast("double"), *[F.col(f"from.{c}") for c in ("ex", "ey", "ez", "ox", "oy", "oz")])
    return rows.withColumn("seen", at).select(*rows.columns, "seen.*")


def candidates(frames: DataFrame, orbits_: DataFrame) -> DataFrame:
    """Pairs of the distinct times of frames (frame, jd_tt, ra0, dec0, radius, more) and orbits that may be in a frame of that
    time: all columns of the orbit, and what frames have beside their own (jd_tt and more)."""
    widest = frames.agg(F.max("radius")).first()[0] or 0.05
    size = max(2 * widest, 0.1)
    frames = frames.withColumn("day", F.floor("jd_tt"))
    days = observed(frames.select("day").distinct(), F.col("day") + 0.5, F.lit(0.0), 0.0)  # a row for each night
    # few bytes make much work here: without a number of its own there would be few tasks
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = seen(orbits_.repartition(n, "id").crossJoin(days))
    moved = (1.2 * F.col("pace") + EARTH_PACE) / 2 + 1e-4  # from the middle to either end of the day, and parallax
    reach = 1.1 * moved / F.greatest(F.col("delta") - moved, F.lit(1e-9))
    slow = (F.col("sun") > 0.3) & (F.col("delta") > 0.1) & (F.abs("dec") < 1.3) & (reach < (size - widest) / 2.5)
    at = at.withColumns({"slow": F.coalesce(slow, F.lit(False)), "cell": tiles.sky_cell(F.col("ra"), F.col("dec"), F.lit(size))})
    own = [*orbits_.columns, "day"]
    at = stored(at.select(*own, "slow", "cell"), "nightly")
    times = frames.drop("frame", "ra0", "dec0", "radius")
    near = frames.withColumn("cell", F.explode(tiles.sky_cells_around(F.col("ra0"), F.col("dec0"), F.lit(size)))).select(*times.columns, "cell").distinct()
    # a night's orbits and times, no more: neither is broadcast with its cells
    return at.filter("slow").select(*own, "cell").hint("shuffle_merge").join(near, ["day", "cell"]).drop("cell").unionByName(at.filter("not slow").select(*own).join(times.distinct(), "day"))


def in_fields(frames: DataFrame, orbits_: DataFrame, latitude: float, longitude: float, faintest: float = 99.0) -> DataFrame:
    """frames (frame, jd, jd_tt, ra0, dec0, radius), orbits as `orbits` gives them: what stands within the radius of a frame's
    centre on the flat sky and is no fainter than `faintest`: frame, id, comet, ra, dec, delta, sun, mag, outdated."""
    at = observed(frames.select("frame", "jd", "jd_tt", "ra0", "dec0", "radius"), F.col("jd_tt"), sky.sidereal(F.col("jd"), F.lit(longitude)), latitude)
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = seen(candidates(at, orbits_).repartition(n, "id", "jd_tt"))
    dim = 5 * F.log10("delta")
    mag = F.col("h") + dim + F.when(F.col("comet"), F.col("g") * F.log10("sun")).otherwise(5 * F.log10("sun") + light.phase_magnitude(F.col("g"), F.col("phase")))
    old = ~F.col("comet") & (F.abs(F.col("jd_tt") - F.col("epoch")) > OUTDATED)
    s = s.withColumns({"mag": mag, "outdated": old}).filter(F.col("mag") <= faintest)
    # the widest field parts the sky; a frame has the cells that its own touches
    size = F.lit(max(frames.agg(F.max("radius")).first()[0] or 0.05, 1e-3) / 2)
    s = s.select("jd", "jd_tt", "id", "comet", "ra", "dec", "delta", "sun", "mag", "outdated", tiles.sky_cell(F.col("ra"), F.col("dec"), size).alias("cell"))
    f = at.select("frame", "jd", "jd_tt", "ra0", "dec0", "radius", F.explode(tiles.sky_cells_of_box(F.col("ra0"), F.col("dec0"), F.col("radius"), size)).alias("cell"))
    x, y = (F.pmod(F.col("ra") - F.col("ra0") + sky.PI, F.lit(sky.TWO_PI)) - sky.PI) * F.cos("dec0"), F.col("dec") - F.col("dec0")
    met = s.repartition(n, "jd", "jd_tt", "cell").hint("shuffle_merge").join(f.repartition(n, "jd", "jd_tt", "cell"), ["jd", "jd_tt", "cell"])
    return met.filter(x * x + y * y < F.col("radius") * F.col("radius")).select("frame", "id", "comet", "ra", "dec", "delta", "sun", "mag", "outdated")
