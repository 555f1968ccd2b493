"""Photometric calibration of many frames: catalogue stars of each field are measured in its image, those that can't be
trusted are marked with the reason, and a robust mean of flux ratios gives the frame's zero point.

    places = candidates(solutions, catalogue)
    sizes = apertures(frames.analysed(images), ratio, annulus)    # or none: the whole star
    stars = measured(images, places, sizes)           # a row for each star, reason null where it counts
    frame_calibration(solutions, stars, ratio)        # a row for each frame
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions import sky
from skyframe.kernels import stars as kernel
from skyframe.operators import field, frames, robust

#: Fixed values of the calibration.
REDDEST = 1.2  # colour beyond which a star isn't used
UNKNOWN = -12.8  # colour of stars whose magnitude isn't reliable
SLOP = 50  # pixels that a star may be outside of the frame
HFD_FROM, HFD_TO, SNR, LEAST_STARS = 0.8, 15.0, 30.0, 3
HEADROOM = 1000.0  # below a frame's largest value: a star that comes that near is saturated
BASE = 21.0  # magnitude for whose flux ratios are averaged
WHOLE, ANNULUS, WIDEST = 99.0, 14, 50  # aperture and ring without a median HFD, and the widest ring
LIMIT_SNR, GAUSS, LARGE = 7.0, 2.3548, 10.0
ROWS = 5000  # measured stars that a task hands on at once

SOLUTION = ["ra0", "dec0", "crpix1", "crpix2", "cd1_1", "cd1_2", "cd2_1", "cd2_2"]
MEASURED = "frame long, id long, mag double, x double, y double, hfd double, flux double, snr double, sd double, peak double"


def candidates(solutions: DataFrame, catalog: DataFrame) -> DataFrame:
    """solutions (frame, width, height, SOLUTION: angles of the centre in radians, the matrix in degrees) and catalog (id, ra,
    dec, mag, colour; colour null if the catalogue has none): (frame, id, mag, x, y), the stars that a frame can be
    calibrated by and their places, x and y counted from 0. Red stars and those of unreliable magnitude go."""
    good = catalog.filter(F.col("colour").isNull() | ((F.col("colour") <= REDDEST) & (F.col("colour") > UNKNOWN + 0.05)))
    w = {c: F.col(c) for c in SOLUTION}
    # the square about the reference pixel that holds the frame with its slop, turned in whatever way
    far = lambda size, ref: F.greatest(F.abs(F.col(ref)), F.abs(F.col(size) - F.col(ref))) + SLOP
    scale = F.sqrt(F.greatest(F.col("cd1_1") ** 2 + F.col("cd2_1") ** 2, F.col("cd1_2") ** 2 + F.col("cd2_2") ** 2)) * (sky.PI / 180)
    reach = 2 * scale * F.sqrt(far("width", "crpix1") ** 2 + far("height", "crpix2") ** 2)
    near = field.in_square(solutions.select("frame", "width", "height", *SOLUTION, reach.alias("field")), good.select("id", "ra", "dec", "mag"))
    x, y = sky.to_pixel(F.col("ra"), F.col("dec"), w)
    at = near.select("frame", "id", F.col("mag").cast("double").alias("mag"), (x - 1).alias("x"), (y - 1).alias("y"), "width", "height")
    inside = (F.col("x") > -SLOP) & (F.col("x") <= F.col("width") + SLOP) & (F.col("y") > -SLOP) & (F.col("y") <= F.col("height") + SLOP)
    return at.filter(inside).drop("width", "height")


def apertures(found: DataFrame, ratio: float, annulus: float) -> DataFrame:
    """found (frame, hfd, snr): the stars of each frame, as frames.analysed finds them -> (frame, aperture, ring): an aperture
    (radius) of ratio times half the median HFD of its stars over SNR, and the ring's radius likewise. Frames without such a star, and a ratio of 0, have no row: the
    whole star is taken."""
    med = robust.smedian(found.filter((F.col("snr") > SNR) & F.lit(bool(ratio))), ["frame"], "hfd").filter("median > 0")
    ring = F.least(F.lit(WIDEST), F.floor(F.col("median") * (annulus / 2) + 0.5) - 1)
    return med.select("frame", (F.col("median") * (ratio / 2)).alias("aperture"), ring.cast("int").alias("ring"))


def _star_row(img: np.ndarray, frame: int, id_: int, mag: float, x: float, y: float, aperture: float, ring: int) -> tuple:
    m = kernel.measure(img, int(np.floor(x + 0.5)), int(np.floor(y + 0.5)), int(ring), aperture)
    if m is None:
        return (frame, id_, mag, x, y, *[None] * 5)
    cx, cy = int(np.floor(m["x"] + 0.5)), int(np.floor(m["y"] + 0.5))
    inner = 1 <= cx < img.shape[1] - 1 and 1 <= cy < img.shape[0] - 1
    peak = float(img[cy - 1 : cy + 2, cx - 1 : cx + 2].max()) if inner else None
    return (frame, id_, mag, m["x"], m["y"], m["hfd"], m["flux"], m["snr"], m["sd"], peak)


def _star_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURED.split(", ")])
    return out.astype({c: "float64" for c in out.columns[2:]})


def _drawn(images: DataFrame, own: DataFrame, image) -> DataFrame:
    """The places of own within what `image` makes of the rows of images: only rows and places meet, in partitions of the
    session's number, as few bytes make much work here; a task has one image at a time."""
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = own.repartition(n, "frame").groupBy("frame").agg(F.collect_list(F.struct("id", "mag", "x", "y")).alias("p"), F.first("aperture").alias("aperture"), F.first("ring").alias("ring"))
    wanted = wanted.select("frame", *[F.col(f"p.{c}").alias(f"at_{c}") for c in ("id", "mag", "x", "y")], "aperture", "ring")
    there = images.withColumn("there", F.lit(True)).repartition(n, "frame").hint("merge").join(wanted, "frame", "right")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                img = image(r) if r.there is True else np.zeros((1, 1))
                rows += [_star_row(img, int(r.frame), *at, r.aperture, r.ring) for at in zip(r.at_id, r.at_mag, r.at_x, r.at_y, strict=True)]
                if len(rows) > ROWS:
                    yield _star_rows(rows)
                    rows = []
            yield _star_rows(rows)

    return there.mapInPandas(run, MEASURED)


def measured(images: DataFrame, places: DataFrame, sizes: DataFrame | None = None, saturations: DataFrame | None = None, image=None) -> DataFrame:
    """images (frames.IMAGE), places as candidates gives them, sizes as apertures gives them, saturations (frame, datamax):
    a row for each place with what was measured and the reason why it doesn't count ('no star', 'size', 'noise', 'edge' or
    'saturated'; null if it does). Without saturations the limit is 64000 with the headroom. With `image`, images are rows
    (frame, more) that it makes an image of: none is shuffled or written then."""
    own = places.join(sizes, "frame", "left") if sizes is not None else places.withColumns({"aperture": F.lit(None).cast("double"), "ring": F.lit(None).cast("int")})
    own = own.select("frame", "id", "mag", "x", "y", F.coalesce("aperture", F.lit(WHOLE)).alias("aperture"), F.coalesce("ring", F.lit(ANNULUS)).alias("ring"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        img = frames.image_of(next(left.itertuples(index=False))) if len(left) else np.zeros((1, 1))
        return _star_rows([_star_row(img, r.frame, r.id, r.mag, r.x, r.y, r.aperture, r.ring) for r in right.itertuples(index=False)])

    if image is None:
        got = images.select("frame", "height", "width", "data").groupBy("frame").cogroup(own.groupBy("frame")).applyInPandas(run, MEASURED)
    else:
        got = _drawn(images, own, image)
    got = got.select("frame", "id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("mag", "x", "y", "hfd", "flux", "snr", "sd", "peak")])
    got = got.join(saturations.select("frame", F.col("datamax").cast("double")), "frame", "left") if saturations is not None else got.withColumn("datamax", F.lit(None).cast("double"))
    limit = F.coalesce("datamax", F.lit(64000.0)) - HEADROOM
    reason = F.when(F.col("hfd").isNull(), "no star").when((F.col("hfd") >= HFD_TO) | (F.col("hfd") < HFD_FROM), "size").when(F.col("snr") <= SNR, "noise").when(F.col("peak").isNull(), "edge").when(F.col("peak") >= limit, "saturated")
    return got.withColumn("reason", reason).drop("datamax")


def frame_calibration(solutions: DataFrame, stars: DataFrame, ratio: float = 0.0) -> DataFrame:
    """stars as measured gives them -> for each frame: stars (that count), used (after outliers went), mzero (magnitude of
    a flux of 1), sem (its standard error in magnitudes), limit (magnitude of a star whose flux is 7 times the noise within
    the aperture) and failure ('no stars' under three, 'outliers' if none is left, else null; mzero, sem and limit are null
    then). All statistics are windows over a frame's distinct values."""
    good = stars.filter(F.col("reason").isNull()).select("frame", (F.col("flux") / F.pow(F.lit(10.0), (BASE - F.col("mag")) / 2.5)).alias("ratio"), (F.col("hfd") * F.col("sd")).alias("spread"))
    counts = good.groupBy("frame").agg(F.count("*").alias("stars"))
    mean = robust.best_mean(good, ["frame"], "ratio")
    spread = robust.smedian(good, ["frame"], "spread", "spread")
    out = solutions.select("frame").distinct().join(counts, "frame", "left").join(mean, "frame", "left").join(spread, "frame", "left").na.fill(0, ["stars", "used"])
    failure = F.when(F.col("stars") < LEAST_STARS, "no stars").when(F.col("used") == 0, "outliers")
    sigmas = (ratio or LARGE) * GAUSS / 2
    seen = LIMIT_SNR * np.sqrt(np.pi) * (1 - np.exp(-0.5 * sigmas * sigmas))  # of the flux within the aperture
    mzero = BASE + 2.5 * F.log10("mean")
    ok = lambda c, name: F.when(failure.isNull(), c).alias(name)
    return out.select("frame", "stars", "used", ok(mzero, "mzero"), ok(2.5 * F.log10(1 + F.col("sem") / F.col("mean")), "sem"), ok(mzero - 2.5 * F.log10(float(seen) * F.col("spread")), "limit"), failure.alias("failure"))


def star_magnitudes(stars: DataFrame, calibration: DataFrame) -> DataFrame:
    """stars (frame, flux, more), calibration as frame_calibration gives it: stars with their magnitude, null where the
    frame has no zero point or the flux isn't positive."""
    c = calibration.select("frame", "mzero")
    return stars.join(c, "frame", "left").withColumn("magnitude", F.when(F.col("flux") > 0, F.col("mzero") - 2.5 * F.log10("flux"))).drop("mzero")
