"""Operators that run a kernel on each frame: pixels are gathered by frame, frames run in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.kernels import image, orbit, stars

STARS = "frame long, x double, y double, hfd double, fwhm double, flux double, snr double"


IMAGE = "frame long, height int, width int, data binary"  # values as doubles, row by row


def image_row(frame: int, img: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"frame": [frame], "height": [img.shape[0]], "width": [img.shape[1]], "data": [np.ascontiguousarray(img, float).tobytes()]})


def image_of(r) -> np.ndarray:
    return np.frombuffer(bytes(r.data)).reshape(r.height, r.width)


def _array(pdf: pd.DataFrame) -> np.ndarray:
    img = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
    img[pdf["y"], pdf["x"]] = pdf["v"]
    return img


def _table(frame: int, img: np.ndarray) -> pd.DataFrame:
    y, x = np.mgrid[: img.shape[0], : img.shape[1]]
    return pd.DataFrame({"frame": frame, "x": x.ravel(), "y": y.ravel(), "v": img.ravel()})


def images_of(px: DataFrame) -> DataFrame:
    """Pixels (frame, x, y, v) gathered to IMAGE; where frames come as images anyway, none of this is needed."""
    return px.select("frame", "x", "y", "v").groupBy("frame").applyInPandas(lambda pdf: image_row(int(pdf["frame"].iloc[0]), _array(pdf)), IMAGE)


def found_stars(images: DataFrame, least: int = 500) -> DataFrame:
    """images: IMAGE, or pixels (frame, x, y, v). The stars of each frame, found where the image is; a row for each star goes on."""
    images = images if "data" in images.columns else images_of(images)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                out = pd.DataFrame(stars.find(image_of(r), least), columns=["x", "y", "hfd", "fwhm", "flux", "snr"])
                out.insert(0, "frame", int(r.frame))
                yield out

    return images.select("frame", "height", "width", "data").mapInPandas(run, STARS)


def analysed(images: DataFrame, image=None, least: int = 500, snr: float = 30.0) -> DataFrame:
    """images: IMAGE, or rows (frame, more) that `image` makes an image of, one at a time and where it is used. (frame, hfd, snr)
    of the stars over snr that a frame's median HFD is taken from."""
    images, image = (images, image) if image else (images.select("frame", "height", "width", "data"), image_of)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                out = pd.DataFrame(stars.analysed(image(r), least, snr_min=snr), columns=["hfd", "snr"])
                out.insert(0, "frame", int(r.frame))
                yield out

    return images.mapInPandas(run, "frame long, hfd double, snr double")


MEASURED = "frame long, id long, x double, y double, hfd double, fwhm double, flux double, snr double"


def _measured(frame: int, img: np.ndarray, places, radius: int) -> pd.DataFrame:
    """places: (id, x, y)."""
    rows = [(frame, i, *[m[c] for c in ("x", "y", "hfd", "fwhm", "flux", "snr")]) for i, x, y in places if (m := stars.measure(img, int(x), int(y), radius))]
    return pd.DataFrame(rows, columns=["frame", "id", "x", "y", "hfd", "fwhm", "flux", "snr"])


def measured(images: DataFrame, places: DataFrame | None = None, radius: int = 14) -> DataFrame:
    """places (frame, id, x, y): the star at each place of a frame, if there is one. images as in found_stars; those that bring
    their own places, an array of (id, x, y), are measured where they are and never shuffled."""
    if places is None:

        def run_own(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    yield _measured(r.frame, image_of(r), ((p["id"], p["x"], p["y"]) for p in r.places), radius)

        return images.select("frame", "height", "width", "data", "places").mapInPandas(run_own, MEASURED)
    images = images if "data" in images.columns else images_of(images)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        img = image_of(next(left.itertuples(index=False))) if len(left) else np.zeros((1, 1))
        return _measured(int(right["frame"].iloc[0]) if len(right) else 0, img, zip(right["id"], right["x"], right["y"], strict=True), radius)

    own = places.select("frame", "id", "x", "y").groupBy("frame")
    return images.select("frame", "height", "width", "data").groupBy("frame").cogroup(own).applyInPandas(run, MEASURED)


def filtered(px: DataFrame, kernel) -> DataFrame:
    """kernel(image) -> image on each frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _table(int(pdf["frame"].iloc[0]), kernel(_array(pdf)))

    return px.select("frame", "x", "y", "v").groupBy("frame").applyInPandas(run, "frame long, x long, y long, v double")


def blurred(px: DataFrame, radius: float) -> DataFrame:
    return filtered(px, lambda img: image.gaussian_blur(img, radius))


def rotated(px: DataFrame, degrees: float) -> DataFrame:
    return filtered(px, lambda img: image.rotate(img, degrees))


def orbits(elements: DataFrame) -> DataFrame:
    """elements (id, q, e, i, node, peri in radians, dt in days) -> ecliptic x, y, z."""

    def run(batches):
        for pdf in batches:
            x, y, z = orbit.position(*[pdf[c].to_numpy() for c in ("q", "e", "i", "node", "peri", "dt")])
            yield pd.DataFrame({"id": pdf["id"], "x": x, "y": y, "z": z})

    return elements.select("id", "q", "e", "i", "node", "peri", "dt").mapInPandas(run, "id long, x double, y double, z double")


def focus_fits(points: DataFrame) -> DataFrame:
    """points (run, position, hfd): best focus, least HFD and width of each run."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = orbit.fit_hyperbola(pdf["position"].to_numpy(), pdf["hfd"].to_numpy())
        return pd.DataFrame([(pdf["run"].iloc[0], *fit)] if fit else [], columns=["run", "best", "low", "width"])

    return points.groupBy("run").applyInPandas(run, "run long, best double, low double, width double")


def calibrated(measurements: DataFrame) -> DataFrame:
    """measurements (frame, flux, mag) -> for each frame: zero point, its standard error in magnitudes, stars used, and
    the magnitude of a flux 7 times the noise if given. The flux of a star of magnitude 21 is averaged robustly."""
    from skyframe.operators.robust import best_mean

    ratio = measurements.select("frame", (F.col("flux") / F.pow(F.lit(10.0), (21 - F.col("mag")) / 2.5)).alias("ratio"))
    m = best_mean(ratio, ["frame"], "ratio")
    return m.filter("used >= 3").select("frame", (21 + 2.5 * F.log10(F.col("mean"))).alias("mzero"), (2.5 * F.log10(1 + F.col("sem") / F.col("mean"))).alias("sem"), "used")
