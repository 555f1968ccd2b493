"""The small aperture of a calibration: what lies within it is the flux, and the stars its size is taken from."""

import math

import numpy as np
import pytest

from skyframe.kernels import stars
from skyframe.operators import calibration, frames


def field(places, size=160, sigma=2.0):
    y, x = np.mgrid[:size, :size]
    img = 500.0 + ((x * 7919 + y * 104729) % 21 - 10)
    return img + sum(p * np.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * sigma**2)) for a, b, p in places)


def test_flux_is_what_lies_within_the_aperture():
    sigma, peak = 2.0, 20000.0
    img = field([(80.3, 79.6, peak)], sigma=sigma)
    whole = peak * 2 * math.pi * sigma**2
    full = stars.measure(img, 80, 80, 14)
    for aperture in (2.0, 3.0, 4.0):
        m = stars.measure(img, 80, 80, 19, aperture)
        within = whole * (1 - math.exp(-(aperture**2) / (2 * sigma**2)))
        assert m["flux"] == pytest.approx(within, rel=0.05) and m["flux"] < 0.95 * full["flux"]
        assert m["snr"] == pytest.approx(m["flux"] / math.sqrt(m["flux"] + math.pi * (aperture * m["sd"]) ** 2))
        # the whole star's light over the flux of the aperture
        assert m["hfd"] * m["flux"] == pytest.approx(full["hfd"] * full["flux"], rel=0.05)
    assert stars.measure(img, 80, 80, 14, 50.0)["flux"] == pytest.approx(full["flux"], rel=0.01)


def test_stars_of_the_median():
    """Stars under the SNR are no part of it: they take no room from others, and don't make the level high enough."""
    bright, faint = [(40 + 40 * k, 40, 9000.0) for k in range(3)], [(40 + 40 * k, 100, 60.0) for k in range(3)]
    img = field(bright + faint)
    assert sum(10 < s["snr"] < 30 for s in stars.find(img, 4)) == 3
    got = stars.analysed(img, 4)
    assert [round(s["y"]) for s in got] == [40, 40, 40] and all(s["snr"] > 30 for s in got)
    assert not stars.analysed(img + 60000.0)  # too light a sky


def test_aperture_reaches_the_flux(spark):
    img = field([(40 + 40 * (k % 3), 40 + 40 * (k // 3), 3000.0 + 500 * k) for k in range(9)])
    images = spark.createDataFrame([(1, *img.shape, img.tobytes())], frames.IMAGE)
    places = spark.createDataFrame([(1, k, 10.0, 40.0 + 40 * (k % 3), 40.0 + 40 * (k // 3)) for k in range(9)], "frame long, id long, mag double, x double, y double")
    flux = {}
    for ratio in (0.0, 1.0):
        sizes = calibration.apertures(frames.analysed(images), ratio, 8.0)
        flux[ratio] = {r["id"]: r["flux"] for r in calibration.measured(images, places, sizes).collect()}
    inside = 1 - math.exp(-((5.01 / 2) ** 2) / 8)  # of a star whose HFD is 5.01
    for k in range(9):
        assert flux[1.0][k] == pytest.approx(inside * flux[0.0][k], rel=0.05)


def test_drawn_images_stay_where_they_are(spark, tmp_path):
    """What is drawn from rows gives what images give, and a frame without a row has no star; no step holds an image."""
    from skyframe.plans import measure

    spark.range(1, 101).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    rows = measure._exposures(spark, str(tmp_path))
    images = spark.createDataFrame([(r["frame"], measure.SHOT, measure.SHOT, measure._exposed(r).tobytes()) for r in rows.collect()], frames.IMAGE)
    solutions = measure._shot_solutions(spark, str(tmp_path))
    places = calibration.candidates(solutions, measure._shot_catalog(spark, str(tmp_path), solutions))
    places = places.unionByName(spark.createDataFrame([(99, 7, 10.0, 50.0, 50.0)], "frame long, id long, mag double, x double, y double"))
    both = []
    for some, image in ((images, None), (rows, measure._exposed)):
        sizes = calibration.apertures(frames.analysed(some, image), 2.0, 8.0)
        both.append(calibration.measured(some, places, sizes, image=image))
    stored, drawn = ([tuple(r) for r in df.orderBy("frame", "id").collect()] for df in both)
    assert len(drawn) == 92 and drawn == stored and drawn[-1][-1] == "no star"
    assert "data" not in {c for line in both[1]._jdf.queryExecution().analyzed().toString().split() for c in line.replace(",", " ").split("#")}
