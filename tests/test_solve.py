"""Plate solving: how much of a frame's stars the catalogue's square answers."""

import math

import numpy as np
import pytest

from skyframe.plans import solve


def sky_and_frame(spark, width, height, seed, turned=0.5, n=60):
    """A catalogue denser than the frame shows, whose n brightest stars within the frame are its stars."""
    rng = np.random.default_rng(seed)
    ra0, dec0, unit = 1.2, 0.1, 2e-5
    x, y = (rng.uniform(-2000, 2000, 3000) for _ in range(2))  # about the frame's centre
    mag = rng.permutation(3000) / 100.0
    xi, eta = (-x * math.cos(turned) + y * math.sin(turned)) * unit, (x * math.sin(turned) + y * math.cos(turned)) * unit
    den = math.cos(dec0) - eta * math.sin(dec0)
    ra, dec = ra0 + np.arctan2(xi, den), np.arctan2(np.sin(dec0) + eta * np.cos(dec0), np.hypot(xi, den))
    own = [k for k in np.argsort(mag) if abs(x[k]) < width / 2 - 1 and abs(y[k]) < height / 2 - 1][:n]
    catalog = spark.createDataFrame([(k, float(ra[k]), float(dec[k]), float(mag[k])) for k in range(3000)], "id long, ra double, dec double, mag double")
    stars = spark.createDataFrame([(i, float(x[k] + (width + 1) / 2), float(y[k] + (height + 1) / 2)) for i, k in enumerate(own)], "id long, x double, y double")
    return stars, catalog, (ra0, dec0, height * unit, width, height)


@pytest.mark.parametrize(("width", "height"), [(1000, 1000), (1500, 750)])
def test_catalogue_is_as_dense_as_the_frame(spark, width, height):
    """As many stars for its area as the frame has, so that most of the frame's quads are found again; a wide frame whole."""
    for seed in (1, 2):
        stars, catalog, (ra0, dec0, field, w, h) = sky_and_frame(spark, width, height, seed)
        s = solve.solve(stars, catalog, ra0 + 2e-4, dec0 - 1e-4, field, w, h, rings=0)
        assert s is not None and s["QUADS"] >= 21 and abs(s["CRVAL1"] - math.degrees(ra0)) < 1e-4 and abs(s["CRVAL2"] - math.degrees(dec0)) < 1e-4


def test_frames_that_begin_alike_share_their_positions(spark, monkeypatch):
    """The quads of a position are worked out once for all of its frames, in whatever number of copies they are met; the
    catalogue is not written whole."""
    from pyspark.sql import functions as F

    from skyframe.operators import field as fields

    stars, catalog, (ra0, dec0, field, w, h) = sky_and_frame(spark, 1000, 1000, 2)
    both = stars.select(F.lit(0).cast("long").alias("frame"), "id", "x", "y").union(stars.select(F.lit(1).cast("long"), "id", w + 1 - F.col("x"), h + 1 - F.col("y")))
    frames = spark.createDataFrame([(f, ra0 + 2e-4, dec0 - 1e-4, field, w, h) for f in (0, 1)], "frame long, ra0 double, dec0 double, field double, width int, height int")
    groups, ranked, quads_by, stored = [], [], solve.match.quads_by, fields.stored
    monkeypatch.setattr(solve.match, "quads_by", lambda df, cell, by: groups.append((by, df.select(*by).distinct().count())) or quads_by(df, cell, by))
    monkeypatch.setattr(fields, "stored", lambda df, name: ranked.append(df.count()) or stored(df, name) if name == "ranked" else stored(df, name))
    monkeypatch.setattr(solve, "TOGETHER", 1)
    got = {r["frame"]: r for r in solve.searched(frames, both, catalog, 0, 0.007, 3).collect()}
    assert [g[1] for g in groups] == [2, 1]  # the frames' own, the position's
    assert got[0]["quads"] == got[1]["quads"] >= 20 and got[0]["cd1_1"] == pytest.approx(-got[1]["cd1_1"], rel=1e-3)
    assert ranked and max(ranked) < 3000


def test_one_false_pair_does_not_spoil_the_map(spark, monkeypatch):
    """A pair of quads that agree in all ratios and stand some 30 pixels apart."""
    from pyspark.sql import functions as F

    stars, catalog, (ra0, dec0, field, w, h) = sky_and_frame(spark, 1000, 1000, 2)
    agreeing = solve._agreeing

    def with_a_false_one(*a):
        pairs = agreeing(*a)
        first = pairs.orderBy("x").limit(1).select(*[c if c not in "uv" else (F.col(c) + 30).alias(c) for c in pairs.columns])
        return pairs.union(first)

    monkeypatch.setattr(solve, "_agreeing", with_a_false_one)
    s = solve.solve(stars, catalog, ra0 + 2e-4, dec0 - 1e-4, field, w, h, rings=0)
    assert s["QUADS"] == 32 and abs(s["CRVAL1"] - math.degrees(ra0)) < 1e-4 and abs(s["CRVAL2"] - math.degrees(dec0)) < 1e-4
