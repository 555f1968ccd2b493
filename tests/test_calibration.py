"""Photometric calibration against its definition, apertures, wide-field files and replies."""

import math

import numpy as np
import pytest

from skyframe.operators import calibration, catalogs, demosaic
from skyframe.sources import widefield

STAR = "frame long, id long, mag double, x double, y double, hfd double, flux double, snr double, sd double, peak double, reason string"


def smedian(v):
    v, h = sorted(v), len(v) // 2
    return sum(v[h - 1 : h + 1]) / 2 if len(v) % 2 == 0 else sum(v[h - 1 : h + 2]) / 3 if len(v) >= 5 else v[h]


def test_zero_point_by_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(f, k, float(m := rng.uniform(8, 14)), 0.0, 0.0, float(rng.uniform(2, 4)), float(10 ** ((25 + f - m) / 2.5) * rng.normal(1, 0.03) * (3 if k % 9 == 0 else 1)), 99.0, float(rng.uniform(5, 9)), 1.0, "noise" if k % 10 == 3 else None) for f in range(3) for k in range(60)]
    rows += [(7, k, 10.0, 0.0, 0.0, 2.0, 100.0, 99.0, 1.0, 1.0, None) for k in range(2)]
    frames = spark.createDataFrame([(f,) for f in (0, 1, 2, 7, 8)], "frame long")
    for ratio in (0.0, 2.0):
        got = {r["frame"]: r for r in calibration.frame_calibration(frames, spark.createDataFrame(rows, STAR), ratio).collect()}
        assert got[7]["failure"] == got[8]["failure"] == "no stars" and got[7]["mzero"] is None and (got[7]["stars"], got[8]["stars"]) == (2, 0)
        for f in range(3):
            own = [r for r in rows if r[0] == f and r[-1] is None]
            ratios = [r[6] / 10 ** ((21 - r[2]) / 2.5) for r in own]
            mid = smedian(ratios)
            mad = smedian([abs(r - mid) for r in ratios])
            kept = [r for r in ratios if abs(r - mid) < 1.5 * 1.4826 * mad]
            mzero = 21 + 2.5 * math.log10(sum(kept) / len(kept))
            s = (ratio or 10) * 2.3548 / 2
            limit = mzero - 2.5 * math.log10(7 * math.sqrt(math.pi) * smedian([r[5] * r[8] for r in own]) * (1 - math.exp(-s * s / 2)))
            assert (got[f]["stars"], got[f]["used"], got[f]["failure"]) == (len(own), len(kept), None)
            assert got[f]["mzero"] == pytest.approx(mzero, abs=1e-9) and got[f]["limit"] == pytest.approx(limit, abs=1e-9) and abs(mzero - 25 - f) < 0.05


def test_equal_ratios_are_all_outliers(spark):
    rows = [(1, k, 10.0, 0.0, 0.0, 2.0, 100.0, 99.0, 1.0, 1.0, None) for k in range(5)]
    row = calibration.frame_calibration(spark.createDataFrame([(1,)], "frame long"), spark.createDataFrame(rows, STAR)).first()
    assert (row["stars"], row["used"], row["failure"], row["mzero"]) == (5, 0, "outliers", None)


def test_apertures(spark):
    found = spark.createDataFrame([(1, 2.0, 50.0), (1, 4.0, 50.0), (1, 30.0, 9.0), (2, 3.0, 10.0), (3, 40.0, 99.0)], "frame long, hfd double, snr double")
    got = {r["frame"]: (r["aperture"], r["ring"]) for r in calibration.apertures(found, 1.5, 12.0).collect()}
    assert got == {1: (2.25, 17), 3: (30.0, 50)}  # frame 2 has no star over the noise
    assert calibration.apertures(found, 0.0, 12.0).count() == 0


def test_wide_field_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    stars = np.stack([np.sort(rng.integers(10, 120, 2500)), rng.uniform(0, 6, 2500), rng.uniform(-1.5, 1.5, 2500)], 1).astype("<f4")
    (tmp_path / f"w08{widefield.SUFFIX}").write_bytes(np.array([2500], "<i4").tobytes() + stars.tobytes())
    (tmp_path / f"none{widefield.SUFFIX}").write_bytes(np.array([0], "<i4").tobytes())
    df = widefield.read(spark, str(tmp_path), records=400)
    assert df.rdd.getNumPartitions() == 7 and df.count() == 2500
    got = df.filter("mag < 5").toPandas()
    assert len(got) == (stars[:, 0] < 50).sum() and set(got["file"]) == {f"w08{widefield.SUFFIX}"}
    assert np.allclose(np.sort(got["ra"]), np.sort(stars[stars[:, 0] < 50, 1].astype(float)))
    (tmp_path / f"cut{widefield.SUFFIX}").write_bytes(np.array([9], "<i4").tobytes() + stars[:3].tobytes())
    with pytest.raises(Exception, match="bytes for 9 stars"):
        widefield.read(spark, str(tmp_path)).count()


def test_wide_field_written(spark, tmp_path):
    df = spark.range(3000).selectExpr("id / 500.0D as ra", "0.5D as dec", "(id * 7919 % 1000) / 100.0D as mag")
    files = widefield.write(df, f"file://{tmp_path}").collect()
    assert sum(r["stars"] for r in files) == 3000 and {r["file"] for r in files} == {f.name for f in tmp_path.iterdir()}
    assert widefield.read(spark, f"file://{tmp_path}").filter("mag <= 5").count() == df.filter("floor(mag * 10 + 0.5) / 10 <= 5").count()


def test_replies(spark):
    head = [f"line {k}" for k in range(35)] + ["RA_ICRS  DE_ICRS", "-------"]
    body = ["10.5 -20.25 9.5 9.9 8.9", "x10 1.0 9.5 9.9 8.9", "350.0  +1.5 9.5", "11.0 2.0 7.5 7.9", "12.0  2.5 8.5  8.9 8.1", "", "9.0 1.0 5.5 5.6 5.4", "end"]
    lines = [("a", k, t) for k, t in enumerate(head + body)] + [("b", 0, "RA_ICRS"), ("b", 3, "10.5 -20.25 9.5 9.9 8.9")]
    df = spark.createDataFrame(lines, "reply string, pos long, text string")
    gaia = catalogs.gaia_stars(df).orderBy("pos").collect()
    assert [(r["g"], r["bp"], r["rp"], r["mag"]) for r in gaia] == [(9.5, 9.9, 8.9, 9.9), (7.5, 7.9, 0.0, 7.9), (8.5, 8.9, 8.1, 8.9)]
    assert gaia[0]["ra"] == pytest.approx(math.radians(10.5)) and gaia[0]["dec"] == pytest.approx(math.radians(-20.25))
    vizier = catalogs.vizier_stars(df).orderBy("pos").collect()
    assert [(r["ra_units"], r["dec_units"], r["mag"]) for r in vizier if r["ra_units"]][0] == (25200, -72900, 9.5)


def test_guarded_flat_frame_keeps_its_colours(spark):
    """Without a background every neighbour over its mean makes a place grey; with one, a flat frame keeps its colours."""
    px = spark.createDataFrame([(1, x, y, 100 + 50 * (x % 2) + 20 * (y % 2)) for x in range(12) for y in range(12)], "frame long, x long, y long, v long")
    level = spark.createDataFrame([(1, 1000.0)], "frame long, background double")
    got = {(r["r"], r["g"], r["b"]) for r in demosaic.guarded(px, level, 12, 12).collect()}
    assert got == {(100.0, 135.0, 170.0), (100.0, 150.0, 170.0), (100.0, 120.0, 170.0)}
    assert demosaic.x_trans(px, 12, 12).count() == 81


def test_fields_stay_apart(spark, monkeypatch):
    """As many frames as a larger table has: no star is a candidate of another's frame."""
    from pyspark.sql import functions as F

    from skyframe.plans import measure

    parts = spark.range(1, 120_001).select(F.col("id").alias("p_partkey"))
    monkeypatch.setattr(measure.views, "table", lambda *a: parts)
    s = measure._shot_solutions(spark, "")
    got = calibration.candidates(s, measure._shot_catalog(spark, "", s)).join(measure._shots(spark, "").select("k", F.col("frame").alias("own")), F.col("id") == F.col("k"))
    assert got.filter("frame <> own").count() == 0 and got.count() == parts.filter("p_partkey % 11 <> 0").count()
