"""Minor planets in fields: nothing that all pairs would find is missed, and few pairs are looked at."""

import numpy as np
from pyspark.sql import functions as F

from skyframe.functions import sky
from skyframe.kernels import orbit
from skyframe.operators import asteroids

ORBIT = "id long, comet boolean, q double, e double, incl double, node double, peri double, t0 double, epoch double, h double, g double"


def case(spark, n=400, m=60):
    rng = np.random.default_rng(6)
    comet = rng.random(n) < 0.2
    e = np.where(comet, rng.choice([0.7, 0.97, 1.0, 1.1], n), rng.uniform(0, 0.5, n))
    q = np.where(comet, rng.uniform(0.05, 2, n), rng.uniform(0.7, 3, n))
    jd = 2460000.0
    rows = [(i, bool(comet[i]), float(q[i]), float(e[i]), *map(float, rng.uniform(0, 2.9, 3)), float(jd + rng.uniform(-300, 300)), jd - 100.0 * (i % 3), 12.0, 0.15) for i in range(n)]
    frames = [(k, jd + float(rng.uniform(0, 3)), float(rng.uniform(0, 6.28)), float(rng.uniform(-1.4, 1.4)), 0.15) for k in range(m)]
    f = spark.createDataFrame(frames, "frame long, jd double, ra0 double, dec0 double, radius double").withColumn("jd_tt", F.col("jd") + 0.0008)
    return spark.createDataFrame(rows, ORBIT), f


def test_same_as_all_pairs(spark):
    orbits, frames = case(spark)
    got = {(r["frame"], r["id"]): r for r in asteroids.in_fields(frames, orbits, 0.8, 0.2).collect()}
    at = asteroids.observed(frames, F.col("jd_tt"), sky.sidereal(F.col("jd"), F.lit(0.2)), 0.8)
    want = set()
    for r in asteroids.seen(orbits.crossJoin(at)).collect():
        x, y = ((r["ra"] - r["ra0"] + np.pi) % (2 * np.pi) - np.pi) * np.cos(r["dec0"]), r["dec"] - r["dec0"]
        if x * x + y * y < r["radius"] ** 2:
            want.add((r["frame"], r["id"]))
    assert set(got) == want and len(want) > 50
    assert {r["outdated"] for r in got.values() if r["id"] % 3 == 2 and not r["comet"]} == {True} and not any(r["outdated"] for r in got.values() if r["comet"] or r["id"] % 3 == 0)
    assert asteroids.candidates(at, orbits).count() < 0.35 * 400 * 60


def test_velocity_is_the_slope_of_the_position():
    for e in (0.0, 0.3, 0.99, 1.0, 1.4):
        a, b, c = (np.array(orbit.state(1.2, e, 0.4, 1.0, 2.0, t)) for t in (99.99, 100.0, 100.01))
        assert np.allclose((c[:3] - a[:3]) / 0.02, b[3:], atol=1e-8)


def test_elements_and_empty(spark):
    rows = [(1, 2460000.5, 0.0, 10.0, 20.0, 5.0, 0.1, 2.5, None, 10.0, 0.15), (2, 2460100.5, None, 10.0, 20.0, 5.0, 1.0, None, 0.9, 7.0, 10.0)]
    o = asteroids.orbits(spark.createDataFrame(rows, "id long, epoch double, anomaly double, peri double, node double, incl double, e double, axis double, q double, h double, g double")).collect()
    assert (o[0]["comet"], round(o[0]["q"], 6), o[0]["t0"]) == (False, 2.25, 2460000.5) and (o[1]["comet"], o[1]["q"], o[1]["t0"]) == (True, 0.9, 2460100.5)
    orbits, frames = case(spark, 5, 5)
    assert asteroids.in_fields(frames.limit(0), orbits, 0.8, 0.2).count() == 0 == asteroids.in_fields(frames, orbits.limit(0), 0.8, 0.2).count()


def test_an_orbit_is_followed_once_a_time(spark):
    """Frames of one time share the exact places: pairs are of orbits and times."""
    orbits, frames = case(spark, 200, 40)
    one = frames.withColumns({"jd": F.lit(2460000.25), "jd_tt": F.lit(2460000.2508)})
    pairs = asteroids.candidates(one, orbits)
    assert pairs.count() <= 200 and pairs.select("id").distinct().count() == pairs.count()
    alone = asteroids.in_fields(one.filter("frame = 7"), orbits, 0.8, 0.2).select("id", "ra", "mag").collect()
    assert sorted(map(tuple, alone)) == sorted(map(tuple, asteroids.in_fields(one, orbits, 0.8, 0.2).filter("frame = 7").select("id", "ra", "mag").collect()))
