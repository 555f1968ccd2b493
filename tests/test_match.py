"""Nearest neighbours against all pairs; holes and boxes on a small frame."""

import os
import random

import pytest

from skyframe.operators import match, pixels


def test_nearest_of_clusters_and_far_stars(spark):
    r = random.Random(5)
    stars = [(i, r.uniform(-30, 30), r.uniform(-30, 30)) for i in range(40)] + [(100, 5000.0, -400.0), (101, -900.0, 20.0)]
    got = match.nearest(spark.createDataFrame(stars, "id long, x double, y double"), 3, 5.0).collect()
    want = set()
    for i, x, y in stars:
        away = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in stars if j != i)
        want |= {(i, j, k + 1) for k, (_, j) in enumerate([p for p in away if p[0] > 1][:3])}
    assert {(g["id"], g["other"], g["rank"]) for g in got} == want and len(got) == len(want)


def test_nearest_of_too_few(spark):
    schema = "id long, x double, y double"
    assert match.nearest(spark.createDataFrame([], schema), 3, 5.0).count() == 0
    got = match.nearest(spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0)], schema), 3, 5.0).collect()
    assert sorted((g["id"], g["other"]) for g in got) == [(1, 2), (2, 1)]


def test_holes_take_values_that_came(spark):
    px = spark.createDataFrame([(0, 0, 0, 5), (0, 2, 1, 9), (1, 1, 0, 7)], "frame long, x long, y long, v long")
    got = {(g["frame"], g["x"], g["y"]): g["v"] for g in pixels.holes_filled(px, 3, 2).collect()}
    assert len(got) == 12
    assert got[0, 1, 0] == 5 and got[0, 2, 0] is None and got[0, 0, 1] == 5 and got[0, 2, 1] == 9
    assert got[1, 2, 0] == 7 and got[1, 1, 1] == 7 and got[1, 0, 0] is None


def test_box_median_ignores_zero(spark):
    px = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 4), (0, 2, 0, 8), (0, 9, 9, 0)], "frame long, x long, y long, v long")
    got = {(g["x"], g["y"]): g["background"] for g in pixels.box_median(px, 2).collect()}
    assert got == {(0, 0): 4, (1, 0): 8, (2, 0): 8, (9, 9): 0}


def walk(points, distance):
    kept = []
    for i, x, y in sorted(points):
        if not any(abs(x - a) < distance and abs(y - b) < distance for _, a, b in kept):
            kept.append((i, x, y))
    return {i for i, _, _ in kept}


def test_first_within_is_the_walk(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    crowd = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 12, (400, 2)))]
    heap = [(1000 + i, 50.0 + i * 1e-4, 50.0) for i in range(300)]  # one cell
    chain = [(2000 + i, 100.0 + i * 0.7, 3.0) for i in range(40)]
    edge = [(3000, -0.5, -0.5), (3001, 0.5, 0.5), (3002, 0.49, -0.5)]
    for points in (crowd, heap, chain, edge, crowd + heap + chain + edge):
        got = {r["id"] for r in match.first_within(spark.createDataFrame(points, "id long, x double, y double"), 1.0).collect()}
        assert got == walk(points, 1.0)
    assert match.first_within(spark.createDataFrame([], "id long, x double, y double")).count() == 0


def test_sky_cells_find_all_neighbours(spark):
    """Near the poles, over the turn of right ascension, and elsewhere: the same as all pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    n, radius = 900, 0.06
    dec = np.concatenate([np.arcsin(rng.uniform(-1, 1, n)), rng.uniform(1.45, 1.57, 60), rng.uniform(-1.57, -1.45, 60)])
    ra = np.concatenate([rng.uniform(0, 2 * np.pi, n), rng.uniform(0, 2 * np.pi, 120)])
    ra[:40] = rng.uniform(0, 0.03, 40)
    cat = list(zip(range(len(ra)), ra.tolist(), dec.tolist(), strict=True))
    points = [(i, (r + 0.01) % (2 * np.pi), float(np.clip(d + 0.005, -1.57, 1.57))) for i, r, d in cat[::3]]
    got = {r["pid"]: r["id"] for r in match.nearest_in_sky(spark.createDataFrame(points, "pid long, ra double, dec double"), spark.createDataFrame(cat, "id long, ra double, dec double"), radius).collect()}
    want = {}
    for p, r, d in points:
        x, y = ((ra - r + np.pi) % (2 * np.pi) - np.pi) * np.cos(d), dec - d
        s = x * x + y * y
        if s.min() < radius * radius:
            want[p] = int(s.argmin())
    assert got == want


def test_overall_median(spark, monkeypatch):
    from skyframe.operators import robust

    monkeypatch.setattr(robust, "FEW", 20)
    for values in ([1.0], [2.0] * 500, [float(i % 7) for i in range(300)], [i * i * 0.37 for i in range(801)], [5.0] * 50 + [1e9]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert robust.overall_upper_median(df, "v") == sorted(values)[len(values) // 2]
    assert robust.overall_upper_median(spark.createDataFrame([], "v double"), "v") is None


def test_points_at_one_place_are_looked_up_once(spark):
    """Nothing is broadcast, and pairs are those of places, not of points."""
    from pyspark.sql import functions as F

    points = spark.range(2000).select(F.col("id").alias("pid"), (F.col("id") % 4 / 10.0).alias("ra"), F.lit(0.2).alias("dec"))
    catalog = spark.range(300).select("id", (F.col("id") / 1000.0).alias("ra"), F.lit(0.201).alias("dec"))
    got = match.nearest_in_sky(points, catalog, 0.03, F.col("id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") >= 2
    assert {(r["pid"] % 4, r["id"]) for r in got.collect()} == {(0, 0), (1, 70), (2, 170), (3, 270)} and got.count() == 2000


def test_brightest_in_square_is_that_of_all_pairs(spark):
    """Over the poles and the turn of right ascension; and no more pairs are met as the catalogue gets dense."""
    import numpy as np
    from pyspark.sql import functions as F

    from skyframe.operators import field

    rng = np.random.default_rng(8)
    n = 6000
    dec = np.where(np.arange(n) % 3 == 0, rng.uniform(1.3, 1.57, n), rng.uniform(-0.3, 0.3, n))
    ra, mag = rng.uniform(0, 2 * np.pi, n), rng.integers(0, 40, n) / 2.0
    cat = spark.createDataFrame([(i, float(ra[i]), float(dec[i]), float(mag[i]), i % 2) for i in range(n)], "id long, ra double, dec double, mag double, kind int")
    fields = [(k, float(rng.uniform(0, 6.28)) if k % 4 else 0.01, (0.1, 1.5, -0.2, 1.569)[k % 4], 0.3 if k % 5 else 0.04, (7, 40)[k % 2], k % 2) for k in range(24)] + [(99, 1.0, -1.2, 0.2, 5, 0)]
    frames = spark.createDataFrame(fields, "frame long, ra0 double, dec0 double, field double, wanted int, kind int")
    want, pairs = set(), set()
    for f, a, d, w, top, kind in fields:
        inside = (np.abs((ra - a + np.pi) % (2 * np.pi) - np.pi) * np.cos(d) < w / 2) & (np.abs(dec - d) < w / 2)
        pairs |= {(f, int(i)) for i in np.flatnonzero(inside)}
        order = sorted((mag[i], int(i)) for i in np.flatnonzero(inside & (np.arange(n) % 2 == kind)))
        want |= {(f, i, r + 1) for r, (_, i) in enumerate(order[:top])}
    got = [(r["frame"], r["id"], r["rank"]) for r in field.brightest_in_square(frames, cat, ["frame"], ("kind",)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [(r["frame"], r["id"]) for r in field.in_square(frames.drop("kind"), cat).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    plan = field.in_square(frames.drop("kind"), cat.filter(F.col("id") >= 0))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_nearest_of_copies_and_crowds(spark, monkeypatch):
    """Many stars at one place, and a crowd in one cell: the same as all pairs, with few pairs."""
    r = random.Random(7)
    stars = [(i, r.gauss(0, 8), r.gauss(0, 8)) for i in range(250)]
    stars += [(1000 + i, *stars[i % 3][1:]) for i in range(150)] + [(2000, 400.0, 3.0)]
    df = spark.createDataFrame(stars, "id long, x double, y double")
    assert match._first_cell(df, (), 200.0, 1.0) < 20
    got = match.nearest(df, 3, 200.0).collect()
    want = set()
    for i, x, y in stars:
        away = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in stars if j != i)
        want |= {(i, j, k + 1) for k, (_, j) in enumerate([p for p in away if p[0] > 1][:3])}
    assert {(g["id"], g["other"], g["rank"]) for g in got} == want and len(got) == len(want)


def test_pairs_of_a_crowd_are_few_before_they_are_ranked(spark, monkeypatch):
    """Denser than `least`: hundreds are near each star, but only some go to the ranks, the k nearest among them."""
    r = random.Random(11)
    stars = [(i, r.uniform(0, 6), r.uniform(0, 6)) for i in range(1200)]
    few, near_pairs = [], match._near_pairs
    monkeypatch.setattr(match, "_near_pairs", lambda *a: few.append(near_pairs(*a).cache()) or few[-1])
    got = match.nearest(spark.createDataFrame(stars, "id long, x double, y double"), 3, 20.0).collect()
    assert few[0].count() < 8 * len(stars)
    want = set()
    for i, x, y in stars:
        away = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in stars if j != i)
        want |= {(i, j, k + 1) for k, (_, j) in enumerate([p for p in away if p[0] > 1][:3])}
    assert {(g["id"], g["other"], g["rank"]) for g in got} == want and len(got) == len(want)


def test_far_stars_and_crowds_bring_no_task_the_whole_table(spark, monkeypatch):
    """The wide cell of a far star and a crowd nearer than `least` meet nearly all stars: they come in parts of some BLOCK stars."""
    from pyspark.sql import functions as F

    r = random.Random(13)
    stars = [(i, r.uniform(0, 40), r.uniform(0, 40)) for i in range(500)] + [(1000 + i, 90 + r.uniform(0, 0.4), 9 + r.uniform(0, 0.4)) for i in range(200)]
    stars += [(2000, 1500.0, 0.0), (2001, -900.0, 1200.0)] + [(3000 + i, 40.0, 41.0) for i in range(9)]
    most, near_pairs = [], match._near_pairs

    def watched(here, there, key, *rest):
        most.append([df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0 for df in (here, there)])
        return near_pairs(here, there, key, *rest)

    monkeypatch.setattr(match, "BLOCK", 100, raising=False)
    monkeypatch.setattr(match, "_near_pairs", watched)
    got = match.nearest(spark.createDataFrame(stars, "id long, x double, y double"), 3, 20.0).collect()
    assert len(most) > 3 and max(h for h, _ in most) <= 150 and max(t for _, t in most) <= 150
    want = set()
    for i, x, y in stars:
        away = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in stars if j != i)
        want |= {(i, j, k + 1) for k, (_, j) in enumerate([p for p in away if p[0] > 1][:3])}
    assert {(g["id"], g["other"], g["rank"]) for g in got} == want and len(got) == len(want)


def test_median_of_pairs_goes_over_them_twice(spark):
    """Pairs may be as many as the square of a table: they are not worked out again for each round of the search."""
    from skyframe.operators import robust

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(60_001).selectExpr("cast(pmod(id * 7919, 60001) as double) / 30000 - 0.5 as v").mapInArrow(count, "v double")
    assert robust.overall_upper_median(df, "v") == 0.5 and seen.value <= 2 * 60_001


def test_median_below_zero_and_far_apart(spark):
    from skyframe.operators import robust

    for values in ([-5.0, -3.0, 0.0, 0.0, 1e-300, 4.0], [-0.25] * 9 + [-4.0] * 9 + [8.0], [-1e300, -1e-300, 1e300], [0.0] * 5):
        assert robust.overall_upper_median(spark.createDataFrame([(v,) for v in values], "v double"), "v") == sorted(values)[len(values) // 2]


def test_ratio_filter_writes_no_pairs(spark, monkeypatch):
    from skyframe.plans import queries

    names, stored = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, name: names.append(name) or stored(df, name))
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    assert queries.quad_ratio_filter(spark, "/root/testdata/sf0.001").columns == ["id_a", "id_b", "ratio"] and names == ["quads"]


def test_band_match_shuffles_and_is_that_of_all_pairs(spark):
    """Tables whose size Spark knows to be small now would be broadcast, and grow with the input."""
    from pyspark.sql import functions as F

    columns = ["r2", "r3", "r4", "r5", "r6"]
    q = spark.range(300).select("id", (F.lit(3.0) + F.col("id")).alias("d1"), *[(F.pmod(F.col("id") * (17 + 10 * i), F.lit(41)) / 100.0).alias(c) for i, c in enumerate(columns)])
    a, b = q.filter("id % 2 = 0"), q.filter("id % 2 = 1")
    got = match.band_match(a, b, columns, 0.05)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = {(x["id"], y["id"], y["d1"] / x["d1"]) for x in a.collect() for y in b.collect() if all(abs(x[c] - y[c]) <= 0.05 for c in columns)}
    got = [tuple(r) for r in got.collect()]
    assert len(want) > 20 and len(got) == len(want) and set(got) == want
