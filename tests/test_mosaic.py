"""The mosaic against a walk over the frames, and its levels by rounds."""

import numpy as np

from skyframe.operators import mosaic


def walk(frames, images, limit):
    """frames: (order, dx, dy, background)."""
    h, w = images[0].shape
    value, last = {}, {}
    for (_, dx, dy, bg), img in zip(frames, images, strict=True):
        inside = [(x, y) for y in range(1, h - 2) for x in range(1, w - 2) if img[y, x] > 0.0001]
        diff = [value[x + dx, y + dy] - (img[y, x] + 1000 - bg) for x, y in inside if (x + dx, y + dy) in value]
        diff = [d for d in diff if abs(d) < limit]
        level = sum(diff) / len(diff) if diff else 0.0
        for x, y in inside:
            at, d = (x + dx, y + dy), 1.0 + min(x, y, w - 1 - x, h - 1 - y)
            v = img[y, x] + 1000 - bg + level
            value[at] = v if at not in value else (value[at] * last[at] + v * d) / (last[at] + d)
            last[at] = d
    return value


def case(spark):
    rng = np.random.default_rng(2)
    scene = rng.uniform(500, 600, (60, 60))
    frames = [(3, 0, 0, 1000.0), (5, 9, 2, 990.0), (6, 4, 10, 1015.0), (8, 13, 13, 1003.0), (9, 40, 40, 1000.0)]
    images = [scene[dy : dy + 16, dx : dx + 18] + 7.0 * k for k, (_, dx, dy, _) in enumerate(frames)]
    images[1][5, 5] = 0
    px = spark.createDataFrame([(i, x, y, float(img[y, x])) for i, img in enumerate(images) for y in range(16) for x in range(18)], "frame long, x int, y int, v double")
    fr = spark.createDataFrame([(i, o, 18, 16, dx, dy, bg) for i, (o, dx, dy, bg) in enumerate(frames)], "frame long, order long, width int, height int, dx int, dy int, background double")
    return frames, images, px, fr


def test_same_as_a_walk(spark):
    frames, images, px, fr = case(spark)
    # levels relative to earlier frames are small here, so the limit on differences cuts nothing off in either
    want = walk(frames, images, 1e6)
    got = {(r["x"], r["y"]): (r["v"], r["frames"]) for r in mosaic.mosaic(px, fr, 1e6).collect()}
    assert all(abs(got[k][0] - v) < 1e-6 for k, v in want.items())
    x1, y1 = max(x for x, _ in want), max(y for _, y in want)
    for (x, y), (v, n) in got.items():
        if (x, y) not in want:
            assert n == 0 and x <= x1 and y <= y1 and abs(v - want.get((x - 1, y), want.get((x, y - 1)))) < 1e-6


def test_levels_by_rounds_and_by_a_walk(spark):
    _, _, px, fr = case(spark)
    factors = mosaic.level_factors(mosaic.stacked(mosaic.placed(px, fr)), 1e6)
    a, b = ({r["frame"]: r["level"] for r in mosaic.levels(fr, factors, few).collect()} for few in (0, 1000))
    assert a.keys() == b.keys() == {3, 5, 6, 8, 9} and all(abs(a[k] - b[k]) < 1e-9 for k in a) and a[9] == 0


def test_empty(spark):
    _, _, px, fr = case(spark)
    assert mosaic.mosaic(px.limit(0), fr, 10.0).count() == 0


def test_levels_by_blocks(spark, monkeypatch):
    """A strip of frames, each on the one before and those of the row below: blocks, and blocks of blocks, come to the walk's
    levels."""
    n = 400
    links = [(f, f - d, 0.3 + 0.01 * (f * d % 7)) for f in range(n) for d in (1, 4, 5) if f >= d]
    base, needs = spark.createDataFrame([(f, f * 7 % 11 - 5.0) for f in range(n)], "frame long, base double"), spark.createDataFrame(links, "frame long, other long, factor double").withColumn("factor", mosaic.F.col("factor") / 4)
    want = {r["frame"]: r["level"] for r in mosaic._walked(base, needs).collect()}
    monkeypatch.setattr(mosaic, "_by_rounds", None)
    for few, block in ((1000, 50), (20, 100)):
        got = {r["frame"]: r["level"] for r in mosaic._by_blocks(base, needs, few, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)
