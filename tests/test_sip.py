"""Distortion fits: planted cubics come back, few or degenerate pairs give a status, cards hold the factors."""

import numpy as np

from skyframe.operators import sip
from skyframe.operators.fit import POWERS


def pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for frame, n in ((1, 60), (2, 19), (3, 40)):
        x, y = rng.uniform(-1500, 1500, n), rng.uniform(-1000, 1000, n)
        if frame == 3:
            y = 2 * x  # on a line
        u, v = x + 0.5 + 2e-6 * x * y - 3e-10 * x**3, y - 0.25 + 1e-6 * y * y + 2e-10 * x * y * y
        rows += [(frame, *map(float, r)) for r in zip(x, y, u, v, strict=True)]
    return spark.createDataFrame(rows, "frame long, px double, py double, sx double, sy double")


def test_fit_residuals_and_cards(spark):
    p = pairs(spark)
    fits = sip.fitted(p, ["frame"])
    by = {r["frame"]: r for r in fits.collect()}
    assert [by[k]["status"] for k in (1, 2, 3)] == ["ok", "too few pairs", "singular"] and by[2]["a"] is None and by[3]["a"] is None
    want = {"a": {(0, 0): 0.5, (1, 1): 2e-6, (3, 0): -3e-10}, "b": {(0, 0): -0.25, (0, 2): 1e-6, (1, 2): 2e-10}}
    for k, terms in want.items():
        for value, (i, j) in zip(by[1][k], POWERS, strict=True):
            assert abs(value - terms.get((i, j), 0.0)) * 1000.0 ** (i + j) < 1e-6
    r = sip.residuals(p, fits, ["frame"]).collect()
    assert [x["frame"] for x in r] == [1] and r[0]["forward"] < 1e-6 and r[0]["inverse"] < 0.01 and r[0]["there_and_back"] < 0.01
    cards = sip.cards(fits, ["frame"]).orderBy("pos").collect()
    assert len(cards) == 44 and {len(c["text"]) for c in cards} == {80}
    text = {c["key"]: c["text"] for c in cards}
    assert text["AP_ORDER"][:30].split() == ["AP_ORDER=", "3"] and abs(float(text["A_1_1"][10:30]) - 2e-6) < 1e-15 and text["B_0_2"].startswith("B_0_2   = ")
    assert [c["key"] for c in cards[:4]] == ["A_ORDER", "A_0_0", "A_1_0", "A_0_1"]


def test_empty(spark):
    assert sip.fitted(pairs(spark).limit(0), ["frame"]).count() == 0
