"""Colour from raw frames (frame, x, y, v), x and y counted from 0. Each raw pixel goes to the places that read it and to
no others, and is gathered there: a frame is never one task's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which raw pixels a place of the 3 x 3 cell reads its colours from, as steps (dx, dy). By (column, row) of the
#: cell: first and second colour beside green, and green. The cells' two halves swap the first and the second.
X_TRANS = {
    (0, 0): {"one": (0, 1), "green": (0, 0), "two": (1, 0)},
    (1, 0): {"one": (0, -1), "green": (1, 0), "two": (0, 0)},
    (2, 0): {"one": (0, 1), "green": (0, 0), "two": (-1, 0)},
    (0, 1): {"one": (0, 0), "green": (1, 0), "two": (-1, 0)},
    (1, 1): {"one": (1, 0), "green": (0, 0), "two": (0, 1)},
    (2, 1): {"one": (0, 0), "green": (0, 1), "two": (1, 0)},
    (0, 2): {"one": (0, -1), "green": (0, 0), "two": (1, 0)},
    (1, 2): {"one": (0, 1), "green": (1, 0), "two": (0, 0)},
    (2, 2): {"one": (0, -1), "green": (0, 0), "two": (-1, 0)},
}


def x_trans(px: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, x, y, r, g, b) of frames with cells of 6 x 6, for x from 2 to width - 2 and y from 2 to height - 2; a colour
    whose raw pixel is missing is null."""
    readers: dict[tuple[int, int], list[tuple[str, int, int]]] = {}
    for (cx, cy), reads in X_TRANS.items():
        for colour, (dx, dy) in reads.items():
            readers.setdefault(((cx + dx) % 3, (cy + dy) % 3), []).append((colour, dx, dy))
    to = [F.array(*[F.struct(F.lit(c).alias("c"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for c, dx, dy in readers.get((i % 3, i // 3), [])]) for i in range(9)]
    cell = (F.pmod(F.col("y") - 1, F.lit(3)) * 3 + F.pmod(F.col("x") - 1, F.lit(3))).cast("int")
    given = px.select("frame", "x", "y", "v", F.explode(F.get(F.array(*to), cell)).alias("to"))
    given = given.select("frame", (F.col("x") - F.col("to.dx")).alias("x"), (F.col("y") - F.col("to.dy")).alias("y"), F.col("to.c").alias("c"), "v")
    given = given.filter(F.col("x").between(2, width - 2) & F.col("y").between(2, height - 2))
    got = given.groupBy("frame", "x", "y").agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in ("one", "green", "two")])
    half = lambda c: F.floor(F.pmod(F.col(c) - 1, F.lit(6)) / 3)
    same = half("x") == half("y")
    pick = lambda a, b: F.when(same, F.col(a)).otherwise(F.col(b))
    return got.select("frame", "x", "y", pick("one", "two").alias("r"), F.col("green").alias("g"), pick("two", "one").alias("b"))


def sampled_background(px: DataFrame, width: int, height: int, margin: int = 10, part: int = 100) -> DataFrame:
    """(frame, background): the mean of the 2 x 2 pixels at each place from margin to a part-th of the frame less margin; 0
    for frames too small for such a place."""
    last = lambda size: (size - margin) // part
    inside = lambda c, size, k: F.col(c).between(margin + k, last(size) + k)
    times = lambda c, size: sum((inside(c, size, k).cast("int") for k in (0, 1)), F.lit(0))
    weight = times("x", width) * times("y", height)
    sums = px.groupBy("frame").agg(F.sum(weight * F.col("v")).alias("s"), F.sum(weight).alias("n"))
    return sums.select("frame", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("background"))


#: How far over its mean a neighbour may be, as a share of the background, at green places and at others.
GUARD, OTHERS = 0.5, 1.67

#: The parity of column and row at which a pattern's red pixels are.
RED_AT = {"GRBG": (1, 0), "BGGR": (1, 1), "RGGB": (0, 0), "GBRG": (0, 1)}


def guarded(px: DataFrame, backgrounds: DataFrame, width: int, height: int, pattern: str = "RGGB") -> DataFrame:
    """(frame, x, y, r, g, b) at all inner pixels of Bayer frames, bilinear; where a neighbour is further over its mean than
    a share of the frame's background (backgrounds: frame, background), as at a star's edge, all three are their mean.

    At a green place the two neighbours of each other colour are means of two; those in its row and column are held against the
    mean of the red ones and the pixel itself. At a red or blue place green and the opposite colour are means of four."""
    rx, ry = RED_AT[pattern]
    moves = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    to = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in moves])).alias("to")
    red_column = lambda x: F.pmod(x, F.lit(2)) == rx
    red_row = lambda y: F.pmod(y, F.lit(2)) == ry
    seen = px.select("frame", "x", "y", "v", to).select("frame", (F.col("x") - F.col("to.dx")).alias("x"), (F.col("y") - F.col("to.dy")).alias("y"), F.col("to.dx").alias("dx"), F.col("to.dy").alias("dy"), "v")
    seen = seen.filter(F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2))
    green = red_column(F.col("x")) != red_row(F.col("y"))
    seen = seen.filter(~green | (F.col("dx") == 0) | (F.col("dy") == 0))  # a green place reads no corners
    at = lambda dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("v").cast("double"))).alias(f"p{dx + 1}{dy + 1}")
    p = seen.groupBy("frame", "x", "y").agg(*[at(dx, dy) for dx, dy in moves]).join(backgrounds, "frame")
    here, sides = F.col("p11"), {"row": [F.col("p01"), F.col("p21")], "column": [F.col("p10"), F.col("p12")]}
    mean = lambda cs: sum(cs[1:], cs[0]) / len(cs)
    cross, corners = sides["row"] + sides["column"], [F.col(f"p{i}{j}") for i in (0, 2) for j in (0, 2)]
    own_row = red_row(F.col("y"))  # a green pixel of a red row has red beside it, one of a blue row above and below
    of_row = lambda a, b: F.when(own_row, a).otherwise(b)
    is_red = red_column(F.col("x")) & own_row
    reds, blues = (of_row(mean(sides[a]), mean(sides[b])) for a, b in (("row", "column"), ("column", "row")))
    r = F.when(green, reds).when(is_red, here).otherwise(mean(corners))
    g = F.when(green, here).otherwise(mean(cross))
    b = F.when(green, blues).when(is_red, mean(corners)).otherwise(here)
    top = lambda cs: F.greatest(*cs)
    signal = GUARD * F.col("background")
    over_green = (of_row(top(sides["row"]), top(sides["column"])) > reds + signal) | (of_row(top(sides["column"]), top(sides["row"])) > here + signal)
    over_other = (top(cross) > mean(cross) + signal / OTHERS) | (top(corners) > mean(corners) + signal / OTHERS)
    out = p.select("frame", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"), F.when(green, over_green).otherwise(over_other).alias("over"))
    flat = (F.col("r") + F.col("g") + F.col("b")) / 3
    return out.select("frame", "x", "y", *[F.when(F.col("over"), flat).otherwise(F.col(c)).alias(c) for c in "rgb"])
