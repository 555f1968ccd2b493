"""Plate solving: stars of frames against a catalogue, by quads, to an affine map and a WCS. `solve_all` takes many frames and
all their start positions in one go; `solve` is that for one frame, as a dict."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions import sky
from skyframe.operators import field, fit, match
from skyframe.operators.scratch import stored

RATIOS = ["r2", "r3", "r4", "r5", "r6"]


def spiral(rings: int) -> list[tuple[int, int]]:
    """Centres of a square spiral, nearest first."""
    return sorted(((i, j) for i in range(-rings, rings + 1) for j in range(-rings, rings + 1)), key=lambda p: (max(abs(p[0]), abs(p[1])), math.atan2(p[1], p[0])))


ARC = 648000 / math.pi  # seconds of arc
OVERSIZE = 1.5  # the catalogue's square against the field, or more where a frame's diagonal is longer
STEP = 0.5  # of a field from one start position to the next
TOGETHER = 256  # frames that begin alike and meet one copy of their positions' quads
CELL = 8  # tolerances that a cell of ratios is wide
OUTSIDE, LEAST_OFF = 5, 1.0  # of the median distance from the map, and pixels, beyond which a pair is a false one


def starts(frames: DataFrame, rings: int) -> DataFrame:
    """frames (frame, ra0, dec0, field) -> a row for each start position: pos 0 is the frame's own, then a square spiral."""
    moves = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i, j in spiral(rings)])
    dec = F.greatest(F.least(F.col("dec0") + F.col("m.j") * F.col("field") * STEP, F.lit(math.pi / 2)), F.lit(-math.pi / 2))
    at = frames.select("*", F.posexplode(moves).alias("pos", "m"))
    return at.withColumn("dec", dec).withColumn("ra", F.pmod(F.col("ra0") + F.col("m.i") * F.col("field") * STEP / F.greatest(F.cos("dec"), F.lit(0.01)), F.lit(2 * math.pi))).drop("m")


def solve_all(frames: DataFrame, stars: DataFrame, catalog: DataFrame, rings: int = 1, tolerance: float = 0.007, least: int = 3) -> DataFrame:
    """`searched`, then once more from each frame's own solution: flattened at the frame's centre, where the map from pixels
    is affine. Frames whose second pass fails are not solved. Takes and gives what `searched` does; pos is the first one's."""
    frames = stored(_counted(frames, stars), "frames")
    own = stored(_own_quads(frames, stars), "quads")
    first = stored(searched(frames, stars, catalog, rings, tolerance, least, own), "solved")
    there = frames.drop("ra0", "dec0").join(first.select("frame", "pos", F.radians("crval1").alias("ra0"), F.radians("crval2").alias("dec0")), "frame")
    return searched(there.drop("pos"), stars, catalog, 0, tolerance, least, own).drop("pos").join(first.select("frame", "pos"), "frame")


def _counted(frames: DataFrame, stars: DataFrame) -> DataFrame:
    """With n, the number of their stars; frames without a star go."""
    return frames if "n" in frames.columns else frames.join(stars.groupBy("frame").agg(F.count("*").alias("n")), "frame")


def _cell(frames: DataFrame) -> float:
    """Pixels to a star's neighbours, and some; frames with their stars' number n."""
    size = frames.agg(F.max(F.greatest("width", "height")).alias("side"), F.avg("n").alias("n")).first()
    return 1.5 * (size["side"] or 1) / max(1.0, math.sqrt(size["n"] or 0))


def _own_quads(frames: DataFrame, stars: DataFrame) -> DataFrame:
    return match.quads_by(stars, _cell(_counted(frames, stars)), ("frame",))


def searched(frames: DataFrame, stars: DataFrame, catalog: DataFrame, rings: int, tolerance: float, least: int, own: DataFrame | None = None) -> DataFrame:
    """frames (frame, ra0, dec0: where to begin, field: the frame's height, all radians; width, height in pixels), stars
    (frame, id, x, y in pixels from 1), catalog (id, ra, dec, mag), own (the frames' quads, if they are known already) -> for
    each frame that is solved: pos, quads, crval1, crval2 (degrees), crpix1, crpix2, cd1_1 .. cd2_2, and scale (seconds of arc a pixel).

    Start positions are rows, not a loop: the catalogue's stars about each are joined on sky cells and flattened there at the
    frame's nominal scale. The square holds the frame however it is turned, and gives as many stars for its area as the frame
    has: with fewer, what is faint in the frame has no partner and its quads are others. Frames that begin at one place with one
    field and as many stars have the same positions, whose quads are worked out once for all of them. Quads of frame and position
    meet on where the frame begins and cells of their ratios; of each frame the position with most quads of one scale wins."""
    frames = stored(_counted(frames, stars), "frames")
    alike = ["ra0", "dec0", "field", "width", "height", "n"]
    begun = stored(frames.groupBy(*alike).agg(F.min("frame").alias("start"), F.count("*").alias("k")).withColumn("copies", F.ceil(F.col("k") / TOGETHER).cast("int")), "begun")
    of = frames.join(begun, alike).select("frame", "start", F.pmod(F.xxhash64("frame"), F.col("copies")).cast("int").alias("copy"))
    places = stored(starts(begun.drop("k").withColumnRenamed("start", "frame"), rings).withColumnRenamed("frame", "start").withColumn("frame", F.concat_ws(":", "start", "pos")), "starts")
    if places.isEmpty():
        return stars.sparkSession.createDataFrame([], "frame long, pos int, quads long, crval1 double, crval2 double, crpix1 double, crpix2 double, cd1_1 double, cd1_2 double, cd2_1 double, cd2_2 double, scale double")
    square = places.select("frame", "start", "pos", "n", "width", "height", "field", F.col("ra").alias("ra0"), F.col("dec").alias("dec0"))
    wider = F.greatest(F.lit(OVERSIZE), F.sqrt(F.col("width") * F.col("width") / (F.col("height") * F.col("height")) + 1))
    wanted = F.floor(F.col("n") * F.col("height") / F.col("width") * wider * wider + 0.5)
    square = square.withColumn("nominal", F.col("field") / F.col("height")).withColumns({"field": F.col("field") * wider, "wanted": wanted}).drop("width")
    bright = field.brightest_in_square(square, catalog, ["start", "pos"])
    xi, eta = sky.to_standard(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0"))
    flat = stored(bright.select("start", "pos", "id", (xi / F.col("nominal")).alias("x"), (eta / F.col("nominal")).alias("y")), "flat")
    own = stored(_own_quads(frames, stars), "quads") if own is None else own
    theirs = stored(match.quads_by(flat, _cell(frames), ("start", "pos")), "quads")
    pairs = _agreeing(own.join(of, "frame"), theirs.join(begun.select("start", "copies"), "start"), tolerance)
    each = Window.partitionBy("frame", "pos")
    pairs = pairs.withColumns({"nth": F.row_number().over(each.orderBy("ratio")), "n": F.count("*").over(each)})
    pairs = pairs.withColumn("med", F.max(F.when(F.col("nth") == F.floor(F.col("n") / 2) + 1, F.col("ratio"))).over(each))
    kept = _consistent(stored(pairs.filter(F.abs(F.col("ratio") - F.col("med")) <= tolerance * F.col("med")).drop("ratio", "nth", "n", "med"), "pairs"))
    fits = fit.affine(kept, ["frame", "pos"]).join(kept.groupBy("frame", "pos").agg(F.count("*").alias("quads")), ["frame", "pos"])
    along, up = F.sqrt(F.col("a") * F.col("a") + F.col("d") * F.col("d")), F.sqrt(F.col("b") * F.col("b") + F.col("e") * F.col("e"))
    good = fits.filter((F.col("quads") >= least) & F.col("a").isNotNull() & (along > 0.9 * up) & (along < 1.1 * up) & (up > 0))
    best = good.withColumn("place", F.row_number().over(Window.partitionBy("frame").orderBy(F.col("quads").desc(), "pos"))).filter("place = 1")
    at = places.select("start", "pos", "ra", "dec", "width", "height", (F.col("field") / F.col("height")).alias("nominal"))
    return _solution(best.join(of.select("frame", "start"), "frame").join(at, ["start", "pos"]))


def _agreeing(own: DataFrame, theirs: DataFrame, tolerance: float) -> DataFrame:
    """Quads of frames (start, copy) and of the positions of a start (copies) whose ratios all agree: x, y in the frame, u, v
    about the position. A frame's quad goes to every cell that its tolerance reaches into, one and a half on the average."""
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda c: F.floor(c / (CELL * tolerance))
    key = ["start", "copy", "k0", "k1"]
    left = own.select("frame", "start", "copy", F.col("d1").alias("da"), F.col("xc").alias("x"), F.col("yc").alias("y"), *[F.col(r).alias(f"a_{r}") for r in RATIOS])
    reach = 1.000001 * tolerance  # what rounding may take away
    for k, r in (("k0", "a_r2"), ("k1", "a_r3")):
        left = left.withColumn(k, F.explode(F.sequence(cell(F.col(r) - reach), cell(F.col(r) + reach))))
    right = theirs.select("start", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "pos", F.col("d1").alias("db"), F.col("xc").alias("u"), F.col("yc").alias("v"), *[F.col(r).alias(f"b_{r}") for r in RATIOS], cell(F.col("r2")).alias("k0"), cell(F.col("r3")).alias("k1"))
    near = F.lit(True)
    for r in RATIOS:
        near = near & (F.abs(F.col(f"a_{r}") - F.col(f"b_{r}")) <= tolerance)
    met = left.repartition(n, *key).hint("merge").join(right.repartition(n, *key), key)
    return met.filter(near).select("frame", "pos", "x", "y", "u", "v", (F.col("da") / F.col("db")).alias("ratio"))


def _consistent(pairs: DataFrame) -> DataFrame:
    """pairs (frame, pos, x, y, u, v) without those far off the map that all of a frame's position give: quads that are alike by
    chance, or share three stars, may agree in all ratios and stand elsewhere, and one of them is enough to spoil a map."""
    each = Window.partitionBy("frame", "pos")
    off = lambda p, q, r, to: F.col(p) * F.col("x") + F.col(q) * F.col("y") + F.col(r) - F.col(to)
    far = pairs.join(fit.affine(pairs, ["frame", "pos"]), ["frame", "pos"]).withColumn("off", F.coalesce(F.hypot(off("a", "b", "c", "u"), off("d", "e", "f", "v")), F.lit(0.0)))
    far = far.withColumns({"nth": F.row_number().over(each.orderBy("off")), "k": F.count("*").over(each)})
    far = far.withColumn("med", F.max(F.when(F.col("nth") == F.floor(F.col("k") / 2) + 1, F.col("off"))).over(each))
    return stored(far.filter(F.col("off") <= F.greatest(F.lit(LEAST_OFF), OUTSIDE * F.col("med"))).select(*pairs.columns), "consistent")


def _solution(best: DataFrame) -> DataFrame:
    """The affine map (pixels to flat coordinates at the nominal scale about ra, dec) as a WCS at the frame's centre."""
    cx, cy = (F.col("width") + 1) / 2, (F.col("height") + 1) / 2
    s = best.select("*", cx.alias("crpix1"), cy.alias("crpix2"), *[((F.col(p) * cx + F.col(q) * cy + F.col(c)) * F.col("nominal")).alias(n) for n, (p, q, c) in (("sx", "abc"), ("sy", "def"))])
    ra, dec = sky.from_standard(F.col("sx"), F.col("sy"), F.col("ra"), F.col("dec"))
    s = s.select("*", ra.alias("cra"), dec.alias("cdec"))
    # north at the new centre against the old
    turn = F.atan2(F.sin(F.col("cra") - F.col("ra")) * F.sin("dec"), F.cos(F.col("cra") - F.col("ra")))
    s = s.select("*", F.cos(turn).alias("along"), F.sin(turn).alias("aside"))
    unit = F.col("nominal") * (180 / math.pi)
    across = lambda p, q: ((F.col("along") * F.col(p) - F.col("aside") * F.col(q)) * unit)
    up = lambda p, q: ((F.col("aside") * F.col(p) + F.col("along") * F.col(q)) * unit)
    cd = {"cd1_1": across("a", "d"), "cd1_2": across("b", "e"), "cd2_1": up("a", "d"), "cd2_2": up("b", "e")}
    scale = F.sqrt(F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("d"))) * F.col("nominal") * ARC
    return s.select("frame", "pos", "quads", F.degrees("cra").alias("crval1"), F.degrees("cdec").alias("crval2"), "crpix1", "crpix2", *[v.alias(k) for k, v in cd.items()], scale.alias("scale"))


def solve(stars: DataFrame, catalog: DataFrame, ra0: float, dec0: float, field: float, width: int, height: int, tolerance: float = 0.007, rings: int = 1) -> dict | None:
    """One frame's stars (id, x, y in pixels from 1) against catalog (id, ra, dec, mag in radians): CRVAL, CRPIX and the CD
    matrix (degrees), or None."""
    frame = stars.sparkSession.createDataFrame([(0, ra0, dec0, field, width, height)], "frame long, ra0 double, dec0 double, field double, width int, height int")
    r = solve_all(frame, stars.select(F.lit(0).cast("long").alias("frame"), "id", "x", "y"), catalog, rings, tolerance).first()
    return None if r is None else {k.upper(): r[k] for k in ("crpix1", "crpix2", "crval1", "crval2", "cd1_1", "cd1_2", "cd2_1", "cd2_2", "quads")}
