"""Operators on pixels: (frame, x, y, v) with whole-number levels, x and y counted from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.operators import robust


def histogram(px: DataFrame, levels: int = 65000) -> DataFrame:
    """Pixels of each level from 1 to levels - 1."""
    return px.filter((F.col("v") >= 1) & (F.col("v") < levels)).groupBy("frame", "v").agg(F.count("*").alias("n"))


def mode(px: DataFrame) -> DataFrame:
    """The most frequent level (of several, the lowest), how often it is found, and the number of levels."""
    counts = px.groupBy("frame", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("frame").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"), F.max("n").alias("pixels"), F.count("*").alias("levels"))


def background(px: DataFrame, levels: int = 65000) -> DataFrame:
    """The most frequent level up to the mean, or the mean where that is over 1.5 times as much. The mean's count begins
    at 1."""
    hist = histogram(px, levels)
    mean = hist.groupBy("frame").agg(F.floor(F.sum(F.col("v") * F.col("n")) / (F.sum("n") + 1) + 0.5).cast("long").alias("mean"))
    below = hist.join(mean, "frame").filter(F.col("v") <= F.col("mean"))
    top = below.groupBy("frame", "mean").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"))
    return top.select("frame", "mean", F.when(F.col("mean") > 1.5 * F.col("top"), F.col("mean")).otherwise(F.col("top")).alias("background"))


def star_levels(px: DataFrame, stars: int, levels: int = 65000) -> DataFrame:
    """The first levels from the top down at which 6 and 24 times `stars` pixels are as bright."""
    down = Window.partitionBy("frame").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = histogram(px, levels).withColumn("above", F.sum("n").over(down))
    return above.groupBy("frame").agg(F.max(F.when(F.col("above") >= 6 * stars, F.col("v"))).alias("level"), F.max(F.when(F.col("above") >= 24 * stars, F.col("v"))).alias("level2"))


def negative_noise(px: DataFrame, common: DataFrame) -> DataFrame:
    """common (frame, mode): pixels below it, and the sum of squares of their distances from it."""
    low = px.join(common.select("frame", "mode"), "frame").filter(F.col("v") < F.col("mode"))
    return low.groupBy("frame").agg(F.count("*").alias("n"), F.sum((F.col("mode") - F.col("v")) * (F.col("mode") - F.col("v"))).alias("squares"))


def hot_pixels(px: DataFrame, sigmas: int = 3) -> DataFrame:
    """Pixels further from the frame's mean than sigmas times its standard deviation."""
    s = px.groupBy("frame").agg(F.count("*").alias("k"), F.sum("v").alias("s"), F.sum(F.col("v").cast("decimal(38,0)") * F.col("v")).alias("q"))
    # (k v - s)^2 > sigmas^2 (k q - s^2) in whole numbers
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    off = dec("k") * dec("v") - dec("s")
    return px.join(s, "frame").groupBy("frame").agg(F.count("*").alias("n"), F.sum((off * off > sigmas * sigmas * (dec("k") * dec("q") - dec("s") * dec("s"))).cast("long")).alias("outside"))


def binned(px: DataFrame, size: int) -> DataFrame:
    """Sum and number of the pixels of each block."""
    return px.groupBy("frame", F.floor(F.col("x") / size).alias("x"), F.floor(F.col("y") / size).alias("y")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def cropped(px: DataFrame, width: int, height: int, share: float) -> DataFrame:
    """The middle part of a frame, its corner at 0."""
    w, h = int(width * share), int(height * share)
    x0, y0 = (width - w) // 2, (height - h) // 2
    return px.filter(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def flipped(px: DataFrame, width: int, height: int, x: bool, y: bool) -> DataFrame:
    return px.withColumns({"x": width - 1 - F.col("x") if x else F.col("x"), "y": height - 1 - F.col("y") if y else F.col("y")})


def mono(px: DataFrame) -> DataFrame:
    """Over the channels of (frame, ch, x, y, v)."""
    return px.groupBy("frame", "x", "y").agg(F.sum("v").alias("total"), F.count("*").alias("channels"))


def superpixel(px: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """One colour pixel for each cell of 2 x 2; the greens are averaged."""
    pick = lambda colour: F.avg(F.when(_colour(pattern) == colour, F.col("v")))
    return px.groupBy("frame", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(pick("R").alias("r"), pick("G").alias("g"), pick("B").alias("b"))


def _colour(pattern: str) -> Column:
    """The colour that a raw pixel has by its place in the cell."""
    at = F.col("y") % 2 * 2 + F.col("x") % 2
    return F.when(at == 0, pattern[0]).when(at == 1, pattern[1]).when(at == 2, pattern[2]).otherwise(pattern[3])


def plane(px: DataFrame, colour: str, pattern: str = "RGGB") -> DataFrame:
    """One colour of a raw frame at half size: sum and number of its pixels in each cell."""
    own = px.filter(_colour(pattern) == colour)
    return own.groupBy("frame", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def neighbours(px: DataFrame, reach: list[tuple[int, int]]) -> DataFrame:
    """Each pixel at all the places that see it: (frame, x, y, dx, dy, v)."""
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in reach])).alias("m")
    return px.select("frame", "x", "y", "v", moves).select("frame", (F.col("x") - F.col("m.dx")).alias("x"), (F.col("y") - F.col("m.dy")).alias("y"), F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy"), "v")


def bilinear(px: DataFrame, width: int, height: int, pattern: str = "RGGB") -> DataFrame:
    """Colour at every inner pixel: its own value, or the mean of the nearest of that colour. Sums and numbers."""
    near = neighbours(px, [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    seen = near.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")}).withColumn("colour", _colour(pattern)).withColumns({"x": F.col("x") - F.col("dx"), "y": F.col("y") - F.col("dy")})
    own = seen.filter(F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2)).withColumn("here", _colour(pattern))
    straight = F.abs("dx") + F.abs("dy")
    # a pixel's own colour is taken from it alone, green from the four beside it, others from all that have them
    used = own.filter((F.col("colour") != F.col("here")) & ((F.col("colour") != "G") | (straight == 1)) | (straight == 0))
    return used.groupBy("frame", "x", "y", "colour").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def check_pattern(px: DataFrame, width: int, height: int) -> DataFrame:
    """Sum and number of the pixels of each parity over the middle half, and the frame's pixels of it in all."""
    parity = (F.col("y") % 2 * 2 + F.col("x") % 2).alias("parity")
    mid = px.filter(F.col("x").between(width // 4, width * 3 // 4) & F.col("y").between(height // 4, height * 3 // 4))
    return mid.groupBy("frame", parity).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def normalised(px: DataFrame, width: int, height: int) -> DataFrame:
    """Raw pixels with each parity scaled to the brightest one."""
    means = check_pattern(px, width, height).select("frame", "parity", (F.col("total") / F.col("n")).alias("mean"))
    top = means.withColumn("scale", F.max("mean").over(Window.partitionBy("frame")) / F.col("mean")).select("frame", "parity", "scale")
    return px.withColumn("parity", F.col("y") % 2 * 2 + F.col("x") % 2).join(top, ["frame", "parity"]).select("frame", "x", "y", F.floor(F.col("v") * F.col("scale") + 0.5).alias("v"))


def without_dark(px: DataFrame, dark: DataFrame) -> DataFrame:
    """dark (x, y, d): subtracted where it has a pixel."""
    return px.join(dark, ["x", "y"], "left").select("frame", "x", "y", (F.col("v") - F.coalesce("d", F.lit(0))).alias("v"))


def flattened(px: DataFrame, flat: DataFrame, norm: DataFrame) -> DataFrame:
    """flat (x, y, f), norm (one row: norm): scaled by norm / (f + 0.001), at most by 4."""
    factor = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("norm") / (F.col("f") + 0.001)))
    return px.join(flat, ["x", "y"]).crossJoin(F.broadcast(norm)).select("frame", "x", "y", (F.col("v") * factor).alias("v"))


def box_blur(px: DataFrame, width: int, height: int, reach: range = range(-1, 2)) -> DataFrame:
    """Sum and number of the pixels other than 0 in the box around each place."""
    near = neighbours(px.filter("v <> 0"), [(dx, dy) for dx in reach for dy in reach])
    return near.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).groupBy("frame", "x", "y").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def sharpness(px: DataFrame) -> DataFrame:
    """Sums over blocks of 4 x 4: of the squared range of their quarters' sums, and of greatest plus least."""
    quarter = px.groupBy("frame", F.floor(F.col("x") / 4).alias("bx"), F.floor(F.col("y") / 4).alias("by"), F.floor(F.col("x") / 2).alias("qx"), F.floor(F.col("y") / 2).alias("qy")).agg(F.sum("v").alias("q"))
    block = quarter.groupBy("frame", "bx", "by").agg(F.max("q").alias("high"), F.min("q").alias("low"))
    d = F.col("high") - F.col("low")
    return block.groupBy("frame").agg(F.sum(d * d).alias("contrast"), F.sum(F.col("high") + F.col("low")).alias("light"))


def holes_filled(cells: DataFrame, width: int, height: int) -> DataFrame:
    """cells (frame, x, y, v): every place of each frame; an empty one takes its left neighbour's value, else that below
    (values as they came: one that was filled itself isn't taken)."""
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width * height - 1).cast("long"))).alias("at")
    grid = cells.select("frame").distinct().select("frame", places).select("frame", (F.col("at") % width).alias("x"), F.floor(F.col("at") / width).alias("y"))
    full = grid.join(cells, ["frame", "x", "y"], "left")
    full = full.withColumn("left", F.lag("v").over(Window.partitionBy("frame", "y").orderBy("x")))
    full = full.withColumn("below", F.lag("v").over(Window.partitionBy("frame", "x").orderBy("y")))
    return full.select("frame", "x", "y", F.coalesce("v", "left", "below").alias("v"), F.col("v").isNull().alias("filled"))


def box_median(px: DataFrame, size: int) -> DataFrame:
    """The upper median of the levels other than 0 in the box (odd; an even size grows by one) about each pixel of
    (frame, x, y, v); 0 where there are none."""
    reach = F.sequence(F.lit(-(size // 2)), F.lit(size // 2))
    near = px.filter("v <> 0").select("frame", "x", "y", "v", F.explode(reach).alias("i")).select("frame", (F.col("x") + F.col("i")).alias("x"), "y", "v", F.explode(reach).alias("j"))
    near = near.select("frame", "x", (F.col("y") + F.col("j")).alias("y"), "v").join(px.select("frame", "x", "y"), ["frame", "x", "y"], "left_semi")
    at = px.select("frame", "x", "y")
    return at.join(robust.upper_median(near, ["frame", "x", "y"], "v", "background"), ["frame", "x", "y"], "left").na.fill(0, ["background"])


def is_mosaic(px: DataFrame, width: int, height: int, steps: int = 100, least: float = 100.0) -> DataFrame:
    """frame, mosaic: whether the medians of the four parity places along the middle two rows are further apart than
    `least`. Every even step-th place counts, of at most `steps`."""
    step = max(2, width // steps // 2 * 2)
    middle = height // 2
    rows = px.filter(F.col("y").between(middle, middle + 1) & (F.col("x") % step < 2) & (F.col("x") < step * steps))
    medians = robust.smedian(rows.withColumn("place", (F.col("y") - middle) * 2 + F.col("x") % step), ["frame", "place"], "v")
    return medians.groupBy("frame").agg((F.max("median") - F.min("median") > least).alias("mosaic"))


def gradient_modes(px: DataFrame, places: list[tuple[int, int]], half: int) -> DataFrame:
    """The most frequent level of boxes around some places."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("box"), F.lit(x).alias("cx"), F.lit(y).alias("cy")) for i, (x, y) in enumerate(places)])).alias("b")
    inside = px.select("*", at).filter((F.abs(F.col("x") - F.col("b.cx")) <= half) & (F.abs(F.col("y") - F.col("b.cy")) <= half))
    counts = inside.groupBy("frame", F.col("b.box").alias("box"), "v").agg(F.count("*").alias("n"))
    return counts.groupBy("frame", "box").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))


def display_range(px: DataFrame, levels: int = 65000) -> DataFrame:
    """black: the first level with a tenth of the peak's pixels; white: the level above which 1 in 1000 pixels lie."""
    hist = histogram(px, levels)
    down = Window.partitionBy("frame").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("frame")
    h = hist.select("frame", "v", "n", F.max("n").over(whole).alias("peak"), F.sum("n").over(whole).alias("all"), F.sum("n").over(down).alias("above"))
    return h.groupBy("frame").agg(F.min(F.when(F.col("n") * 10 >= F.col("peak"), F.col("v"))).alias("black"), F.max(F.when(F.col("above") * 1000 > F.col("all"), F.col("v"))).alias("white"))


def saturated_cells_kept(px: DataFrame, limit: int) -> DataFrame:
    """Cells of 2 x 2 with a pixel over the limit take the last cell of their row that has none."""
    cell = px.groupBy("frame", F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")).agg(F.max("v").alias("top"), F.sum("v").alias("total"))
    last = F.last(F.when(F.col("top") <= limit, F.col("total")), ignorenulls=True).over(Window.partitionBy("frame", "cy").orderBy("cx"))
    return cell.select("frame", "cy", "cx", F.coalesce(last, F.col("total")).alias("total"), (F.col("top") > limit).alias("saturated"))


def gaussian(px: DataFrame, radius: float) -> DataFrame:
    """Gaussian blur of pixels (frame, x, y, v), clamped at the frame's edges (its largest x and y): along x, then along y.
    Each pixel is shared out to the places that it reaches and summed there, so frames of any size are no single task's; places
    that no pixel reaches are left out. Sums begin before the shuffle."""
    from skyframe.kernels.image import gaussian_kernel

    k = gaussian_kernel(radius)
    h = len(k) // 2
    weights = F.array(*[F.lit(float(c)) for c in k])
    below = F.array(*[F.lit(float(c)) for c in [0.0, *k.cumsum()]])  # sums of the first weights
    ends = px.groupBy("frame").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    p = px.join(ends, "frame").select("frame", "x", "y", F.col("v").cast("double").alias("v"), "mx", "my")

    def along(p: DataFrame, c: str, last: str) -> DataFrame:
        at, end = F.col(c), F.col(last)
        to = p.withColumn("to", F.explode(F.sequence(F.greatest(at - h, F.lit(0)), F.least(at + h, end))))
        step = (at - F.col("to") + h).cast("int")
        # what lies beyond an edge has the edge's value
        low, high = F.get(below, step + 1), 1.0 - F.get(below, step)
        share = F.when(end == 0, 1.0).when(at == 0, low).when(at == end, high).otherwise(F.get(weights, step))
        other = "y" if c == "x" else "x"
        return to.groupBy("frame", other, F.col("to").alias(c), "mx", "my").agg(F.sum(F.col("v") * share).alias("v"))

    return along(along(p, "x", "mx"), "y", "my").select("frame", "x", "y", "v")
