"""A mosaic of overlapping frames: levels settled along the frames' order, overlaps feathered by the distance from the
frames' borders.

What a walk over the frames would do is taken apart into what Spark can do at once. At each place the frames there, in
order, are blended: the value so far has the weight of the last frame's distance from its border, a new one that of its own. So a
place is a weighted sum of its frames' values, with weights from the distances alone, and the level of a frame (the
mean difference, over all places that it shares with earlier ones, between what they make there and its own value) is
a sum over the levels of earlier frames. One aggregate gives the factors of these sums for each pair of overlapping frames; the
levels follow from these, a number for each frame; a last pass blends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.operators.scratch import stored

FEW_PAIRS = 200_000  # frames and pairs of overlapping frames that the driver settles
BLOCK = 2_000  # frames, next to one another in order, that a task settles as far as earlier blocks allow


def placed(px: DataFrame, frames: DataFrame) -> DataFrame:
    """px (frame, x, y from 0, v), frames (frame, order, width, height, dx, dy and, if wanted, background): pixels at their
    places in the mosaic, with their distance from the frame's border (from 1). Border pixels (1 at the left and bottom, 2
    at the right and top) and values of 0 or less are no part of it. With a background, frames are levelled at 1000."""
    f = frames if "background" in frames.columns else frames.withColumn("background", F.lit(1000))
    p = px.join(f, "frame").filter((F.col("x") >= 1) & (F.col("y") >= 1) & (F.col("x") <= F.col("width") - 3) & (F.col("y") <= F.col("height") - 3) & (F.col("v") > 0.0001))
    near = 1 + F.least(F.col("x"), F.col("y"), F.col("width") - 1 - F.col("x"), F.col("height") - 1 - F.col("y"))
    return p.select("order", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("v") + 1000 - F.col("background")).cast("double").alias("v"), near.cast("double").alias("near"))


def stacked(pixels: DataFrame) -> DataFrame:
    """(x, y, own): the frames at each place in order, each with its value, distance, and the weights of the frames up to
    it, itself included (`blend`)."""
    own = pixels.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("order", "v", "near"))).alias("own"))

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        share = p["near"] / (p["near"] + last["near"])
        blend = F.when(F.size(acc) == 0, F.array(F.lit(1.0))).otherwise(F.concat(F.transform(last["blend"], lambda b: b * (1 - share)), F.array(share)))
        return F.concat(acc, F.array(F.struct(p["order"].alias("order"), p["v"].alias("v"), p["near"].alias("near"), blend.alias("blend"))))

    none = F.expr("cast(array() as array<struct<order:bigint,v:double,near:double,blend:array<double>>>)")
    cast = F.transform("own", lambda p: F.struct(p["order"].cast("long").alias("order"), p["v"].alias("v"), p["near"].alias("near")))
    first = F.transform(F.slice(cast, 1, 1), lambda p: F.struct(p["order"].alias("order"), p["v"].alias("v"), p["near"].alias("near"), F.array(F.lit(1.0)).alias("blend")))
    rest = F.slice(cast, 2, 1 << 20)
    return own.select("x", "y", F.when(F.size("own") > 0, F.aggregate(rest, first, add)).otherwise(none).alias("own"))


def _blended(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b)


def level_factors(places: DataFrame, limit: float) -> DataFrame:
    """(frame, other, n, difference, factor): for a frame and itself, the places shared with earlier frames and the sum of
    the differences there; for a frame and an earlier one, the sum of that one's weights at these places. Places with a
    difference of `limit` or more don't count."""
    before = F.transform(F.sequence(F.lit(1), F.size("own") - 1), lambda i: F.struct(F.get("own", i).alias("p"), F.slice(F.col("own"), 1, i).alias("earlier"), F.get("own", i - 1)["blend"].alias("blend")))
    rows = places.filter("size(own) > 1").select(F.explode(before).alias("b")).select("b.p", "b.earlier", "b.blend")
    rows = rows.withColumn("difference", _blended(F.transform("earlier", lambda e: e["v"]), F.col("blend")) - F.col("p.v")).filter(F.abs("difference") < limit)
    own = F.struct(F.col("p.order").alias("other"), F.lit(1).cast("long").alias("n"), F.col("difference"), F.lit(0.0).alias("factor"))
    others = F.zip_with("earlier", "blend", lambda e, w: F.struct(e["order"].alias("other"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("difference"), w.alias("factor")))
    each = rows.select(F.col("p.order").alias("frame"), F.explode(F.concat(F.array(own), others)).alias("e"))
    return each.groupBy("frame", "e.other").agg(F.sum("e.n").alias("n"), F.sum("e.difference").alias("difference"), F.sum("e.factor").alias("factor"))


def levels(frames: DataFrame, factors: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """(frame, level): what is added to each frame; 0 for one that shares no place with earlier ones. Up to `few` pairs of
    frames are settled in one walk over them; more, by blocks of frames, which leave only those open that other blocks
    look back to; where blocks don't help, a round settles all frames whose earlier neighbours are settled."""
    own = factors.filter("frame = other").select("frame", "n", "difference")
    needs = stored(factors.filter("frame <> other").join(own.select("frame", F.col("n").alias("shared")), "frame").select("frame", "other", (F.col("factor") / F.col("shared")).alias("factor")), "needs")
    base = stored(frames.select(F.col("order").cast("long").alias("frame")).join(own, "frame", "left").select("frame", F.coalesce(F.col("difference") / F.col("n"), F.lit(0.0)).alias("base")), "base")
    if needs.count() <= few and base.count() <= few:
        return _walked(base, needs)
    return _by_blocks(base, needs, few)


def _by_blocks(base: DataFrame, needs: DataFrame, few: int, block: int | None = None) -> DataFrame:
    """The levels by blocks in order: each frame's level becomes a sum over frames of earlier blocks, and only those that
    stand in such sums are settled, the same way, before the rest."""
    block = block or BLOCK
    k = int(base.count() / block) + 1
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(base.approxQuantile("frame", [i / k for i in range(1, k)], 0.1 / k)))]) if k > 1 else F.expr("cast(array() as array<bigint>)")
    in_block = lambda c: F.size(F.filter(cuts, lambda cut: cut <= F.col(c)))
    own = base.withColumn("block", in_block("frame"))
    links = needs.withColumns({"block": in_block("frame"), "out": in_block("other") < in_block("frame")})

    def run(frames: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        inputs = np.unique(pairs["other"][pairs["out"]].to_numpy(np.int64))
        at = {int(o): i for i, o in enumerate(inputs)}
        earlier: dict[int, list] = {}
        for f, o, c in sorted(zip(pairs["frame"], pairs["other"], pairs["factor"], strict=True)):
            earlier.setdefault(f, []).append((o, c))
        level: dict[int, tuple[float, np.ndarray]] = {}
        rows = []
        for f, b in sorted(zip(frames["frame"], frames["base"], strict=True)):
            sum_, weights = float(b), np.zeros(len(inputs))
            for o, c in earlier.get(f, []):
                if o in level:
                    sum_, weights = sum_ + c * level[o][0], weights + c * level[o][1]
                else:
                    weights[at[o]] += c
            level[f] = sum_, weights
            used = np.flatnonzero(weights)
            rows.append((f, sum_, inputs[used].tolist(), weights[used].tolist()))
        return pd.DataFrame(rows, columns=["frame", "base", "others", "factors"])

    pairs = links.select("block", "frame", "other", "factor", "out").groupBy("block")
    sums = stored(own.groupBy("block").cogroup(pairs).applyInPandas(run, "frame long, base double, others array<long>, factors array<double>"), "sums")
    terms = sums.select("frame", F.explode(F.arrays_zip("others", "factors")).alias("t")).select("frame", F.col("t.others").alias("other"), F.col("t.factors").alias("factor"))
    asked = stored(terms.select(F.col("other").alias("frame")).distinct(), "asked")
    base2, needs2 = sums.select("frame", "base").join(asked, "frame"), stored(terms.join(asked, "frame", "left_semi"), "needs")
    base2 = stored(base2, "base")
    left = base2.count()
    if left <= few and needs2.count() <= few:
        settled = _walked(base2, needs2)
    elif 2 * left <= base.count():
        settled = _by_blocks(base2, needs2, few, block)
    else:
        settled = _by_rounds(base2, needs2)
    # a frame's terms are summed to its base; without any, the base is its level
    added = terms.join(settled.withColumnRenamed("frame", "other"), "other").groupBy("frame").agg(F.sum(F.col("factor") * F.col("level")).alias("sum"))
    return stored(sums.select("frame", "base").join(added, "frame", "left").select("frame", (F.col("base") + F.coalesce("sum", F.lit(0.0))).alias("level")), "levels")


def _by_rounds(base: DataFrame, needs: DataFrame) -> DataFrame:
    done = stored(base.join(needs.select("frame").distinct(), "frame", "left_anti").select("frame", F.col("base").alias("level")), "levels")
    while True:
        open_ = base.join(done, "frame", "left_anti")
        sums = needs.join(open_.select("frame"), "frame", "left_semi").join(done.withColumnRenamed("frame", "other"), "other", "left").groupBy("frame").agg(F.sum(F.col("factor") * F.col("level")).alias("sum"), F.count_if(F.col("level").isNull()).alias("missing"))
        new = stored(open_.join(sums.filter("missing = 0"), "frame").select("frame", (F.col("base") + F.col("sum")).alias("level")), "levels")
        if new.isEmpty():
            return done
        done = done.union(new)


def _walked(base: DataFrame, needs: DataFrame) -> DataFrame:
    earlier: dict[int, list] = {}
    for r in needs.collect():
        earlier.setdefault(r["frame"], []).append((r["other"], r["factor"]))
    level: dict[int, float] = {}
    for r in sorted(base.collect()):
        level[r["frame"]] = r["base"] + sum(f * level[o] for o, f in sorted(earlier.get(r["frame"], [])))
    return base.sparkSession.createDataFrame(list(level.items()), "frame long, level double")


def blended(places: DataFrame, levels_: DataFrame) -> DataFrame:
    """(x, y, v, frames): places with their frames' levels added and blended."""
    at = places.select("x", "y", F.posexplode("own").alias("k", "p"), F.element_at("own", -1)["blend"].alias("blend"))
    at = at.select("x", "y", F.col("p.order").alias("frame"), (F.col("p.v")).alias("v"), F.get("blend", F.col("k")).alias("w")).join(levels_, "frame")
    return at.groupBy("x", "y").agg(F.sum((F.col("v") + F.col("level")) * F.col("w")).alias("v"), F.count("*").alias("frames"))


def gaps_filled(image: DataFrame) -> DataFrame:
    """An empty place inside the image's box gets the value to its left or else the one below (from the left and the bottom,
    one step); others stay empty."""
    box = image.agg(F.max("x").alias("x1"), F.max("y").alias("y1"))
    right = image.select((F.col("x") + 1).alias("x"), "y", F.lit(1).alias("from"), "v", F.lit(0).cast("long").alias("frames"))
    up = image.select("x", (F.col("y") + 1).alias("y"), F.lit(2).alias("from"), "v", F.lit(0).cast("long").alias("frames"))
    all_ = image.select("x", "y", F.lit(0).alias("from"), "v", "frames").union(right).union(up)
    best = all_.groupBy("x", "y").agg(F.min_by(F.struct("v", "frames"), "from").alias("b")).select("x", "y", "b.v", "b.frames")
    return best.crossJoin(F.broadcast(box)).filter("x <= x1 and y <= y1").drop("x1", "y1")  # one row


def mosaic(px: DataFrame, frames: DataFrame, limit: float) -> DataFrame:
    """(x, y, v, frames); see `placed` for what comes in. Frames are taken by `order` (whole numbers)."""
    places = stored(stacked(placed(px, frames)), "places")
    return gaps_filled(blended(places, levels(frames, level_factors(places, limit))))


def corner_background(px: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, background): the mean of the middle two of the four corners' most frequent levels; a corner is a fifth of the
    frame wide and high."""
    f = px.join(frames.select("frame", "width", "height"), "frame")
    left, low = F.col("x") <= F.round(0.2 * F.col("width")), F.col("y") <= F.round(0.2 * F.col("height"))
    right, high = F.col("x") >= F.round(0.8 * F.col("width")), F.col("y") >= F.round(0.8 * F.col("height"))
    corner = F.when(left & low, 0).when(left & high, 1).when(right & low, 2).when(right & high, 3)
    counts = f.withColumn("corner", corner).filter("corner is not null and v >= 1 and v < 32000").groupBy("frame", "corner", F.round("v").cast("long").alias("v")).agg(F.count("*").alias("k"))
    modes = counts.groupBy("frame", "corner").agg(F.max_by("v", F.struct("k", -F.col("v"))).alias("v"))
    w = Window.partitionBy("frame")
    ranked = modes.withColumns({"r": F.row_number().over(w.orderBy("v", "corner")), "n": F.count("*").over(w)})
    middle = F.col("r").between(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    return ranked.filter(middle).groupBy("frame").agg(F.avg("v").alias("background"))
