"""Stacking: frames of pixels (frame, x, y, v) to one image. Whole-number sums, so that the order of rows is of no matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def average(px: DataFrame, weight: Column | None = None) -> DataFrame:
    """total (of weighted values) and weights of each place; their quotient is the image."""
    w = F.lit(1).cast("long") if weight is None else weight
    return px.groupBy("x", "y").agg(F.sum(F.col("v") * w).alias("total"), F.sum(w).alias("weights"))


def mapped(px: DataFrame, transforms: DataFrame) -> DataFrame:
    """transforms (frame, a, b, c, d, e, f): pixels moved to the reference grid at (ax + by + c, dx + ey + f), rounded half
    away from zero."""
    rounded = lambda z: (F.signum(z) * F.floor(F.abs(z) + 0.5)).cast("long")
    to = lambda p, q, r: rounded(F.col(p) * F.col("x") + F.col(q) * F.col("y") + F.col(r))
    return px.join(F.broadcast(transforms), "frame").select("frame", to("a", "b", "c").alias("x"), to("d", "e", "f").alias("y"), "v")


def sigma_clipped(px: DataFrame, k: int = 2) -> DataFrame:
    """Values with (v - mean)^2 < k^2 * variance, where the variance is 1 more than the mean square distance. With n
    values of sum s and squares q: (n v - s)^2 < k^2 (n^2 + n q - s^2), in whole numbers."""
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    sums = px.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(dec("v") * dec("v")).alias("q"))
    off = dec("n") * dec("v") - dec("s")
    kept = off * off < k * k * (dec("n") * dec("n") + dec("n") * dec("q") - dec("s") * dec("s"))
    return px.join(sums, ["x", "y"]).groupBy("x", "y").agg(F.sum(F.when(kept, F.col("v")).otherwise(0)).alias("total"), F.sum(kept.cast("long")).alias("used"))


def comet(px: DataFrame, away: int) -> DataFrame:
    """Each place's brightest frame (of several, the first), and the sum over the frames further than `away` from it."""
    top = px.groupBy("x", "y").agg(F.max_by("frame", F.struct(F.col("v"), -F.col("frame"))).alias("peak"))
    far = F.abs(F.col("frame") - F.col("peak")) > away
    return px.join(top, ["x", "y"]).groupBy("x", "y", "peak").agg(F.sum(F.when(far, F.col("v")).otherwise(0)).alias("total"), F.sum(far.cast("long")).alias("used"))


def lrgb(px: DataFrame, channels: dict[str, int]) -> DataFrame:
    """One frame for each channel (l, r, g, b): places that all have, with luminance shared out by colour in millionths."""
    pick = lambda name: F.max(F.when(F.col("frame") == channels[name], F.col("v"))).alias(name)
    wide = px.filter(F.col("frame").isin(*channels.values())).groupBy("x", "y").agg(*[pick(c) for c in "lrgb"]).dropna()
    share = lambda c: F.expr(f"{c} * l * 3 div (r + g + b)").alias(c)
    return wide.filter("r + g + b > 0").select("x", "y", share("r"), share("g"), share("b"))


def mosaic_bounds(px: DataFrame, transforms: DataFrame) -> DataFrame:
    """The box that holds all mapped frames, and how many pixels fall in it."""
    return mapped(px, transforms).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count("*").alias("pixels"))


def overlap_offsets(px: DataFrame, transforms: DataFrame, limit: int) -> DataFrame:
    """For each frame and the next: the number of shared places, and the sum of their differences, each capped."""
    a = mapped(px, transforms).groupBy("frame", "x", "y").agg(F.max("v").alias("v"))
    b = a.select((F.col("frame") - 1).alias("frame"), "x", "y", F.col("v").alias("w"))
    d = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("w") - F.col("v")))
    return a.join(b, ["frame", "x", "y"]).groupBy("frame").agg(F.count("*").alias("shared"), F.sum(d).alias("offset"))


def totals(frames: DataFrame) -> DataFrame:
    """frames (exposure, temperature, jd): what the stack's header tells."""
    return frames.agg(F.count("*").alias("frames"), F.sum("exposure").alias("exposure"), F.sum("temperature").alias("temperature"), F.min("jd").alias("first"), F.max("jd").alias("last"))


def frame_weights(frames: DataFrame) -> DataFrame:
    """Exposure and gain against the reference frame, the one of the most pixels (of several, the first)."""
    ref = frames.orderBy(F.col("pixels").desc(), "frame").limit(1).select(F.col("exposure").alias("ref_exposure"), F.col("gain").alias("ref_gain"))
    return frames.crossJoin(F.broadcast(ref)).select("frame", (F.col("exposure") / F.col("ref_exposure") * F.col("gain") / F.col("ref_gain")).alias("weight"))
