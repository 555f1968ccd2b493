"""Queries of demosaicing, replies of catalogues and photometric calibration. Registered with those of plans.queries."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from skyframe.functions import sky
from skyframe.operators import calibration, catalogs, demosaic, frames
from skyframe.operators.scratch import path_for, stored
from skyframe.plans import views
from skyframe.plans.queries import _gaia_sql, query
from skyframe.plans.views import CATALOG, HEIGHT, PX, WIDTH
from skyframe.sources import widefield

# ---- colour --------------------------------------------------------------------------------------------------------

READS = ", ".join(f"({cx}, {cy}, '{c}', {dx}, {dy})" for (cx, cy), reads in demosaic.X_TRANS.items() for c, (dx, dy) in reads.items())


@query(f"""WITH {PX}, t(cx, cy, c, dx, dy) AS (VALUES {READS}),
 g AS (SELECT frame, x - dx AS x, y - dy AS y, c, v FROM px JOIN t ON (x - dx + 2) % 3 = cx AND (y - dy + 2) % 3 = cy WHERE x - dx BETWEEN 2 AND {WIDTH - 2} AND y - dy BETWEEN 2 AND {HEIGHT - 2}),
 p AS (SELECT frame, x, y, max(v) FILTER (c = 'one') AS a, max(v) FILTER (c = 'green') AS g, max(v) FILTER (c = 'two') AS b FROM g GROUP BY 1, 2, 3)
 SELECT frame, x, y, CASE WHEN ((x - 1) % 6 < 3) = ((y - 1) % 6 < 3) THEN a ELSE b END AS r, g, CASE WHEN ((x - 1) % 6 < 3) = ((y - 1) % 6 < 3) THEN b ELSE a END AS b FROM p""")
def px_x_trans_demosaic(spark, sf_dir):
    return demosaic.x_trans(views.px(spark, sf_dir), WIDTH, HEIGHT)


def _guarded_sql() -> str:
    p = lambda dx, dy: f"max(v) FILTER (dx = {dx} AND dy = {dy}) AS p{dx + 1}{dy + 1}"
    moves = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    last = (WIDTH - 10) // 2
    return f"""WITH {PX}, bg AS (SELECT frame, coalesce(sum(v * k) / CAST(sum(k) AS DOUBLE), 0) AS bg FROM (SELECT frame, v, (CASE WHEN x BETWEEN 10 AND {last} THEN 1 ELSE 0 END + CASE WHEN x BETWEEN 11 AND {last + 1} THEN 1 ELSE 0 END) * (CASE WHEN y BETWEEN 10 AND {last} THEN 1 ELSE 0 END + CASE WHEN y BETWEEN 11 AND {last + 1} THEN 1 ELSE 0 END) AS k FROM px) GROUP BY frame),
 m(dx, dy) AS (VALUES {", ".join(map(str, moves))}),
 s AS (SELECT frame, x - dx AS x, y - dy AS y, {", ".join(p(i, j) for i, j in moves)}, count(*) FILTER (dx = 0 OR dy = 0) AS straight FROM px, m WHERE x - dx BETWEEN 1 AND {WIDTH - 2} AND y - dy BETWEEN 1 AND {HEIGHT - 2} GROUP BY 1, 2, 3),
 k AS (SELECT *, CASE WHEN x % 2 = y % 2 THEN CASE x % 2 WHEN 0 THEN 'R' ELSE 'B' END ELSE CASE y % 2 WHEN 0 THEN 'GR' ELSE 'GB' END END AS c, (p01 + p21) / 2.0::DOUBLE AS h, (p10 + p12) / 2.0::DOUBLE AS w, (p01 + p21 + p10 + p12) / 4.0::DOUBLE AS q, (p00 + p02 + p20 + p22) / 4.0::DOUBLE AS d FROM s WHERE x % 2 = y % 2 OR straight > 0),
 o AS (SELECT frame, x, y, CASE c WHEN 'R' THEN p11 WHEN 'B' THEN d WHEN 'GR' THEN h ELSE w END AS r, CASE WHEN c IN ('R', 'B') THEN q ELSE p11 END AS g, CASE c WHEN 'R' THEN d WHEN 'B' THEN p11 WHEN 'GR' THEN w ELSE h END AS b,
  CASE c WHEN 'GR' THEN greatest(p01, p21) > h + 0.5 * bg OR greatest(p10, p12) > p11 + 0.5 * bg WHEN 'GB' THEN greatest(p10, p12) > w + 0.5 * bg OR greatest(p01, p21) > p11 + 0.5 * bg ELSE greatest(p01, p21, p10, p12) > q + 0.5 * bg / 1.67::DOUBLE OR greatest(p00, p02, p20, p22) > d + 0.5 * bg / 1.67::DOUBLE END AS f FROM k JOIN bg USING (frame))
 SELECT frame, x, y, {", ".join(f"round(CASE WHEN f THEN (r + g + b) / 3 ELSE {c} END, 3) AS {c}" for c in "rgb")} FROM o"""


@query(_guarded_sql())
def px_guarded_demosaic(spark, sf_dir):
    """The sample for the background is taken from the frame's first half, as frames are small."""
    px = stored(views.px(spark, sf_dir), "raw")
    got = demosaic.guarded(px, demosaic.sampled_background(px, WIDTH, HEIGHT, part=2), WIDTH, HEIGHT)
    return got.select("frame", "x", "y", *[F.round(c, 3).alias(c) for c in "rgb"])


# ---- replies -------------------------------------------------------------------------------------------------------

#: A reply for each nation, a star for each of its customers; every thirteenth line lacks columns, some have two blanks. The
#: last nation's reply has no heading, and all have one within the preamble.
UNHEADED = 24


def _replies(spark, sf_dir):
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    three = lambda c: F.lpad(s(c % 1000), 3, "0")
    ra = F.concat(s(k * 37 % 360), F.lit("."), three(k * 7))
    dec = F.concat(F.when(k % 2 == 0, "-").otherwise(""), s(k * 53 % 85), F.lit("."), three(k * 11))
    tenths = lambda shift: 80 + k * 3 % 90 + shift
    mag = lambda shift: F.concat(s(F.floor(tenths(shift) / 10)), F.lit("."), s(tenths(shift) % 10))
    wide = F.when(k % 5 == 0, "  ").otherwise(" ")
    text = F.concat(ra, wide, dec, F.lit(" "), mag(F.lit(0)), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit(" "), mag(k % 9))), F.when(k % 13 < 2, "").otherwise(F.concat(wide, mag(-(k % 7)))))
    stars = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("reply"), (k + 37).alias("pos"), text.alias("text"))
    head = F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("pos"), F.lit(t).alias("text")) for p, t in ((0, "#"), (3, "RA_ICRS  DE_ICRS"), (35, "RA_ICRS  DE_ICRS  Gmag  BPmag  RPmag"), (36, "-------  -------  ----  -----  -----"))])).alias("h")
    heads = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("reply"), head).select("reply", "h.pos", "h.text").filter((F.col("reply") != UNHEADED) | (F.col("pos") < 35))
    return stars.unionByName(heads)


REPLIES = f"""k AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS reply, c_custkey + 37 AS pos, c_custkey * 37 % 360 + c_custkey * 7 % 1000 / 1000.0::DOUBLE AS ra, CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * (c_custkey * 53 % 85 + c_custkey * 11 % 1000 / 1000.0::DOUBLE) AS dec,
 (80 + c_custkey * 3 % 90) / 10.0::DOUBLE AS g, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE (80 + c_custkey * 3 % 90 + c_custkey % 9) / 10.0::DOUBLE END AS bp, CASE WHEN c_custkey % 13 < 2 THEN 0 ELSE (80 + c_custkey * 3 % 90 - c_custkey % 7) / 10.0::DOUBLE END AS rp FROM customer WHERE c_nationkey <> {UNHEADED}),
 c AS (SELECT *, bp - rp AS c, max(pos) OVER (PARTITION BY reply) AS last FROM k), s AS (SELECT * EXCLUDE (k), k AS id, {_gaia_sql("V")} FROM c WHERE k % 13 > 0)"""


@query(f"WITH {REPLIES} SELECT reply, pos, round(radians(ra), 9) AS ra, round(radians(dec), 9) AS dec, g, bp, rp, CASE WHEN rp = 0 THEN 0 ELSE v END AS mag FROM s WHERE pos < last - 1")
def gaia_reply(spark, sf_dir):
    got = catalogs.gaia_stars(_replies(spark, sf_dir), "V")
    return got.select("reply", "pos", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"), "g", "bp", "rp", F.round("mag", 7).alias("mag"))


@query(f"WITH {REPLIES} SELECT reply, pos, CAST(round(ra * 2400) AS BIGINT) AS ra_units, CAST(round(dec * 3600) AS BIGINT) AS dec_units, v AS mag FROM s WHERE rp <> 0 AND v <> 0")
def vizier_reply(spark, sf_dir):
    return catalogs.vizier_stars(_replies(spark, sf_dir), "V").select("reply", "pos", "ra_units", "dec_units", F.round("mag", 7).alias("mag"))


@query(f"WITH {CATALOG} SELECT round(CAST(CAST(ra AS FLOAT) AS DOUBLE), 5) AS ra, round(CAST(CAST(dec AS FLOAT) AS DOUBLE), 5) AS dec, floor(mag * 10 + 0.5) / 10 AS mag FROM catalog WHERE floor(mag * 10 + 0.5) / 10 <= 9.5")
def wide_field(spark, sf_dir):
    """The catalogue written as files of fixed records and read again by byte ranges, up to a magnitude."""
    path = path_for(spark, "wide")
    widefield.write(views.catalog(spark, sf_dir), path).write.format("noop").mode("overwrite").save()
    return widefield.read(spark, path, records=1000).filter("mag <= 9.5").select(F.round("ra", 5).alias("ra"), F.round("dec", 5).alias("dec"), "mag")


# ---- photometric calibration ---------------------------------------------------------------------------------------

#: Two frames for each 50 parts, 25 stars in each: every eleventh star is red, every seventh has a catalogue magnitude that is a
#: whole one off, every thirteenth is saturated. Frames have zero points from 24 to 28. Fields stand on a grid, BANDS in
#: declination and COLUMNS in right ascension (up to 2,160,000 frames), 0.1 degrees or more apart: what is within a frame and its
#: slop, 0.057 degrees from its centre, holds none of another's stars, which are up to 0.028 from theirs.
SHOT, SPREAD = 220, 2.0
UNIT, BANDS, COLUMNS = 2.5e-4, 1200, 1800


def _shots(spark, sf_dir):
    """(frame, slot, k, x, y, peak): places with some tenths of a pixel."""
    k = F.col("p_partkey")
    slot = F.pmod(F.floor((k - 1) / 2), F.lit(25))
    return views.table(spark, sf_dir, "part").select((F.floor((k - 1) / 50) * 2 + F.pmod(k, F.lit(2))).alias("frame"), k.alias("k"), (slot % 5 * 36 + 38 + k % 7 / 10.0).alias("x"), (F.floor(slot / 5) * 36 + 38 + k % 5 / 10.0).alias("y"), F.when(k % 13 == 0, 80000.0).otherwise(4000.0 + k % 50 * 200).alias("peak"))


def _exposures(spark, sf_dir):
    """(frame, k, x, y, peak: arrays over its stars): what _exposed draws a frame from."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = _shots(spark, sf_dir).repartition(n, "frame").groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y", "peak"))).alias("p"))
    return each.select("frame", "p.x", "p.y", "p.peak")


@cache
def _empty():
    """A flat noisy sky."""
    import numpy as np

    y, x = np.mgrid[:SHOT, :SHOT]
    return 500.0 + ((x * 7919 + y * 104729) % 21 - 10)


def _exposed(row):
    """The image of a row of _exposures. It is made where it is measured: 387 KB for some 50 bytes of each part."""
    import numpy as np

    across = lambda c: np.exp(-((np.arange(SHOT) - np.asarray(c)[:, None]) ** 2) / (2 * SPREAD * SPREAD))
    return np.minimum(_empty() + (np.asarray(row.peak)[:, None] * across(row.y)).T @ across(row.x), 65000.0)


def _shot_solutions(spark, sf_dir):
    f = F.col("frame")
    s = _shots(spark, sf_dir).select("frame").distinct()
    angle = F.radians((f * 17 % 360).cast("double"))
    unit = UNIT
    return s.select("frame", F.lit(SHOT).alias("width"), F.lit(SHOT).alias("height"), F.radians(F.floor(f / BANDS) % COLUMNS * 0.2).alias("ra0"), F.radians(f % BANDS * 0.1 - 59.95).alias("dec0"), F.lit(SHOT / 2 + 0.5).alias("crpix1"), F.lit(SHOT / 2 + 0.5).alias("crpix2"), (-F.cos(angle) * unit).alias("cd1_1"), (F.sin(angle) * unit).alias("cd1_2"), (F.sin(angle) * unit).alias("cd2_1"), (F.cos(angle) * unit).alias("cd2_2"), F.lit(65000.0).alias("datamax"))


def _shot_catalog(spark, sf_dir, solutions):
    """Each frame's stars through its solution, with the magnitude of their light at its zero point."""
    p = _shots(spark, sf_dir).join(solutions, "frame")
    ra, dec = sky.to_sky(F.col("x") + 1, F.col("y") + 1, {c: F.col(c) for c in calibration.SOLUTION})
    k = F.col("k")
    mag = 24 + F.col("frame") % 5 - 2.5 * F.log10(F.col("peak") * (2 * sky.PI * SPREAD * SPREAD)) + F.when(k % 7 == 0, 1.0).otherwise(0.0)
    return p.select(k.alias("id"), ra.alias("ra"), dec.alias("dec"), mag.alias("mag"), F.when(k % 11 == 0, 1.9).otherwise(k % 9 / 10.0).alias("colour"))


def _calibrated(spark, sf_dir, ratio: float):
    solutions, images = _shot_solutions(spark, sf_dir), _exposures(spark, sf_dir)
    catalog = stored(_shot_catalog(spark, sf_dir, solutions), "catalogue")
    sizes = calibration.apertures(frames.analysed(images, _exposed), ratio, 8.0) if ratio else None
    # fields must not lie over one another: an image shows its own frame's stars alone
    stars = calibration.measured(images, calibration.candidates(solutions, catalog), sizes, solutions.select("frame", "datamax"), _exposed)
    return solutions, stored(stars, "measured")


SHOTS = "k AS (SELECT p_partkey AS k, CAST(floor((p_partkey - 1) / 50.0) AS BIGINT) * 2 + p_partkey % 2 AS frame FROM part)"


@query(f"WITH {SHOTS}, n AS (SELECT frame, count(*) FILTER (k % 11 <> 0 AND k % 13 <> 0) AS stars FROM k GROUP BY frame) SELECT frame, stars, CASE WHEN stars >= 3 THEN CAST(24 + frame % 5 AS DOUBLE) END AS mzero, CASE WHEN stars < 3 THEN 'no stars' END AS failure FROM n")
def frame_calibration(spark, sf_dir):
    """Zero points of all frames with the whole light of stars; the SQL has the true ones."""
    solutions, stars = _calibrated(spark, sf_dir, 0.0)
    return calibration.frame_calibration(solutions, stars).select("frame", "stars", F.round("mzero", 1).alias("mzero"), "failure")


@query(f"WITH {SHOTS} SELECT frame, k AS id, CASE WHEN k % 13 = 0 THEN 'saturated' END AS reason FROM k WHERE k % 11 <> 0")
def calibration_stars(spark, sf_dir):
    """Which stars of each frame count, with an aperture by the frame's median HFD."""
    return _calibrated(spark, sf_dir, 2.0)[1].select("frame", "id", "reason")


@query(f"WITH {SHOTS} SELECT frame, k AS id, true AS near FROM k WHERE k % 11 <> 0 AND k % 13 <> 0")
def frame_magnitudes(spark, sf_dir):
    """Magnitudes of the stars that count, by their frame's zero point: within 0.05 of the true ones."""
    solutions, stars = _calibrated(spark, sf_dir, 0.0)
    got = calibration.star_magnitudes(stars.filter("reason is null"), calibration.frame_calibration(solutions, stars))
    true = F.col("mag") - F.when(F.col("id") % 7 == 0, 1.0).otherwise(0.0)
    return got.select("frame", "id", (F.abs(F.col("magnitude") - true) < 0.05).alias("near"))
