"""Queries of whole frames and fields: distortion, catalogues in fields, mosaics. Registered with those of plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyframe.functions import sky, tiles, when
from skyframe.operators import asteroids, field, mosaic as mosaics, sip
from skyframe.operators.fit import POWERS
from skyframe.operators.scratch import path_for, stored
from skyframe.plans import solve, views
from skyframe.plans.queries import TWO_PI, _tiles_sql, query, r6
from skyframe.plans.views import CATALOG
from skyframe.sources import codecs, startiles

# ---- distortion ----------------------------------------------------------------------------------------------------

#: Four frames of stars with a planted cubic distortion and some tenths of a pixel of noise.
SIP_WCS = {"ra0": 1.2, "dec0": 0.6, "crpix1": 1600.0, "crpix2": 1100.0, "cd1_1": -4e-4, "cd1_2": 3e-5, "cd2_1": 3e-5, "cd2_2": 4e-4}
SIP_PLANTED = ({(2, 0): 2e-6, (1, 1): -1e-6, (0, 2): 1.5e-6, (3, 0): 4e-10, (1, 2): -3e-10}, {(2, 0): -1e-6, (1, 1): 2e-6, (0, 3): 5e-10, (2, 1): 2e-10})


def _sip_pairs(spark, sf_dir):
    k = F.col("c_custkey")
    s = views.table(spark, sf_dir, "customer").select((k % 4).alias("frame"), (k * 7919 % 3201 + 0.5).alias("x"), (k * 104729 % 2203 + 0.25).alias("y"), (k % 11 - 5.0).alias("nx"), (k % 7 - 3.0).alias("ny"))
    noisy = s.withColumns({"x": F.col("x") + F.col("nx") / 50, "y": F.col("y") + F.col("ny") / 50})
    ra, dec = sky.to_sky(F.col("x"), F.col("y"), SIP_WCS | {"sip": SIP_PLANTED})  # the catalogue's place; the measured one is a little off
    return sip.pairs_of(noisy.withColumns({"ra": ra, "dec": dec}).withColumns({"x": F.col("x") - F.col("nx") / 50, "y": F.col("y") - F.col("ny") / 50}), SIP_WCS)


def _poly(u: str, v: str, terms: dict) -> str:
    return " + ".join(f"{f!r}::DOUBLE * pow({u}, {i}) * pow({v}, {j})" for (i, j), f in terms.items())


def _normal(x: str, y: str, u: str, v: str) -> str:
    row = lambda i, j: "[" + ", ".join([f"sum(pow({x} / 1000, {i + a}) * pow({y} / 1000, {j + b}))" for a, b in POWERS] + [f"sum(pow({x} / 1000, {i}) * pow({y} / 1000, {j}) * {q} / 1000)" for q in (u, v)]) + "]"
    return "[" + ", ".join(row(i, j) for i, j in POWERS) + "]"


def _planted(u: str, v: str, k: int) -> str:
    return f"{(u, v)[k]} + {_poly(u, v, SIP_PLANTED[k])}"


#: Gauss-Jordan as a recursive query: a step for each of ten pivots.
SIP = f"""WITH RECURSIVE p AS (SELECT c_custkey % 4 AS frame, c_custkey * 7919 % 3201 + 0.5::DOUBLE - 1600 AS px, c_custkey * 104729 % 2203 + 0.25::DOUBLE - 1100 AS py, (c_custkey % 11 - 5) / 50::DOUBLE AS nx, (c_custkey % 7 - 3) / 50::DOUBLE AS ny FROM customer),
o AS (SELECT frame, px, py, px + nx AS x, py + ny AS y FROM p),
q AS (SELECT frame, px, py, {_planted("x", "y", 0)} AS sx, {_planted("x", "y", 1)} AS sy FROM o),
s AS (SELECT frame, 'f' AS dir, count(*) AS n, {_normal("px", "py", "sx", "sy")} AS m FROM q GROUP BY frame UNION ALL SELECT frame, 'r', count(*), {_normal("sx", "sy", "px", "py")} FROM q GROUP BY frame),
g AS (SELECT frame, dir, n, 1 AS k, m FROM s WHERE n >= 20 UNION ALL SELECT frame, dir, n, k + 1, list_transform(range(1, 11), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda z: z / m[k][k]) ELSE list_transform(range(1, 13), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END) FROM g WHERE k <= 10),
c AS (SELECT frame, dir, n, unnest(range(1, 11)) AS r, m FROM g WHERE k = 11),
t AS (SELECT frame, n, CASE dir WHEN 'f' THEN 'A' ELSE 'AP' END AS axis, r, m[r][11] - CASE WHEN r = {POWERS.index((1, 0)) + 1} THEN 1 ELSE 0 END AS v FROM c UNION ALL SELECT frame, n, CASE dir WHEN 'f' THEN 'B' ELSE 'BP' END, r, m[r][12] - CASE WHEN r = {POWERS.index((0, 1)) + 1} THEN 1 ELSE 0 END FROM c)"""
KEYS = repr([f"_{i}_{j}" for i, j in POWERS])


@query(SIP + f" SELECT frame, axis || ({KEYS})[r] AS key, round(v * 1000, 5) + 0.0 AS shift FROM t")
def sip_fit(spark, sf_dir):
    """The factors as pixels of shift at 1000 pixels from the reference pixel."""
    c = sip.coefficients(sip.fitted(_sip_pairs(spark, sf_dir), ["frame"]), ["frame"])
    grade = F.substring_index("key", "_", -1).cast("int") + F.get(F.split("key", "_"), F.lit(1)).cast("int")
    return c.select("frame", "key", (F.round(F.col("value") * F.pow(F.lit(1000.0), grade), 5) + 0.0).alias("shift"))


def _value(axis: str, x: str, y: str) -> str:
    return " + ".join(f"{axis}[{r + 1}] * 1000 * pow({x} / 1000, {i}) * pow({y} / 1000, {j})" for r, (i, j) in enumerate(POWERS))


@query(SIP + f""", w AS (SELECT frame, n, list(v ORDER BY r) FILTER (axis = 'A') AS a, list(v ORDER BY r) FILTER (axis = 'B') AS b, list(v ORDER BY r) FILTER (axis = 'AP') AS ap, list(v ORDER BY r) FILTER (axis = 'BP') AS bp FROM t GROUP BY frame, n),
 d AS (SELECT q.*, n, ap, bp, px + {_value("a", "px", "py")} AS fx, py + {_value("b", "px", "py")} AS fy, sx + {_value("ap", "sx", "sy")} AS gx, sy + {_value("bp", "sx", "sy")} AS gy FROM q JOIN w USING (frame)),
 h AS (SELECT *, fx + {_value("ap", "fx", "fy")} AS hx, fy + {_value("bp", "fx", "fy")} AS hy FROM d)
 SELECT frame, n, round(sqrt(avg(pow(fx - sx, 2) + pow(fy - sy, 2))), 5) AS forward, round(sqrt(avg(pow(gx - px, 2) + pow(gy - py, 2))), 5) AS inverse, round(sqrt(max(pow(hx - px, 2) + pow(hy - py, 2))), 5) AS there_and_back FROM h GROUP BY frame, n""")
def sip_residuals(spark, sf_dir):
    pairs = _sip_pairs(spark, sf_dir)
    fits = sip.fitted(pairs, ["frame"])
    out = sip.residuals(pairs, fits, ["frame"]).join(fits.select("frame", "n"), "frame")
    return out.select("frame", "n", *[F.round(c, 5).alias(c) for c in ("forward", "inverse", "there_and_back")])


# ---- catalogues in fields ------------------------------------------------------------------------------------------

FIELD = 0.15


def _fields(spark, sf_dir):
    k = F.col("s_suppkey")
    return views.table(spark, sf_dir, "supplier").select(k.alias("frame"), (k * 37 % 628 / 100.0).alias("ra0"), ((k * 53 % 301 - 150) / 100.0).alias("dec0"), F.lit(FIELD).alias("field"))


FIELDS = f"fields AS (SELECT s_suppkey AS frame, s_suppkey * 37 % 628 / 100.0::DOUBLE AS ra0, (s_suppkey * 53 % 301 - 150) / 100.0::DOUBLE AS dec0 FROM supplier)"
SQUARE = f"square AS (SELECT frame, ra0, dec0, id, ra, dec, mag FROM fields, catalog WHERE abs(dec - dec0) < {FIELD / 2!r}::DOUBLE AND abs(fmod(ra - ra0 + 3 * pi(), {TWO_PI}) - pi()) * cos(dec0) < {FIELD / 2!r}::DOUBLE)"


@query(f"WITH {CATALOG}, {FIELDS}, {SQUARE} SELECT frame, id FROM square")
def catalog_in_square(spark, sf_dir):
    return field.in_square(_fields(spark, sf_dir), views.catalog(spark, sf_dir)).select("frame", "id")


def _corners_sql(n: int) -> str:
    f = repr(FIELD) + "::DOUBLE"
    return f"""{_tiles_sql(n)},
 corner AS (SELECT frame, o, north, east, dec0 + north * {f} / 2 AS d, ra0 + east * {f} / 2 / cos(dec0 + north * {f} / 2) AS r FROM fields, (VALUES (1, 1, 1), (2, 1, -1), (3, -1, 1), (4, -1, -1)) c(o, north, east)),
 turned AS (SELECT *, CASE WHEN r < 0 THEN r + {TWO_PI} WHEN r >= {TWO_PI} THEN r - {TWO_PI} ELSE r END AS rr FROM corner),
 spaced AS (SELECT frame, o, d, first + 1 + CASE WHEN cells = 1 THEN 0 ELSE CAST(floor(rr * cells / {TWO_PI}) AS BIGINT) END AS tile, CASE WHEN cells = 1 THEN {TWO_PI} ELSE CASE WHEN east > 0 THEN rr * cells / {TWO_PI} - floor(rr * cells / {TWO_PI}) ELSE 1 - (rr * cells / {TWO_PI} - floor(rr * cells / {TWO_PI})) END * {TWO_PI} / cells * cos(d) END AS width, CASE WHEN north > 0 THEN d - low ELSE high - d END AS height FROM turned JOIN ring ON (d <= high OR k = {len(tiles.scheme(n)[0]) - 1}) AND (d > low OR k = 0)),
 shared AS (SELECT frame, o, tile, least(width, {f}) * least(height, {f}) / ({f} * {f}) AS share FROM spaced QUALIFY row_number() OVER (PARTITION BY frame, tile ORDER BY o) = 1),
 placed AS (SELECT frame, tile, share, row_number() OVER (PARTITION BY frame ORDER BY o) AS place FROM shared WHERE share >= 0.01)"""


@query(f"WITH {CATALOG}, {FIELDS}, {_corners_sql(290)} SELECT frame, place, CAST(tile AS BIGINT) AS tile, round(share, 6) AS share FROM placed")
def field_tiles(spark, sf_dir):
    f = _fields(spark, sf_dir)
    t = f.select("frame", F.posexplode(tiles.corner_shares(F.col("ra0"), F.col("dec0"), F.col("field"))).alias("place", "t"))
    return t.select("frame", (F.col("place") + 1).cast("long").alias("place"), "t.tile", r6("t.share", "share"))


TILE_OF = "CAST(first + 1 + CASE WHEN cells > 1 THEN CAST(floor(ra * (cells / " + TWO_PI + ")) AS BIGINT) ELSE 0 END AS BIGINT)"
WANTED = 6


@query(f"""WITH {CATALOG}, {FIELDS}, {SQUARE}, {_corners_sql(290)},
 t AS (SELECT s.*, {TILE_OF} AS tile FROM square s JOIN ring ON dec <= high AND (dec > low OR k = 0)),
 r AS (SELECT t.*, place, row_number() OVER (PARTITION BY t.frame, place ORDER BY mag, id) AS rank FROM t JOIN placed p ON p.frame = t.frame AND p.tile = t.tile),
 n AS (SELECT p.frame, p.place, CAST(floor({WANTED} * sum(share) OVER (PARTITION BY p.frame ORDER BY p.place)) AS BIGINT) AS q, (SELECT count(*) FROM r WHERE r.frame = p.frame AND r.place = p.place) AS n FROM placed p),
 q AS (SELECT frame, list(struct_pack(q := least(q, {WANTED}), n := n) ORDER BY place) AS l FROM n GROUP BY frame),
 a AS (SELECT frame, list_transform(range(1, len(l) + 1), lambda k: l[k]) AS l FROM q),
 s1 AS (SELECT frame, l, greatest(0, least(l[1].n, l[1].q)) AS q1 FROM a),
 s2 AS (SELECT *, CASE WHEN len(l) < 2 THEN 0 ELSE greatest(0, least(l[2].n, l[2].q - q1)) END AS q2 FROM s1),
 s3 AS (SELECT *, CASE WHEN len(l) < 3 THEN 0 ELSE greatest(0, least(l[3].n, l[3].q - q1 - q2)) END AS q3 FROM s2),
 s4 AS (SELECT *, CASE WHEN len(l) < 4 THEN 0 ELSE greatest(0, least(l[4].n, l[4].q - q1 - q2 - q3)) END AS q4 FROM s3)
 SELECT r.frame, id, tile, round(mag, 6) AS mag, round(cos(dec) * sin(ra - ra0) / h, 6) + 0.0 AS xi, round((sin(dec) * cos(dec0) - cos(dec) * sin(dec0) * cos(ra - ra0)) / h, 6) + 0.0 AS eta
 FROM (SELECT *, sin(dec) * sin(dec0) + cos(dec) * cos(dec0) * cos(ra - ra0) AS h FROM r) r JOIN s4 ON s4.frame = r.frame WHERE rank <= ([q1, q2, q3, q4])[place]""")
def catalog_in_field(spark, sf_dir):
    got = field.brightest_by_tile(_fields(spark, sf_dir), views.catalog(spark, sf_dir), WANTED)
    return got.select("frame", "id", "tile", r6("mag", "mag"), (F.round("xi", 6) + 0.0).alias("xi"), (F.round("eta", 6) + 0.0).alias("eta"))


RU, DU = repr(codecs.RA_UNIT) + "::DOUBLE", repr(codecs.DEC_UNIT) + "::DOUBLE"
STORED = f"stored AS (SELECT {TILE_OF} AS tile, floor(ra / {RU} + 0.5) * {RU} AS ra, floor(dec / {DU} + 0.5) * {DU} AS dec, floor(mag * 10 + 0.5) / 10 AS mag, floor(colour * 10 + 0.5) / 10 AS colour FROM catalog JOIN ring ON dec <= high AND (dec > low OR k = 0))"


def _star_tiles(spark, sf_dir, n=290):
    path = path_for(spark, "tiles")
    startiles.write(views.catalog(spark, sf_dir).select("ra", "dec", "mag", "colour"), path, n).write.format("noop").mode("overwrite").save()
    return path


@query(f"WITH {CATALOG}, {_tiles_sql(290)}, {STORED} SELECT CAST(tile AS INTEGER) AS tile, round(ra, 5) AS ra, round(dec, 5) AS dec, mag, colour FROM stored WHERE mag <= 12.5 AND dec > 0.2")
def star_tiles(spark, sf_dir):
    """The catalogue written as tiles and read again by declination and magnitude, through the data source."""
    got = startiles.read(spark, _star_tiles(spark, sf_dir)).filter("mag <= 12.5 and dec > 0.2")
    return got.select("tile", F.round("ra", 5).alias("ra"), F.round("dec", 5).alias("dec"), "mag", "colour")


# ---- mosaics -------------------------------------------------------------------------------------------------------

#: Frames of 24 x 24 pixels, one for each supplier, ten to a row, 18 apart: neighbours share six rows or columns. A frame
#: has its own level. Levels of pixels are whole numbers.
SIDE, STEP, LIMIT = 24, 18, 4000.0


def _tiles_px(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % SIDE).alias("x"), (F.col("l_orderkey") % SIDE).alias("y"), F.col("l_quantity").cast("long").alias("q"))
    return li.groupBy("frame", "x", "y").agg(F.expr("sum(q) div count(*)").alias("q")).select("frame", "x", "y", (2000 + F.col("frame") * 29 % 200 + F.col("q")).alias("v"))


def _tiles_frames(spark, sf_dir):
    k = F.col("s_suppkey")
    return views.table(spark, sf_dir, "supplier").select(k.alias("frame"), k.alias("order"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), (k % 10 * STEP).alias("dx"), (F.floor(k / 10) * STEP).alias("dy"))


TILES_PX = f"tp AS (SELECT frame, x, y, 2000 + frame * 29 % 200 + q AS v FROM (SELECT l_suppkey AS frame, l_partkey % {SIDE} AS x, l_orderkey % {SIDE} AS y, CAST(sum(CAST(l_quantity AS BIGINT)) // count(*) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2, 3))"


@query(f"""WITH RECURSIVE {TILES_PX},
 p AS (SELECT frame, x + frame % 10 * {STEP} AS x, y + frame // 10 * {STEP} AS y, CAST(v AS DOUBLE) AS v, CAST(1 + least(x, y, {SIDE - 1} - x, {SIDE - 1} - y) AS DOUBLE) AS d FROM tp WHERE x BETWEEN 1 AND {SIDE - 3} AND y BETWEEN 1 AND {SIDE - 3}),
 l AS (SELECT x, y, list(struct_pack(f := frame, v := v, d := d) ORDER BY frame) AS own FROM p GROUP BY x, y),
 e AS (SELECT x, y, own, unnest(range(1, len(own) + 1)) AS k FROM l),
 w AS (SELECT x, y, own, k, list_transform(range(1, k + 1), lambda j: CASE WHEN j = 1 THEN 1.0::DOUBLE ELSE own[j].d / (own[j].d + own[j - 1].d) END * coalesce(list_product(list_transform(range(j + 1, k + 1), lambda i: 1 - own[i].d / (own[i].d + own[i - 1].d))), 1)) AS c FROM e),
 b AS (SELECT a.x, a.y, n.own[n.k].f AS f, list_sum(list_transform(range(1, a.k + 1), lambda j: a.c[j] * a.own[j].v)) - n.own[n.k].v AS d, a.c, list_transform(range(1, a.k + 1), lambda j: a.own[j].f) AS others FROM w a JOIN w n ON a.x = n.x AND a.y = n.y AND n.k = a.k + 1),
 g AS (SELECT * FROM b WHERE abs(d) < {LIMIT}),
 base AS (SELECT f, avg(d) AS a, count(*) AS n FROM g GROUP BY f),
 need AS (SELECT f, o, sum(c) AS c FROM (SELECT f, unnest(others) AS o, unnest(c) AS c FROM g) GROUP BY f, o),
 prep AS (SELECT s_suppkey AS f, row_number() OVER (ORDER BY s_suppkey) AS k, coalesce(a, 0) AS a, coalesce(n, 1) AS n, (SELECT list(struct_pack(o := o, c := c)) FROM need WHERE need.f = s_suppkey) AS l FROM supplier LEFT JOIN base ON base.f = s_suppkey),
 walk AS (SELECT CAST(0 AS BIGINT) AS k, MAP([CAST(-1 AS BIGINT)], [0.0::DOUBLE]) AS m UNION ALL SELECT prep.k, map_concat(m, MAP([prep.f], [a + coalesce(list_sum(list_transform(l, lambda q: q.c * m[q.o] / n)), 0)])) FROM walk JOIN prep ON prep.k = walk.k + 1),
 lev AS (SELECT m FROM walk ORDER BY k DESC LIMIT 1),
 done AS (SELECT x, y, k AS frames, list_sum(list_transform(range(1, k + 1), lambda j: c[j] * (own[j].v + m[own[j].f]))) AS v FROM w, lev WHERE k = len(own)),
 grown AS (SELECT x, y, 0 AS o, v, frames FROM done UNION ALL SELECT x + 1, y, 1, v, 0 FROM done UNION ALL SELECT x, y + 1, 2, v, 0 FROM done)
 SELECT x, y, round(v, 4) AS v, CAST(frames AS BIGINT) AS frames FROM grown WHERE x <= (SELECT max(x) FROM done) AND y <= (SELECT max(y) FROM done) QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY o) = 1""")
def mosaic(spark, sf_dir):
    got = mosaics.mosaic(_tiles_px(spark, sf_dir), _tiles_frames(spark, sf_dir), LIMIT)
    return got.select("x", "y", F.round("v", 4).alias("v"), "frames")


@query(f"""WITH {TILES_PX}, c AS (SELECT frame, CASE WHEN x <= 5 AND y <= 5 THEN 0 WHEN x <= 5 AND y >= 19 THEN 1 WHEN x >= 19 AND y <= 5 THEN 2 WHEN x >= 19 AND y >= 19 THEN 3 END AS corner, v FROM tp),
 m AS (SELECT frame, corner, v FROM (SELECT frame, corner, v, count(*) AS k FROM c WHERE corner IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY frame, corner ORDER BY k DESC, v) = 1),
 r AS (SELECT frame, v, row_number() OVER (PARTITION BY frame ORDER BY v, corner) AS r, count(*) OVER (PARTITION BY frame) AS n FROM m)
 SELECT frame, avg(v) AS background FROM r WHERE r BETWEEN (n + 1) // 2 AND n // 2 + 1 GROUP BY frame""")
def mosaic_background(spark, sf_dir):
    return mosaics.corner_background(_tiles_px(spark, sf_dir), _tiles_frames(spark, sf_dir))


# ---- minor planets -------------------------------------------------------------------------------------------------

RADIUS, FAINTEST, LATITUDE, LONGITUDE = 0.25, 17.0, 0.9, 0.1


def _elements(spark, sf_dir):
    k = F.col("c_custkey")
    comet = k % 9 == 0
    columns = {"epoch": 2460000.5 - k % 200, "anomaly": k * 31 % 360 + 0.5, "peri": k * 7 % 360 + 0.0, "node": k * 13 % 360 + 0.0, "incl": k % 23 + 0.25, "e": F.when(comet, 0.8 + k % 5 / 10.0).otherwise(k % 60 / 100.0), "axis": F.when(~comet, 1.1 + k % 31 / 10.0), "q": F.when(comet, 0.4 + k % 17 / 10.0), "h": 8 + k % 80 / 10.0, "g": F.when(comet, 10.0).otherwise(0.15)}
    return views.table(spark, sf_dir, "customer").select(k.alias("id"), *[c.cast("double").alias(n) for n, c in columns.items()])


def _nights(spark, sf_dir):
    k = F.col("s_suppkey")
    s = views.table(spark, sf_dir, "supplier").select(k.alias("frame"), (2460000.0 + k % 12 + k * 7 % 10 / 10.0).alias("jd"), (k * 37 % 628 / 100.0).alias("ra0"), ((k * 53 % 181 - 90) / 100.0).alias("dec0"), F.lit(RADIUS).alias("radius"))
    return s.withColumn("jd_tt", F.col("jd") + 0.0008)


A = repr(sky.ARCSEC) + "::DOUBLE"
OB = repr(when.OBLIQUITY) + "::DOUBLE"


def _equatorial(x: str, y: str, z: str) -> str:
    return f"{x} AS {{0}}x, cos({OB}) * {y} - sin({OB}) * {z} AS {{0}}y, sin({OB}) * {y} + cos({OB}) * {z} AS {{0}}z"


def _asteroids_sql(nights: str, tail: str) -> str:
    import math

    flat, au, radius, lat = 0.99664719, 149597870.700, 6378.14, LATITUDE
    u = math.atan(flat * math.tan(lat))
    s, c = flat * math.sin(u) + 100 * math.sin(lat) / 6378140.0, math.cos(u) + 100 * math.cos(lat) / 6378140.0
    k = "0.01720209895::DOUBLE"
    return f"""WITH el AS (SELECT c_custkey AS id, c_custkey % 9 = 0 AS comet, 2460000.5::DOUBLE - c_custkey % 200 AS epoch, radians(c_custkey * 31 % 360 + 0.5::DOUBLE) AS anomaly, radians(c_custkey * 7 % 360) AS peri, radians(c_custkey * 13 % 360) AS node, radians(c_custkey % 23 + 0.25::DOUBLE) AS i, CASE WHEN c_custkey % 9 = 0 THEN 0.8::DOUBLE + c_custkey % 5 / 10.0::DOUBLE ELSE c_custkey % 60 / 100.0::DOUBLE END AS e, 1.1::DOUBLE + c_custkey % 31 / 10.0::DOUBLE AS axis, 0.4::DOUBLE + c_custkey % 17 / 10.0::DOUBLE AS qc, 8 + c_custkey % 80 / 10.0::DOUBLE AS h FROM customer),
 o AS (SELECT *, CASE WHEN comet THEN qc ELSE axis * (1 - e) END AS q, CASE WHEN comet THEN epoch ELSE epoch - anomaly * pow(axis, 1.5) / {k} END AS t0 FROM el),
 f AS ({nights}),
 p AS (SELECT *, jd + 0.0008::DOUBLE AS tt, jd + 0.0008::DOUBLE - t0 AS dt FROM o, f),
 a AS (SELECT *, {k} * dt / pow(q / CASE WHEN abs(e - 1) < 1e-9 THEN 1 ELSE abs(1 - e) END, 1.5) AS m0, 1.5 * {k} * dt / sqrt(2 * q * q * q) AS w FROM p),
 b AS (SELECT *, CASE WHEN e < 1 THEN m0 - 2 * pi() * floor((m0 + pi()) / (2 * pi())) ELSE m0 END AS m, cbrt(w + sqrt(w * w + 1)) AS y FROM a),
 c AS (SELECT *, CASE WHEN abs(e - 1) < 1e-9 THEN 0 WHEN e < 1 THEN list_reduce(list_prepend(m + 0.85 * e * sign(sin(m)), list_transform(range(40), lambda k: 0.0::DOUBLE)), lambda x, k: x - greatest(-1, least(1, (x - e * sin(x) - m) / greatest(1 - e * cos(x), 1e-12))))
  ELSE list_reduce(list_prepend(asinh(m / e), list_transform(range(40), lambda k: 0.0::DOUBLE)), lambda x, k: x - greatest(-1, least(1, (e * sinh(x) - x - m) / greatest(e * cosh(x) - 1, 1e-12)))) END AS x FROM b),
 d AS (SELECT *, 2 * atan(CASE WHEN abs(e - 1) < 1e-9 THEN y - 1 / y WHEN e < 1 THEN sqrt((1 + e) / (1 - e)) * tan(x / 2) ELSE sqrt((e + 1) / (e - 1)) * tanh(x / 2) END) AS nu FROM c),
 s AS (SELECT * EXCLUDE (x, y), q * (1 + e) / (1 + e * cos(nu)) AS r, peri + nu AS u, {k} / sqrt(q * (1 + e)) AS pace FROM d),
 v AS (SELECT *, cos(node) * cos(u) - sin(node) * sin(u) * cos(i) AS ox, sin(node) * cos(u) + cos(node) * sin(u) * cos(i) AS oy, sin(u) * sin(i) AS oz, -cos(node) * sin(u) - sin(node) * cos(u) * cos(i) AS lx, -sin(node) * sin(u) + cos(node) * cos(u) * cos(i) AS ly, cos(u) * sin(i) AS lz FROM s),
 g AS (SELECT *, {_equatorial("r * ox", "r * oy", "r * oz").format("p")}, {_equatorial(*(f"pace * (e * sin(nu) * o{c} + (1 + e * cos(nu)) * l{c})" for c in "xyz")).format("v")}, (tt - 2451545) / 36525.0::DOUBLE AS t FROM v),
 em AS (SELECT *, radians(357.52911::DOUBLE + 35999.05029::DOUBLE * t - 0.0001537::DOUBLE * t * t) AS sm, 0.016708634::DOUBLE - 0.000042037::DOUBLE * t - 0.0000001267::DOUBLE * t * t AS se FROM g),
 ec AS (SELECT *, radians((1.914602::DOUBLE - 0.004817::DOUBLE * t - 0.000014::DOUBLE * t * t) * sin(sm) + (0.019993::DOUBLE - 0.000101::DOUBLE * t) * sin(2 * sm) + 0.000289::DOUBLE * sin(3 * sm)) AS sc FROM em),
 el2 AS (SELECT *, 1.000001018::DOUBLE * (1 - se * se) / (1 + se * cos(sm + sc)) AS er, radians(280.46646::DOUBLE + 36000.76983::DOUBLE * t + 0.0003032::DOUBLE * t * t) + sc + pi() - (5028.796195::DOUBLE * t + 1.1054348::DOUBLE * t * t) * {A} AS lon FROM ec),
 ep AS (SELECT *, er * cos(lon) AS ex, er * sin(lon) * cos({OB}) AS ey, er * sin(lon) * sin({OB}) AS ez FROM el2),
 li AS (SELECT *, {asteroids.LIGHT_DAYS!r}::DOUBLE * sqrt(pow(px - ex, 2) + pow(py - ey, 2) + pow(pz - ez, 2)) AS tau, {LONGITUDE!r}::DOUBLE + {sky.SIDEREAL_2000!r}::DOUBLE + (jd - 2451545) * {sky.SIDEREAL_RATE!r}::DOUBLE AS lst FROM ep),
 tp AS (SELECT *, px - ex - tau * vx - {radius / au * c!r}::DOUBLE * cos(lst) AS tx, py - ey - tau * vy - {radius / au * c!r}::DOUBLE * sin(lst) AS ty, pz - ez - tau * vz - {radius / au * s!r}::DOUBLE AS tz FROM li),
 sp AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS delta, fmod(atan2(ty, tx) + {TWO_PI}, {TWO_PI}) AS ra, atan2(tz, sqrt(tx * tx + ty * ty)) AS dec, sqrt(px * px + py * py + pz * pz) AS rs, sqrt(ex * ex + ey * ey + ez * ez) AS re, sqrt(pow(px - ex, 2) + pow(py - ey, 2) + pow(pz - ez, 2)) AS rp FROM tp),
 {tail}"""


NIGHTS = "SELECT s_suppkey AS frame, 2460000.0::DOUBLE + s_suppkey % 12 + s_suppkey * 7 % 10 / 10.0::DOUBLE AS jd, s_suppkey * 37 % 628 / 100.0::DOUBLE AS ra0, (s_suppkey * 53 % 181 - 90) / 100.0::DOUBLE AS dec0 FROM supplier"
IN_FIELD = f"""ne AS (SELECT *, acos((rp * rp + rs * rs - re * re) / (2 * rp * rs)) AS phase FROM sp WHERE pow((fmod(ra - ra0 + 3 * pi(), {TWO_PI}) - pi()) * cos(dec0), 2) + pow(dec - dec0, 2) < {RADIUS * RADIUS!r}::DOUBLE),
 ma AS (SELECT *, h + 5 * log10(delta) + CASE WHEN comet THEN 10 * log10(rs) ELSE 5 * log10(rs) + ln(0.85::DOUBLE * exp(-3.33::DOUBLE * exp(0.63::DOUBLE * ln(tan(phase / 2) + 1e-8))) + 0.15::DOUBLE * exp(-1.87::DOUBLE * exp(1.22::DOUBLE * ln(tan(phase / 2) + 1e-8)))) * {-2.5 / 2.302585092994046!r}::DOUBLE END AS mag FROM ne)
 SELECT frame, id, comet, round(ra, 6) AS ra, round(dec, 6) AS dec, round(delta, 6) AS delta, round(mag, 4) AS mag, NOT comet AND abs(tt - epoch) > 120 AS outdated FROM ma WHERE mag <= {FAINTEST}"""


@query(_asteroids_sql(NIGHTS, IN_FIELD))
def asteroids_in_field(spark, sf_dir):
    got = asteroids.in_fields(_nights(spark, sf_dir), asteroids.orbits(_elements(spark, sf_dir)), LATITUDE, LONGITUDE, FAINTEST)
    return got.select("frame", "id", "comet", r6("ra", "ra"), r6("dec", "dec"), r6("delta", "delta"), F.round("mag", 4).alias("mag"), "outdated")


@query(_asteroids_sql("SELECT 0 AS frame, 2460000.0::DOUBLE AS jd, 0 AS ra0, 0 AS dec0", "t2 AS (SELECT 1) SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(delta, 6) AS distance FROM sp"))
def minor_planet_positions(spark, sf_dir):
    """Topocentric places of all orbits at one time, light time taken out."""
    o = asteroids.orbits(_elements(spark, sf_dir))
    at = asteroids.observed(spark.range(1).select(F.lit(2460000.0).alias("jd")), F.col("jd") + 0.0008, sky.sidereal(F.col("jd"), F.lit(LONGITUDE)), LATITUDE)
    return asteroids.seen(o.crossJoin(at.drop("jd"))).select("id", r6("ra", "ra"), r6("dec", "dec"), r6("delta", "distance"))  # one time



# ---- plate solving -------------------------------------------------------------------------------------------------

#: A strip of sky with a star for each line number of an order, and a frame of 1000 x 1000 pixels for each supplier, with the brightest
#: stars of its field; it is turned, and its start position is off by some tenths of the field.
STRIP, VIEW, BRIGHTEST, PIXELS = 0.1, 0.11, 60, 1000


def _strip(spark, sf_dir):
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    li = stored(views.table(spark, sf_dir, "lineitem").select(k.alias("id")).distinct(), "strip")  # all else follows from the ids
    i = F.col("id")
    ra, dec = (i * 7919 + (i % 1009) * (i % 757)) % 1000003 / 1000003.0, (i * 104729 + (i % 911) * (i % 613)) % 999983 / 999983.0
    return li.select("id", (ra * sky.TWO_PI).alias("ra"), ((dec * 2 - 1) * STRIP).alias("dec"), (i % 997 / 100.0).alias("mag"))


def _views(spark, sf_dir):
    k = F.col("s_suppkey")
    s = views.table(spark, sf_dir, "supplier").select(k.alias("frame"), F.radians((k * 47 % 350 + 5).cast("double")).alias("ra"), F.radians((k * 3 % 5 - 2).cast("double")).alias("dec"), F.radians((k * 17 % 60).cast("double")).alias("turned"))
    return s.select("frame", "ra", "dec", "turned", (F.col("ra") + 0.012).alias("ra0"), (F.col("dec") - 0.01).alias("dec0"), F.lit(VIEW).alias("field"), F.lit(PIXELS).alias("width"), F.lit(PIXELS).alias("height"))


def _stars_in_view(spark, sf_dir, strip):
    """What a camera sees: the catalogue through each frame's true solution."""
    true = _views(spark, sf_dir).select("frame", "turned", F.col("ra").alias("ra0"), F.col("dec").alias("dec0"), (F.col("field") * 1.5).alias("field"))
    xi, eta = sky.to_standard(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0"))
    c, s, unit = F.cos("turned"), F.sin("turned"), VIEW / PIXELS
    mid = (PIXELS + 1) / 2
    x, y = (s * eta - c * xi) / unit + mid, (s * xi + c * eta) / unit + mid
    seen = field.brightest_in_square(true.withColumn("wanted", F.lit(BRIGHTEST)), strip, ["frame"], within=x.between(1, PIXELS) & y.between(1, PIXELS))
    return seen.select("frame", F.col("rank").cast("long").alias("id"), x.alias("x"), y.alias("y"))


@query(f"SELECT s_suppkey AS frame, CAST(s_suppkey * 47 % 350 + 5 AS DOUBLE) AS ra, CAST(s_suppkey * 3 % 5 - 2 AS DOUBLE) AS dec, {round(VIEW / PIXELS * 648000 / sky.PI, 1)!r}::DOUBLE AS scale, CAST(s_suppkey * 17 % 60 AS DOUBLE) AS turned FROM supplier")
def plate_solve(spark, sf_dir):
    """The solutions of all frames at once; the SQL has the true ones."""
    strip = _strip(spark, sf_dir)
    got = solve.solve_all(_views(spark, sf_dir).drop("ra", "dec"), _stars_in_view(spark, sf_dir, strip), strip)
    zero = lambda c, n: F.round(c, n) + 0.0
    return got.select("frame", zero(F.col("crval1"), 2).alias("ra"), zero(F.col("crval2"), 2).alias("dec"), F.round("scale", 1).alias("scale"), zero(F.degrees(F.atan2("cd2_1", "cd2_2")), 0).alias("turned"))
