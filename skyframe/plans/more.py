"""Further queries: apparent places, overlays, colours and header rules. Registered with those of plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyframe.functions import apparent, fields, light, sky, text, when
from skyframe.operators import fit, pixels
from skyframe.plans import views
from skyframe.plans.queries import D2R, NEAR, WCS, query, r6
from skyframe.plans.views import CATALOG, LC, PX

PI, A = repr(sky.PI) + "::DOUBLE", repr(sky.ARCSEC) + "::DOUBLE"
TWO = repr(sky.TWO_PI) + "::DOUBLE"


@query(f"""WITH {CATALOG}, k AS (SELECT id, ra, dec, (3455 + id % 5000) / 36525.0::DOUBLE AS t FROM catalog),
 a AS (SELECT *, 2 * pi() * (0.993133::DOUBLE + 99.997306::DOUBLE * t - floor(0.993133::DOUBLE + 99.997306::DOUBLE * t)) AS ls, 2 * pi() * (0.827362::DOUBLE + 1236.853087::DOUBLE * t - floor(0.827362::DOUBLE + 1236.853087::DOUBLE * t)) AS d, 2 * pi() * (0.259089::DOUBLE + 1342.227826::DOUBLE * t - floor(0.259089::DOUBLE + 1342.227826::DOUBLE * t)) AS f, 2 * pi() * (0.347346::DOUBLE - 5.372447::DOUBLE * t - floor(0.347346::DOUBLE - 5.372447::DOUBLE * t)) AS n, 0.4090928::DOUBLE - 2.2696e-4::DOUBLE * t AS eps FROM k),
 m AS (SELECT id, eps, cos(dec) * cos(ra) AS x, cos(dec) * sin(ra) AS y, sin(dec) AS z, (-17.2 * sin(n) - 1.319 * sin(2 * (f - d + n)) - 0.227 * sin(2 * (f + n)) + 0.206 * sin(2 * n) + 0.143 * sin(ls)) * {A} AS dp, (9.203 * cos(n) + 0.574 * cos(2 * (f - d + n)) + 0.098 * cos(2 * (f + n)) - 0.09 * cos(2 * n)) * {A} AS de FROM a),
 v AS (SELECT id, x - (dp * cos(eps) * y + dp * sin(eps) * z) AS x, y + (dp * cos(eps) * x - de * z) AS y, z + (dp * sin(eps) * x + de * y) AS z FROM m)
 SELECT id, round(fmod(atan2(y, x) + {TWO}, {TWO}), 6) AS ra, round(atan2(z, sqrt(x * x + y * y)), 6) AS dec FROM v""")
def nutation(spark, sf_dir):
    ra, dec = apparent.nutated(F.col("ra"), F.col("dec"), 2451545.0 + 3455 + F.col("id") % 5000)
    return views.catalog(spark, sf_dir).select("id", r6(ra, "ra"), r6(dec, "dec"))


#: Aberration by the Earth's velocity, precession from J2000, then nutation, as `nutation` has it.
APPARENT = f"""WITH {CATALOG}, j AS (SELECT id, ra, dec, 2455000.0::DOUBLE + id % 5000 AS jd, 2000 + (2455000.0::DOUBLE + id % 5000 - 2451544.5) / 365.25::DOUBLE AS y FROM catalog),
 d AS (SELECT id, ra, dec, (jd + CASE WHEN floor(y + 0.5) BETWEEN 2016 AND 2020 THEN 68.3 + (y - 2016) * 0.54::DOUBLE WHEN floor(y + 0.5) BETWEEN 2021 AND 2024 THEN 71 + (y - 2021) * 0.5 ELSE 60 END / 86400 - 2451545) / 36525.0::DOUBLE AS t FROM j),
 m AS (SELECT *, radians(357.52911::DOUBLE + 35999.05029::DOUBLE * t - 0.0001537::DOUBLE * t * t) AS m, 0.016708634::DOUBLE - 0.000042037::DOUBLE * t - 0.0000001267::DOUBLE * t * t AS e FROM d),
 c AS (SELECT *, radians((1.914602::DOUBLE - 0.004817::DOUBLE * t - 0.000014::DOUBLE * t * t) * sin(m) + (0.019993::DOUBLE - 0.000101::DOUBLE * t) * sin(2 * m) + 0.000289::DOUBLE * sin(3 * m)) AS c FROM m),
 l AS (SELECT *, m + c AS nu, 1.000001018::DOUBLE * (1 - e * e) / (1 + e * cos(m + c)) AS r, radians(280.46646::DOUBLE + 36000.76983::DOUBLE * t + 0.0003032::DOUBLE * t * t) + c + pi() - (5028.796195::DOUBLE * t + 1.1054348::DOUBLE * t * t) * {A} AS lon FROM c),
 n AS (SELECT *, radians(360.0::DOUBLE / 365.256363004::DOUBLE) * pow(1 + e * cos(nu), 2) / pow(1 - e * e, 1.5) AS w FROM l),
 v AS (SELECT *, r * e * sin(nu) * w / (1 + e * cos(nu)) AS dr FROM n),
 s AS (SELECT *, dr * cos(lon) - r * sin(lon) * w AS ux, dr * sin(lon) + r * cos(lon) * w AS uy FROM v),
 x AS (SELECT id, t, cos(dec) * cos(ra) + 0.00577552::DOUBLE * ux AS x, cos(dec) * sin(ra) + 0.00577552::DOUBLE * uy * cos({when.OBLIQUITY!r}::DOUBLE) AS y, sin(dec) + 0.00577552::DOUBLE * uy * sin({when.OBLIQUITY!r}::DOUBLE) AS z FROM s),
 ab AS (SELECT id, t, atan2(y, x) AS ra, atan2(z, sqrt(x * x + y * y)) AS dec, (2306.2181::DOUBLE * t + 0.30188::DOUBLE * t * t + 0.017998::DOUBLE * t * t * t) * {A} AS ze, (2306.2181::DOUBLE * t + 1.09468::DOUBLE * t * t + 0.018203::DOUBLE * t * t * t) * {A} AS z, (2004.3109::DOUBLE * t - 0.42665::DOUBLE * t * t - 0.041833::DOUBLE * t * t * t) * {A} AS th FROM x),
 pr AS (SELECT id, t, atan2(cos(dec) * sin(ra + ze), cos(th) * cos(dec) * cos(ra + ze) - sin(th) * sin(dec)) + z AS ra, asin(greatest(-1, least(1, sin(th) * cos(dec) * cos(ra + ze) + cos(th) * sin(dec)))) AS dec FROM ab),
 a AS (SELECT *, 2 * pi() * (0.993133::DOUBLE + 99.997306::DOUBLE * t - floor(0.993133::DOUBLE + 99.997306::DOUBLE * t)) AS ls, 2 * pi() * (0.827362::DOUBLE + 1236.853087::DOUBLE * t - floor(0.827362::DOUBLE + 1236.853087::DOUBLE * t)) AS d, 2 * pi() * (0.259089::DOUBLE + 1342.227826::DOUBLE * t - floor(0.259089::DOUBLE + 1342.227826::DOUBLE * t)) AS f, 2 * pi() * (0.347346::DOUBLE - 5.372447::DOUBLE * t - floor(0.347346::DOUBLE - 5.372447::DOUBLE * t)) AS n, 0.4090928::DOUBLE - 2.2696e-4::DOUBLE * t AS eps FROM pr),
 k AS (SELECT id, eps, cos(dec) * cos(ra) AS x, cos(dec) * sin(ra) AS y, sin(dec) AS z, (-17.2 * sin(n) - 1.319 * sin(2 * (f - d + n)) - 0.227 * sin(2 * (f + n)) + 0.206 * sin(2 * n) + 0.143 * sin(ls)) * {A} AS dp, (9.203 * cos(n) + 0.574 * cos(2 * (f - d + n)) + 0.098 * cos(2 * (f + n)) - 0.09 * cos(2 * n)) * {A} AS de FROM a),
 o AS (SELECT id, x - (dp * cos(eps) * y + dp * sin(eps) * z) AS x, y + (dp * cos(eps) * x - de * z) AS y, z + (dp * sin(eps) * x + de * y) AS z FROM k)
 SELECT id, round(fmod(fmod(atan2(y, x), {TWO}) + {TWO}, {TWO}), 6) AS ra, round(atan2(z, sqrt(x * x + y * y)), 6) AS dec FROM o"""


@query(APPARENT)
def apparent_place(spark, sf_dir):
    c = views.catalog(spark, sf_dir).withColumn("jd", 2455000.0 + F.col("id") % 5000)
    return apparent.with_apparent(c, "ra", "dec", "jd").select("id", r6("ra", "ra"), r6("dec", "dec"))


ALT = "(SELECT c_custkey AS id, c_custkey % 1700 / 20.0::DOUBLE + 0.5 AS alt FROM customer)"


@query(f"SELECT id, round(1010.0 / 1010.0 * 283.0 / 283.0 * (1.02 / 60.0::DOUBLE) / tan((alt + 10.3::DOUBLE / (alt + 5.11::DOUBLE)) * pi() / 180), 6) AS degrees FROM {ALT}")
def refraction(spark, sf_dir):
    k = F.col("c_custkey")
    return views.table(spark, sf_dir, "customer").select(k.alias("id"), r6(sky.refraction(k % 1700 / 20.0 + 0.5), "degrees"))


@query("WITH p AS (SELECT c_custkey AS id, 1 + c_custkey % 30 / 10.0::DOUBLE AS x, 0.5 + c_custkey % 7 / 5.0::DOUBLE AS y, 0.2::DOUBLE AS z FROM customer), d AS (SELECT id, sqrt(x * x + y * y + z * z) AS rs, sqrt(0.64::DOUBLE + 0.36::DOUBLE) AS re, sqrt((x - 0.8) * (x - 0.8) + (y + 0.6) * (y + 0.6) + z * z) AS rp FROM p) SELECT id, round(rs, 6) AS r_sun, round(rp, 6) AS r_earth, round(degrees(acos((rp * rp + re * re - rs * rs) / (2 * rp * re))), 6) AS elongation, round(50 * (1 + (rp * rp + rs * rs - re * re) / (2 * rp * rs)), 6) AS lit FROM d")
def illumination(spark, sf_dir):
    k = F.col("c_custkey")
    rs, rp, el, _, lit = light.illumination((1 + k % 30 / 10.0, 0.5 + k % 7 / 5.0, F.lit(0.2)), (F.lit(0.8), F.lit(-0.6), F.lit(0.0)))
    return views.table(spark, sf_dir, "customer").select(k.alias("id"), r6(rs, "r_sun"), r6(rp, "r_earth"), r6(el, "elongation"), r6(lit, "lit"))


@query("WITH c AS (SELECT p_partkey AS id, p_partkey % 250::DOUBLE AS r, p_partkey * 7 % 251::DOUBLE AS g, p_partkey * 13 % 253::DOUBLE AS b FROM part), k AS (SELECT *, r + g + b AS l, least(greatest(r, b) / greatest(least(r, b), 0.001), 30) AS k, r >= b AS red FROM c), s AS (SELECT *, CASE WHEN g > r AND g > b THEN l * k / (2 * k + 1) WHEN g < r AND g < b THEN l / (2 + k) END AS s, CASE WHEN g > r AND g > b THEN l / (2 * k + 1) WHEN g < r AND g < b THEN l * k / (2 + k) END AS w FROM k) SELECT id, round(coalesce(CASE WHEN red THEN s ELSE w END, r), 5) AS r, round(coalesce(s, g), 5) AS g, round(coalesce(CASE WHEN red THEN w ELSE s END, b), 5) AS b FROM s")
def green_purple_filter(spark, sf_dir):
    k = F.col("p_partkey")
    r, g, b = fields.green_purple((k % 250).cast("double"), (k * 7 % 251).cast("double"), (k * 13 % 253).cast("double"))
    return views.table(spark, sf_dir, "part").select(k.alias("id"), F.round(r, 5).alias("r"), F.round(g, 5).alias("g"), F.round(b, 5).alias("b"))


@query("WITH c AS (SELECT p_partkey AS id, p_partkey % 250::DOUBLE AS r, p_partkey * 7 % 251::DOUBLE AS g, p_partkey * 13 % 253::DOUBLE AS b FROM part) SELECT id, round(CASE WHEN b < 18 / 255.0::DOUBLE * r OR b > 255 / 173.0::DOUBLE * r THEN 1 WHEN r <= 1 OR g <= 1 OR b <= 1 THEN 0 ELSE abs(b / g - (0.6427::DOUBLE * (r / g) * (r / g) - 2.868::DOUBLE * (r / g) + 3.3035::DOUBLE)) END, 6) AS distance FROM c")
def spectrum_test(spark, sf_dir):
    k = F.col("p_partkey")
    return views.table(spark, sf_dir, "part").select(k.alias("id"), r6(fields.spectrum_distance((k % 250).cast("double"), (k * 7 % 251).cast("double"), (k * 13 % 253).cast("double")), "distance"))


@query("SELECT p_partkey AS id, ((66 * r + 129 * g + 25 * b + 128) >> 8) + 16 AS y, CAST(floor((-38 * r - 74 * g + 112 * b + 128) / 256.0) AS BIGINT) + 128 AS u, CAST(floor((112 * r - 94 * g - 18 * b + 128) / 256.0) AS BIGINT) + 128 AS v FROM (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b FROM part)")
def luma_chroma(spark, sf_dir):
    k = F.col("p_partkey")
    y, u, v = fields.luma(k % 256, k * 7 % 256, k * 13 % 256)
    return views.table(spark, sf_dir, "part").select(k.alias("id"), y.alias("y"), u.alias("u"), v.alias("v"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN m < 4 THEN -99 WHEN m > 15 THEN 99 WHEN m % 4 = 0 THEN 11 WHEN m % 4 = 1 THEN 13 WHEN m % 4 = 2 THEN 15 ELSE 99 END AS INTEGER) AS faintest, m < 8 AS periodic FROM (SELECT p_partkey, p_partkey % 20 AS m FROM part)")
def overlay_modes(spark, sf_dir):
    m = F.col("p_partkey") % 20
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fields.overlay_limit(m).alias("faintest"), fields.periodic_only(m).alias("periodic"))


@query(f"WITH {CATALOG} SELECT id, acos(greatest(-1, least(1, sin(dec) * sin(0.4::DOUBLE) + cos(dec) * cos(0.4::DOUBLE) * cos(ra - 1)))) >= 3000 * 0.01::DOUBLE * {PI} / 180 AS refetch FROM catalog")
def overlay_refetch(spark, sf_dir):
    sep = sky.ang_sep(F.col("ra"), F.col("dec"), F.lit(1.0), F.lit(0.4))
    return views.catalog(spark, sf_dir).select("id", fields.refetch(sep, F.lit(3000), F.lit(0.01)).alias("refetch"))


@query("SELECT p_partkey AS id, round(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE (CASE WHEN p_partkey % 3 = 0 THEN 1.5 ELSE 0.25 + p_partkey % 4 END) / (p_partkey % 5) END, 6) AS gain FROM part")
def unbinned_gain(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.when(k % 3 == 0, "unknown").otherwise((0.25 + k % 4).cast("string"))
    return views.table(spark, sf_dir, "part").select(k.alias("id"), r6(fields.unbinned_gain(t, (k % 5).cast("double"), 1.5), "gain"))


BANDS = ["V", "TG", "B", "TB", "R", "TR", "SG", "SR", "SI", "Ha"]


@query(f"SELECT p_partkey AS id, ({['V', 'V', 'B', 'B', 'R', 'R', 'SG', 'SR', 'SI', '?']!r})[p_partkey % 10 + 1] AS band FROM part")
def comparison_band(spark, sf_dir):
    f = F.element_at(F.array(*[F.lit(b) for b in BANDS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fields.observed_band(f).alias("band"))


@query("SELECT c_custkey AS id, 'region(box,' || printf('%.6f', c_custkey % 360 + 0.5) || 'd' || CASE WHEN c_custkey % 120 - 60 >= 0 THEN '%2B' ELSE '%2D' END || printf('%.6f', abs(c_custkey % 120 - 60)::DOUBLE) || 'd,+' || printf('%.4f', 3600.0) || 's+' || printf('%.4f', 2400.5) || 's)' AS query FROM customer")
def region_queries(spark, sf_dir):
    k = F.col("c_custkey")
    return views.table(spark, sf_dir, "customer").select(k.alias("id"), fields.region_query(k % 360 + 0.5, (k % 120 - 60).cast("double"), F.lit(3600.0), F.lit(2400.5)).alias("query"))


@query("WITH " + PX + " SELECT frame, CAST(sum(least(x, y, 39 - x, 39 - y) * v) AS BIGINT) AS weighted, CAST(sum(least(x, y, 39 - x, 39 - y)) AS BIGINT) AS weights FROM px GROUP BY frame")
def border_weights(spark, sf_dir):
    w = fields.border_weight(F.col("x"), F.col("y"), 40, 40)
    return views.px(spark, sf_dir).groupBy("frame").agg(F.sum(w * F.col("v")).alias("weighted"), F.sum(w).alias("weights"))


@query("SELECT p_partkey AS id, CASE WHEN d < 1 / 60.0::DOUBLE THEN CAST(floor(d * 3600 + 0.5)::BIGINT AS VARCHAR) || '\"' WHEN d < 1 THEN printf('%.2f', d * 60) || '''' ELSE printf('%.2f', d) || '°' END AS sep FROM (SELECT p_partkey, p_partkey * p_partkey / 65536.0::DOUBLE AS d FROM part)")
def separation_text(spark, sf_dir):
    k = F.col("p_partkey")
    return views.table(spark, sf_dir, "part").select(k.alias("id"), sky.separation_text(k * k / 65536.0).alias("sep"))


@query("SELECT p_partkey AS id, ('[J2000, date, galactic, horizontal]'::VARCHAR[])[p_partkey % 4 + 1] || ' ' || printf('%.4f', p_partkey % 360 + 0.25) || ' ' || printf('%.4f', p_partkey % 180 - 89.75) AS position FROM part")
def position_text(spark, sf_dir):
    k = F.col("p_partkey")
    return views.table(spark, sf_dir, "part").select(k.alias("id"), fields.position_text(k % 4, k % 360 + 0.25, k % 180 - 89.75).alias("position"))


@query("SELECT p_partkey AS id, printf('Solution[px] x:=%.6fx+ %.6fy+ %.6f,  y:=%.6fx+ %.6fy+ %.6f', 1.0::DOUBLE, p_partkey % 8 / 8.0::DOUBLE, p_partkey + 0.5::DOUBLE, 0.25::DOUBLE, 1.0::DOUBLE, -p_partkey / 4.0::DOUBLE) AS solution FROM part")
def solution_text(spark, sf_dir):
    k = F.col("p_partkey")
    return views.table(spark, sf_dir, "part").select(k.alias("id"), fields.solution_text(F.lit(1.0), k % 8 / 8.0, k + 0.5, F.lit(0.25), F.lit(1.0), -k / 4.0).alias("solution"))


@query("WITH " + LC + ", p AS (SELECT star, 100 + v % 50 AS hfd, 100 + v % 41 AS model FROM lc) SELECT star, round(avg(CASE WHEN model > hfd THEN model / hfd::DOUBLE - 1 ELSE hfd / model::DOUBLE - 1 END), 6) AS error FROM p GROUP BY star")
def hyperbola_error(spark, sf_dir):
    p = views.lc(spark, sf_dir).select("star", (100 + F.col("v") % 50).alias("hfd"), (100 + F.col("v") % 41).alias("model"))
    return fit.hyperbola_error(p, ["star"]).select("star", r6("error", "error"))


@query("SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM range(-200, 201, 50) a(x), range(-200, 201, 50) b(y)")
def grid_points(spark, sf_dir):
    """Points of a centred grid."""
    steps = F.sequence(F.lit(-200).cast("long"), F.lit(200).cast("long"), F.lit(50).cast("long"))
    return spark.range(1).select(F.explode(steps).alias("x")).select("x", F.explode(steps).alias("y"))


@query("WITH v AS (SELECT c_nationkey AS strip, c_custkey AS pos, c_custkey * 37 % 500 - 50 AS x, c_custkey * 53 % 500 - 50 AS y FROM customer), l AS (SELECT strip, pos, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM v WINDOW w AS (PARTITION BY strip ORDER BY pos)) SELECT strip, pos, x0, y0, x, y FROM l WHERE x0 IS NOT NULL AND ((x BETWEEN 0 AND 400 AND y BETWEEN 0 AND 400) OR (x0 BETWEEN 0 AND 400 AND y0 BETWEEN 0 AND 400))")
def constellation_lines(spark, sf_dir):
    """Consecutive vertices of a strip as segments, if either end is in the frame."""
    k = F.col("c_custkey")
    v = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("strip"), k.alias("pos"), (k * 37 % 500 - 50).alias("x"), (k * 53 % 500 - 50).alias("y"))
    w = Window.partitionBy("strip").orderBy("pos")
    inside = lambda a, b: F.col(a).between(0, 400) & F.col(b).between(0, 400)
    return v.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w)}).filter(F.col("x0").isNotNull() & (inside("x", "y") | inside("x0", "y0"))).select("strip", "pos", "x0", "y0", "x", "y")


@query(f"WITH {CATALOG}, s AS (SELECT id, mag, floor(ra * 8 / {TWO}) AS tile FROM catalog) SELECT CAST(tile AS BIGINT) AS tile, id FROM s QUALIFY row_number() OVER (PARTITION BY tile ORDER BY mag, id) <= 5")
def tile_quota(spark, sf_dir):
    """The brightest stars of each tile, up to its quota."""
    c = views.catalog(spark, sf_dir).withColumn("tile", F.floor(F.col("ra") * 8 / sky.TWO_PI))
    w = Window.partitionBy("tile").orderBy("mag", "id")
    return c.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("tile", "id")


@query("SELECT p_partkey AS id, round(abs(0.5 * (p_partkey % 100) - (p_partkey % 37) + 3) / sqrt(1.25::DOUBLE), 6) AS distance FROM part")
def line_distance(spark, sf_dir):
    k = F.col("p_partkey")
    return views.table(spark, sf_dir, "part").select(k.alias("id"), r6(sky.line_distance(k % 100, k % 37, F.lit(0.5), F.lit(3.0)), "distance"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey / 8.0::DOUBLE WHEN c_custkey % 3 = 1 THEN c_custkey + 0.5::DOUBLE ELSE -1 END AS value FROM customer")
def tolerant_numbers(spark, sf_dir):
    k = F.col("c_custkey")
    t = F.when(k % 3 == 0, (k / 8.0).cast("string")).when(k % 3 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(",5"))).otherwise("n/a")
    return views.table(spark, sf_dir, "customer").select(k.alias("id"), text.tolerant_number(t, -1.0).alias("value"))


SIP = ({(0, 2): 2e-6, (1, 1): -3e-6, (2, 0): 4e-6, (3, 0): 1e-9}, {(0, 2): -5e-6, (1, 1): 1e-6, (2, 0): 2e-6, (0, 3): -2e-9})
INVERSE = ({(0, 0): 0.125, (0, 2): -2e-6, (1, 1): 3e-6, (2, 0): -4e-6, (1, 2): 1e-9}, {(0, 1): 1e-4, (0, 2): 5e-6, (1, 1): -1e-6, (2, 0): -2e-6, (2, 1): 2e-9})


def _sip_sql(terms: dict) -> str:
    return " + ".join(f"({f!r}::DOUBLE)" + " * u" * i + " * v" * j for (i, j), f in terms.items())


@query(NEAR + f", p AS (SELECT id, cos(dec) * sin(ra - 1) / d * {180 / sky.PI!r}::DOUBLE AS xi, (sin(dec) * cos(0.5::DOUBLE) - cos(dec) * sin(0.5::DOUBLE) * cos(ra - 1)) / d * {180 / sky.PI!r}::DOUBLE AS eta FROM s WHERE d > 0.9), q AS (SELECT id, (0.01::DOUBLE * xi - 0.001::DOUBLE * eta) / -0.000101::DOUBLE AS u, (-0.01::DOUBLE * eta - 0.001::DOUBLE * xi) / -0.000101::DOUBLE AS v FROM p) SELECT id, round(1000.5::DOUBLE + u + {_sip_sql(INVERSE[0])}, 4) AS px_x, round(1000.5::DOUBLE + v + {_sip_sql(INVERSE[1])}, 4) AS px_y FROM q")
def wcs_sip_forward(spark, sf_dir):
    """Catalogue positions about the frame's centre to pixels, with the inverse distortion."""
    c = views.catalog(spark, sf_dir)
    d = F.sin("dec") * F.sin(F.lit(0.5)) + F.cos("dec") * F.cos(F.lit(0.5)) * F.cos(F.col("ra") - 1)
    x, y = sky.to_pixel(F.col("ra"), F.col("dec"), WCS | {"sip_inverse": INVERSE})
    return c.filter(d > 0.9).select("id", F.round(x, 4).alias("px_x"), F.round(y, 4).alias("px_y"))


@query(f"WITH p AS (SELECT p_partkey AS id, p_partkey % 2000 + 0.25::DOUBLE - 1000.5 AS u, p_partkey * 7 % 2000 + 0.75::DOUBLE - 1000.5 AS v FROM part), q AS (SELECT id, u + {_sip_sql(SIP[0])} AS u, v + {_sip_sql(SIP[1])} AS v FROM p), w AS (SELECT id, (-0.01::DOUBLE * u + 0.001::DOUBLE * v) * {D2R} AS xi, (0.001::DOUBLE * u + 0.01::DOUBLE * v) * {D2R} AS eta FROM q), z AS (SELECT id, xi, eta, cos(0.5::DOUBLE) - eta * sin(0.5::DOUBLE) AS d FROM w) SELECT id, round(fmod(fmod(1 + atan2(xi, d), {TWO}) + {TWO}, {TWO}), 6) AS ra, round(atan2(sin(0.5::DOUBLE) + eta * cos(0.5::DOUBLE), sqrt(xi * xi + d * d)), 6) AS dec FROM z")
def wcs_sip_inverse(spark, sf_dir):
    """Pixels to positions, with the distortion."""
    k = F.col("p_partkey")
    ra, dec = sky.to_sky(k % 2000 + 0.25, k * 7 % 2000 + 0.75, WCS | {"sip": SIP})
    return views.table(spark, sf_dir, "part").select(k.alias("id"), r6(ra, "ra"), r6(dec, "dec"))


@query("WITH " + PX + ", n AS (SELECT a.frame, a.x, a.y, b.v, row_number() OVER (PARTITION BY a.frame, a.x, a.y ORDER BY b.v) AS k, count(b.v) OVER (PARTITION BY a.frame, a.x, a.y) AS n FROM px a LEFT JOIN px b ON a.frame = b.frame AND b.v <> 0 AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2) SELECT frame, x, y, coalesce(v, 0) AS background FROM n WHERE k = n // 2 + 1")
def px_box_median(spark, sf_dir):
    """The background about each pixel; a box of four places is taken as one of five."""
    return pixels.box_median(views.px(spark, sf_dir), 4)


@query("WITH " + PX + ", p AS (SELECT frame, (y - 20) * 2 + x % 2 AS place, v FROM px WHERE y BETWEEN 20 AND 21), r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY frame, place) AS n FROM p WINDOW w AS (PARTITION BY frame, place ORDER BY v)), m AS (SELECT frame, place, sum(v)::DOUBLE / count(*) AS median FROM r WHERE CASE WHEN n % 2 = 0 THEN k IN (n // 2, n // 2 + 1) WHEN n >= 5 THEN k BETWEEN n // 2 AND n // 2 + 2 ELSE k = n // 2 + 1 END GROUP BY 1, 2) SELECT frame, max(median) - min(median) > 100 AS mosaic FROM m GROUP BY 1")
def px_is_mosaic(spark, sf_dir):
    return pixels.is_mosaic(views.px(spark, sf_dir), views.WIDTH, views.HEIGHT)
