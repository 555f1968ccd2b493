"""Parsers of catalogue lines and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions import light


def _packed(c: Column) -> Column:
    """0-9, then A = 10 and so on."""
    return F.when(F.ascii(c) < 65, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)


def minor_planets(lines: DataFrame) -> DataFrame:
    """text of fixed width: designation, name, H, G, epoch and elements. Lines under 195 characters, or of another
    century than 19, 20 or 21, have none."""
    part = lambda a, n: F.substring("text", a, n)
    num = lambda a, n: F.coalesce(F.trim(part(a, n)).try_cast("double"), F.lit(0.0))
    century = _packed(part(21, 1))
    ok = lines.filter((F.length("text") >= 195) & century.between(19, 21))
    return ok.select(
        F.rtrim(part(1, 7)).alias("designation"), F.trim(part(167, 28)).alias("name"), num(8, 5).alias("h"), num(14, 6).alias("g"),
        (century * 100 + F.coalesce(part(22, 2).try_cast("int"), F.lit(0))).cast("long").alias("year"), _packed(part(24, 1)).cast("long").alias("month"), _packed(part(25, 1)).cast("double").alias("day"),
        num(27, 9).alias("anomaly"), num(38, 9).alias("perihelion"), num(49, 9).alias("node"), num(60, 9).alias("inclination"), num(71, 9).alias("eccentricity"), num(93, 11).alias("axis"),
    )


def comets(lines: DataFrame) -> DataFrame:
    """text of fixed width: perihelion date, distance and elements. Years outside 1901..2199 have none."""
    part = lambda a, n: F.substring("text", a, n)
    num = lambda a, n: F.coalesce(F.trim(part(a, n)).try_cast("double"), F.lit(0.0))
    year = F.trim(part(15, 4)).try_cast("int")
    ok = lines.filter((year > 1900) & (year < 2200))
    return ok.select(F.trim(part(103, 56)).alias("name"), year.cast("long").alias("year"), F.trim(part(20, 2)).try_cast("long").alias("month"), num(23, 7).alias("day"), num(31, 9).alias("distance"), num(42, 8).alias("eccentricity"), num(52, 8).alias("perihelion"), num(62, 8).alias("node"), num(72, 8).alias("inclination"), num(92, 4).alias("h"), (2.5 * num(97, 4)).alias("k"))


VARIABLES = "VSXObjects struct<VSXObject:array<struct<Name:string,AUID:string,RA2000:string,Declination2000:string,MaxMag:string,MinMag:string,Period:string,Epoch:string,Category:string,ProperMotionRA:string,ProperMotionDec:string>>>"


def variables(replies: DataFrame, periodic_only: bool = False) -> DataFrame:
    """text: replies in JSON -> a row for each variable. With periodic_only, periods of 0 or of 3 days and more go."""
    v = replies.select(F.explode(F.from_json("text", VARIABLES)["VSXObjects"]["VSXObject"]).alias("v"))
    num = lambda c: F.coalesce(F.col(f"v.{c}").try_cast("double"), F.lit(0.0))
    out = v.select(F.col("v.Name").alias("name"), num("RA2000").alias("ra_deg"), num("Declination2000").alias("dec_deg"), F.col("v.MaxMag").alias("max_mag"), F.col("v.MinMag").alias("min_mag"), num("Period").alias("period"), F.substring("v.Category", 1, 3).alias("category"))
    return out.filter((F.col("period") > 0) & (F.col("period") < 3)) if periodic_only else out


COMPARISONS = "photometry array<struct<auid:string,ra:string,dec:string,label:string,bands:array<struct<band:string,mag:double,error:double>>>>"


def comparisons(replies: DataFrame) -> DataFrame:
    """text: replies in JSON -> a row for each star and band."""
    star = replies.select(F.explode(F.from_json("text", COMPARISONS)["photometry"]).alias("s"))
    return star.select(F.col("s.auid").alias("auid"), F.col("s.ra").alias("ra"), F.col("s.dec").alias("dec"), F.explode("s.bands").alias("b")).select("auid", "ra", "dec", F.col("b.band").alias("band"), F.col("b.mag").alias("mag"), F.col("b.error").alias("error"))


def objects(lines: DataFrame) -> DataFrame:
    """text parted by bars, lines of 130 characters and more: identifier, type, coordinates, magnitudes B and V."""
    f = lambda k: F.trim(F.get(F.split("text", r"\|"), F.lit(k)))
    rows = lines.filter(F.length("text") >= 130)
    return rows.select(f(1).alias("name"), f(2).alias("kind"), f(3).alias("position"), f(5).try_cast("double").alias("b"), f(6).try_cast("double").alias("v")).filter(F.coalesce(F.col("name"), F.lit("")) != "")


def deep_sky(lines: DataFrame) -> DataFrame:
    """text: RA in tenths of a second, declination in arc seconds, names by slashes, length and width in tenths of an arc
    minute, position angle -> radians, names, arc minutes."""
    f = lambda k: F.trim(F.get(F.split("text", ","), F.lit(k)))
    num = lambda k: f(k).try_cast("double")
    rows = lines.select((num(0) * (3.141592653589793 / 432000)).alias("ra"), (num(1) * (3.141592653589793 / 648000)).alias("dec"), F.slice(F.split(f(2), "/"), 1, 3).alias("names"), (num(3) * 0.1).alias("length"), (num(4) * 0.1).alias("width"), num(5).alias("angle"))
    return rows.filter(F.col("ra").isNotNull() & F.col("dec").isNotNull())


def by_alias(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """catalog (pos, names), wanted (name): the first row one of whose names is the name, in whatever case."""
    named = catalog.select("pos", F.explode(F.array_distinct(F.transform("names", lambda n: F.upper(n)))).alias("key"))
    return wanted.withColumn("key", F.upper("name")).join(named, "key").groupBy("name").agg(F.min("pos").alias("pos"))


#: Fixed values of replies in text: lines before a table, what its heading starts with, units of a turn and of a right angle.
PREAMBLE, HEADING, RA_UNITS, DEC_UNITS = 35, "RA_ICRS", 864000, 324000


def table_lines(lines: DataFrame) -> DataFrame:
    """lines (reply, pos, text) of replies that hold a table after a preamble: the lines under its heading and rule, with
    n, the number of the reply's lines. Replies are told by their headings' places, a row for each, so a reply of very many
    lines is no single task's. A reply without a heading has no table; lines counts from 0."""
    heads = lines.groupBy("reply").agg(F.min(F.when((F.col("pos") >= PREAMBLE) & F.startswith("text", F.lit(HEADING)), F.col("pos"))).alias("head"), (F.max("pos") + 1).alias("n"))
    return lines.join(heads, "reply").filter(F.col("pos") > F.col("head") + 1).drop("head")


def _fields(text: Column) -> list[Column]:
    """Five columns parted by blanks; after a blank at least two characters belong to the next one, so that two blanks part
    no empty column."""
    first, other = "([^ ]*) ", "(.{2}[^ ]*)"
    part = lambda k: F.regexp_extract(text, f"^{first}{other} {other}(?: {other})?(?: (.*))?$", k)
    return [F.coalesce(F.trim(part(k)).try_cast("double"), F.lit(0.0)) for k in range(1, 6)]


#: A line with its first three columns.
WHOLE = "^[^ ]* .{2}[^ ]* .{2}[^ ]* "


def gaia_stars(lines: DataFrame, band: str = "BP") -> DataFrame:
    """lines (reply, pos, text) of replies in text: right ascension and declination in radians, the magnitudes G, BP and RP
    (0 where there is none) and mag, that of a band (0 where it isn't defined). Lines start with a digit; the last two of a
    reply are its foot."""
    ok = table_lines(lines).filter((F.col("pos") < F.col("n") - 2) & F.rlike("text", F.lit(r"^[0-9]")) & F.rlike("text", F.lit(WHOLE)))
    ra, dec, g, bp, rp = _fields(F.col("text"))
    out = ok.select("reply", "pos", F.radians(ra).alias("ra"), F.radians(dec).alias("dec"), g.alias("g"), bp.alias("bp"), rp.alias("rp"))
    return out.withColumn("mag", light.gaia_magnitude(band, F.col("g"), F.col("bp"), F.col("rp")))


def vizier_stars(lines: DataFrame, band: str | None = None) -> DataFrame:
    """lines (reply, pos, text) of replies in text: places in whole units, and the magnitude of a band (G without one);
    stars of magnitude 0 go. Lines have over ten characters."""
    ok = table_lines(lines).filter((F.length("text") > 10) & F.rlike("text", F.lit(WHOLE)))
    ok = ok.select("reply", "pos", *[c.alias(n) for c, n in zip(_fields(F.col("text")), ("ra", "dec", "g", "bp", "rp"), strict=True)])
    units = lambda c, whole: (F.signum(c) * F.floor(F.abs(F.col(c) * whole) + 0.5)).cast("long")
    mag = light.gaia_magnitude(band, F.col("g"), F.col("bp"), F.col("rp")) if band else F.col("g")
    return ok.select("reply", "pos", units("ra", RA_UNITS / 360.0).alias("ra_units"), units("dec", DEC_UNITS / 90.0).alias("dec_units"), mag.alias("mag")).filter("mag <> 0")
