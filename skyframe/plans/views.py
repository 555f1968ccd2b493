"""Deterministic views of the supplied tables as pixels, stars, catalogues and light curves, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions.sky import PI

WIDTH = HEIGHT = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames of 40 x 40 pixels; levels in whole numbers."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("frame"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_orderkey") % 40).alias("y"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    return li.groupBy("frame", "x", "y").agg(F.expr("sum(c) div count(*)").alias("v"))


PX = "px AS (SELECT l_suppkey % 8 AS frame, l_partkey % 40 AS x, l_orderkey % 40 AS y, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // count(*) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3)"


def px_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with fewer levels (1..), so that they repeat."""
    return px(spark, sf_dir).withColumn("v", F.expr("v div 40000 + 1"))


PXL = PX + ", pl AS (SELECT frame, x, y, v // 40000 + 1 AS v FROM px)"


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.get("embedding", F.lit(0)).cast("double") * 1000).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 1000).alias("y"), F.abs(F.get("embedding", F.lit(2)).cast("double") * 1000).alias("snr"), F.col("label").cast("long").alias("label"))


STARS = "stars AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, abs(CAST(embedding[3] AS DOUBLE) * 1000) AS snr, CAST(label AS BIGINT) AS label FROM embeddings)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in radians, a magnitude and a colour."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("id"), (F.pmod(k * 137.508, F.lit(360.0)) * (PI / 180)).alias("ra"), ((k * 7919 % 17801 - 8900) / 100.0 * (PI / 180)).alias("dec"), (6 + k % 1000 / 100.0).alias("mag"), (k % 97 / 20.0 - 0.4).alias("colour"))


CATALOG = f"catalog AS (SELECT c_custkey AS id, fmod(c_custkey * 137.508::DOUBLE, 360.0::DOUBLE) * {PI / 180!r}::DOUBLE AS ra, (c_custkey * 7919 % 17801 - 8900) / 100.0::DOUBLE * {PI / 180!r}::DOUBLE AS dec, 6 + c_custkey % 1000 / 100.0::DOUBLE AS mag, c_custkey % 97 / 20.0::DOUBLE - 0.4::DOUBLE AS colour FROM customer)"


def lc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light curves: star, time, magnitude in hundredths."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("star"), F.col("ts").cast("timestamp").alias("t"), F.round(F.col("value") * 100).cast("long").alias("v"))


LC = "lc AS (SELECT event_id, user_id AS star, ts AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with an object, an exposure and a temperature."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pre = F.when(k % 6 == 0, "NGC ").when(k % 6 == 1, "ic").when(k % 6 == 2, "Sh2-").when(k % 6 == 3, "M").when(k % 6 == 4, "dark_").otherwise("ugc")
    exp = F.when(k % 5 == 0, F.concat((k % 600).cast("string"), F.lit("s_"))).when(k % 5 == 1, F.concat((k % 600).cast("string"), F.lit(" sec"))).when(k % 5 == 2, F.concat(F.lit("_"), (k % 600).cast("string"), F.lit("sec"))).otherwise("")
    ext = F.when(k % 4 == 0, ".fits").when(k % 4 == 1, ".TIF").when(k % 4 == 2, ".cr2").otherwise(".png")
    return p.select(k.alias("id"), F.concat(F.lit("/data/night/"), pre, (k % 7000).cast("string"), F.lit("_"), exp, F.lit("_"), F.when(k % 3 == 0, F.concat((k % 35 - 20).cast("string"), F.lit("C"))).otherwise(""), ext).alias("path"))


NAMES = """names AS (SELECT p_partkey AS id, '/data/night/' || CASE p_partkey % 6 WHEN 0 THEN 'NGC ' WHEN 1 THEN 'ic' WHEN 2 THEN 'Sh2-' WHEN 3 THEN 'M' WHEN 4 THEN 'dark_' ELSE 'ugc' END || (p_partkey % 7000) || '_'
 || CASE p_partkey % 5 WHEN 0 THEN (p_partkey % 600) || 's_' WHEN 1 THEN (p_partkey % 600) || ' sec' WHEN 2 THEN '_' || (p_partkey % 600) || 'sec' ELSE '' END || '_' || CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 35 - 20) || 'C' ELSE '' END
 || CASE p_partkey % 4 WHEN 0 THEN '.fits' WHEN 1 THEN '.TIF' WHEN 2 THEN '.cr2' ELSE '.png' END AS path FROM part)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header cards of files: eight for each order."""
    o = table(spark, sf_dir, "orders")
    pos = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("pos")
    o = o.select(F.col("o_orderkey").alias("file"), "o_totalprice", pos)
    key = F.element_at(F.array(*[F.lit(x) for x in CARD_KEYS]), (F.col("pos") + 1).cast("int"))
    return o.select("file", "pos", key.alias("key"), F.concat(key, F.lit("= "), (F.col("file") * (F.col("pos") + 3) % 1000).cast("string"), F.lit(" / note "), F.col("pos").cast("string")).alias("text"))


CARD_KEYS = ["NAXIS1", "NAXIS2", "CRPIX1", "CRPIX2", "CD1_1", "CD2_2", "EXPTIME", "OBJECT"]
CARDS = f"cards AS (SELECT o_orderkey AS file, pos, key, key || '= ' || (o_orderkey * (pos + 3) % 1000) || ' / note ' || pos AS text FROM (SELECT o_orderkey, pos, ({CARD_KEYS!r})[pos + 1] AS key FROM orders, range(8) t(pos)))"
