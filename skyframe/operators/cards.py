"""Header cards: (file, pos, key, text), pos in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upserted(cards: DataFrame, new: DataFrame) -> DataFrame:
    """new (file, key, text; a key once for each file): replaces the first card of a key where it stands; keys that a file
    lacks go to its end, by name."""
    placed = new.join(cards.groupBy("file", "key").agg(F.min("pos").alias("at")), ["file", "key"], "left")
    there = placed.filter("at is not null").select("file", F.col("at").alias("pos"), F.col("text").alias("n"))
    old = cards.join(there, ["file", "pos"], "left").select("file", "pos", "key", F.coalesce("n", "text").alias("text"))
    last = cards.groupBy("file").agg(F.max("pos").alias("last"))
    fresh = placed.filter("at is null").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("key")))
    return old.unionByName(fresh.join(last, "file").select("file", (F.col("last") + F.col("k")).alias("pos"), "key", "text"))


def removed(cards: DataFrame, prefixes: list[str]) -> DataFrame:
    gone = F.lit(False)
    for p in prefixes:
        gone = gone | F.startswith("key", F.lit(p))
    return cards.filter(~gone)


def wrapped(df: DataFrame, text: Column, width: int, prefix: str) -> DataFrame:
    """A long text as cards of at most `width` characters: (all columns, part from 0, card)."""
    n = F.greatest(F.ceil(F.length(text) / width), F.lit(1)).cast("int")
    return df.select("*", F.posexplode(F.sequence(F.lit(1), n)).alias("part", "__k")).withColumn("card", F.concat(F.lit(prefix), F.substring(text, (F.col("__k") - 1) * width + 1, F.lit(width)))).drop("__k")


def value_of(card: Column) -> Column:
    """The value of a KEY = value / comment card, without quotes."""
    body = F.regexp_extract(card, r"^[^=]{1,8}= *('(?:[^']|'')*'|[^/]*)", 1)
    return F.trim(F.regexp_replace(body, "^'|'$", ""))


def scale_rotation(cd11: Column, cd12: Column, cd21: Column, cd22: Column) -> tuple[Column, Column, Column]:
    """Pixel scales and rotation (degrees) of a CD matrix; the determinant's sign goes to the first scale."""
    flip = F.when(cd11 * cd22 - cd12 * cd21 < 0, -1.0).otherwise(1.0)
    return flip * F.sqrt(cd11 * cd11 + cd21 * cd21), F.sqrt(cd12 * cd12 + cd22 * cd22), F.degrees(F.atan2(-cd12, cd22))


def matrix(cdelt1: Column, cdelt2: Column, rotation_deg: Column) -> tuple[Column, Column, Column, Column]:
    c, s = F.cos(F.radians(rotation_deg)), F.sin(F.radians(rotation_deg))
    return cdelt1 * c, -cdelt2 * s, cdelt1 * s, cdelt2 * c
