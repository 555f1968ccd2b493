"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at if "://" in at else f"file://{at}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: it is computed once, and lost executors don't take it away."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 200) -> None:
    """Long texts: few rows in an Arrow batch, so that a Python worker's memory is bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def id_text(name: str) -> Column:
    """An id as text, for Python workers: pandas would round large ids of a batch that holds a null."""
    return F.col(name).cast("long").cast("string").alias(name)


def with_long(df: DataFrame, *names: str) -> DataFrame:
    """Ids that are text back to numbers."""
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, chunk: int = 256) -> Column:
    """What step(state, item) -> state, array of `kind` emits over an array, state by state. Emissions are gathered chunk
    by chunk: an accumulator is copied at each step, so it holds no more than a chunk."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def one(acc: Column, item: Column) -> Column:
        state, new = step(acc["s"], item)
        return F.struct(state.alias("s"), F.concat(acc["out"], new).alias("out"))

    def over(whole: Column) -> Column:
        begin = F.struct(start.alias("s"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("all"))

        def part(acc: Column, at: Column) -> Column:
            places = upto(at, F.least(at + chunk, F.size(whole)))
            more = lambda a: F.struct(a["s"].alias("s"), F.concat(acc["all"], F.array(a["out"])).alias("all"))
            return F.aggregate(places, F.struct(acc["s"].alias("s"), none.alias("out")), lambda a, i: one(a, F.get(whole, i)), more)

        return F.aggregate(upto(F.lit(0), F.size(whole), chunk), begin, part, lambda acc: F.flatten(acc["all"]))

    return bound(items, over)


def upto(begin: Column, end: Column, step: int = 1) -> Column:
    """begin, begin + step ... below end."""
    return F.when(begin < end, F.sequence(begin, end - 1, F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), for which value is made once; as a plain column it might be made anew for each item of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
