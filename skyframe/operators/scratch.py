"""Intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def path_for(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where the setting is unset a local folder serves, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root if '://' in root else f'file://{root}'}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written below spark.checkpoint.dir and read again: it is computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = path_for(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
