"""Wide-field star lists as a Spark data source: files of one count and fixed records, split by byte ranges.

    spark.dataSource.register(WideField)
    spark.read.format("wide_field").load("hdfs://.../stars").filter("mag < 8")

A file holds the number of its stars (32 bits) and for each a record of three floats: ten times the magnitude, right ascension and
declination in radians, the brightest first. A partition is a range of at most RECORDS records, so a file of any size is read by
many tasks. Since stars stand by magnitude, a range ends at the first star fainter than the filters on `mag` (or the option
max_mag) allow; a range whose first star is fainter is not read on.

Columns: file, ra, dec (radians), mag. A file without stars gives no rows; one that is shorter than its count says is an error, and
so is a folder without files. path is a file or a folder of files that end with SUFFIX."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = "file string, ra double, dec double, mag double"
SUFFIX = "_0101.001"
HEAD, RECORD = 4, np.dtype("<f4").itemsize * 3
RECORDS = 1 << 20
PIECE = 1 << 16


def _store(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), path)


@dataclass
class Range(ds.InputPartition):
    path: str
    first: int
    records: int


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.most = float(options.get("max_mag", "inf"))
        self.size = int(options.get("records", RECORDS))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Filters go back to Spark as well: stars of a range are read up to the magnitude kept here."""
        for f in filters:
            if isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)) and f.attribute == ("mag",):
                self.most = min(self.most, f.value)
            yield f

    def partitions(self) -> list[ds.InputPartition]:
        store, at = _store(self.root)
        here = store.get_file_info(at)
        files = [here] if here.type == afs.FileType.File else [f for f in store.get_file_info(afs.FileSelector(at)) if f.path.endswith(SUFFIX)]
        if not files:
            raise FileNotFoundError(f"no wide-field stars in {self.root}")
        out = []
        for f in sorted(files, key=lambda f: f.path):
            path = self.root if f.path == here.path else f"{self.root}/{f.path.rsplit('/', 1)[-1]}"
            with store.open_input_file(f.path) as file:
                n = int(np.frombuffer(file.read(HEAD), "<i4")[0])
            if f.size < HEAD + n * RECORD:
                raise ValueError(f"{path} has {f.size} bytes for {n} stars")
            out += [Range(path, k, min(self.size, n - k)) for k in range(0, max(n, 0), self.size)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.records:
            return
        store, at = _store(partition.path)
        name = partition.path.rsplit("/", 1)[-1]
        with store.open_input_file(at) as file:
            for k in range(0, partition.records, PIECE):
                file.seek(HEAD + (partition.first + k) * RECORD)
                stars = np.frombuffer(file.read(min(PIECE, partition.records - k) * RECORD), "<f4").reshape(-1, 3).astype(float)
                mag = stars[:, 0] / 10
                n = int(np.searchsorted(mag, self.most, side="right"))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(stars[:n, 1]), pa.array(stars[:n, 2]), pa.array(mag[:n])], names=["file", "ra", "dec", "mag"])
                if n < len(mag):
                    return


class WideField(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "wide_field"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The source, registered, with its filters pushed down."""
    spark.dataSource.register(WideField)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("wide_field").options(**{k: str(v) for k, v in options.items()}).load(path)


def write(stars: DataFrame, path: str, name: str = "stars") -> DataFrame:
    """stars (ra, dec, mag) as wide-field files below path, a row (file, stars, bytes) for each. They are sorted by
    magnitude in ranges, a file for each; a file is written aside and renamed, so a task that runs again leaves the same one."""
    import pandas as pd

    ordered = stars.select(F.col("mag").cast("double"), F.col("ra").cast("double"), F.col("dec").cast("double")).na.drop()
    ordered = ordered.repartitionByRange("mag").sortWithinPartitions("mag", "ra", "dec").withColumn("part", F.spark_partition_id())

    def save(batches):
        store, root = _store(path)
        file = None
        count = 0
        for pdf in batches:
            if not len(pdf):
                continue
            if file is None:
                to = f"{name}-{int(pdf['part'].iloc[0]):05d}{SUFFIX}"
                store.create_dir(root, recursive=True)
                file = store.open_output_stream(f"{root}/.{to}.body")
            record = pdf[["mag", "ra", "dec"]].to_numpy(float)
            record[:, 0] = np.floor(record[:, 0] * 10 + 0.5)
            file.write(record.astype("<f4").tobytes())
            count += len(pdf)
        if file is None:
            return
        file.close()
        with store.open_output_stream(f"{root}/.{to}.part") as whole, store.open_input_stream(f"{root}/.{to}.body") as body:
            whole.write(np.array([count], "<i4").tobytes())  # the number stands first and is known last
            while piece := body.read(1 << 20):
                whole.write(piece)
        store.delete_file(f"{root}/.{to}.body")
        store.move(f"{root}/.{to}.part", f"{root}/{to}")
        yield pd.DataFrame([(to, count, HEAD + count * RECORD)], columns=["file", "stars", "bytes"])

    return ordered.mapInPandas(save, "file string, stars long, bytes long")
