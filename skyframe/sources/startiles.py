"""Star catalogues in sky tiles, a file for each tile, as a Spark data source.

    spark.dataSource.register(StarTiles)
    spark.read.format("star_tiles").load("hdfs://.../catalogue").filter("mag < 12 and dec > 0.5")

A partition is one tile, so that only tiles which can hold wanted stars are opened: those at the corners of a field
(options ra, dec, field in radians), those that filters on `tile`, `dec` and `ra` leave, and of these the ones that exist. Stars of a
tile stand by magnitude; reading ends at the first one fainter than the filters on `mag` (or the option max_mag) allow.
Files are read in pieces of RECORDS stars.

Options: scheme (290 or 1476, by default what the files' names end with), name (the first part of the files' names,
where a folder holds several catalogues). Columns: tile, ra, dec (radians), mag, colour (null where the files have none).
An absent tile has no stars; a folder without tiles is an error."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from skyframe.functions.tiles import TWO_PI, WIDEST, scheme, tile, tile_file
from skyframe.sources import codecs

SCHEMA = "tile int, ra double, dec double, mag double, colour double"
RECORDS = 1 << 16
DESCRIPTION = 110
HEAD = 0xFFFFFF  # the right ascension of a record that sets magnitude and high declination byte


def bounds_of(number: int, n: int) -> tuple[float, float, float, float]:
    """Least and largest right ascension and declination of a tile."""
    cells, edge = scheme(n)
    first = list(accumulate([0, *cells]))
    ring = next(r for r in range(len(cells)) if number <= first[r + 1])
    wide = TWO_PI / cells[ring]
    return (number - first[ring] - 1) * wide, (number - first[ring]) * wide, edge[ring], edge[ring + 1]


def tiles_at_corners(ra: float, dec: float, field: float, n: int) -> set[int]:
    """The tiles at the corners of a square field, no wider than a tile."""
    half = min(field, math.radians(WIDEST[n])) / 2
    cells, edge = scheme(n)
    first = list(accumulate([0, *cells]))
    out = set()
    for north in (1, -1):
        d = dec + north * half
        ring = sum(d > b for b in edge[1:-1])
        for east in (1, -1):
            turn = (ra + east * half / math.cos(d)) % TWO_PI / TWO_PI * cells[ring]
            out.add(first[ring] + 1 + (int(turn) if cells[ring] > 1 else 0))
    return out


@dataclass
class Tile(ds.InputPartition):
    number: int
    path: str


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.most = float(options.get("max_mag", "inf"))
        self.only: set[int] | None = None
        self.low, self.high = {"ra": -math.inf, "dec": -math.inf}, {"ra": math.inf, "dec": math.inf}
        store, at = afs.FileSystem.from_uri(self.root) if "://" in self.root else (afs.LocalFileSystem(), self.root)
        names = {f.path.rsplit("/", 1)[-1] for f in store.get_file_info(afs.FileSelector(at)) if f.type == afs.FileType.File}
        kinds = {n for n in (290, 1476) if any(x.endswith(f".{n}") for x in names)}
        self.n = int(options["scheme"]) if "scheme" in options else max(kinds, default=0)
        prefix = options.get("name", "")
        self.files = {k: f"{self.root.rstrip('/')}/{x}" for k in range(1, self.n + 1) for x in [self._name(prefix, k, names)] if x}
        if not self.files:
            raise FileNotFoundError(f"no star tiles in {self.root}")
        if "field" in options:
            self.only = tiles_at_corners(float(options["ra"]), float(options["dec"]), float(options["field"]), self.n)

    def _name(self, prefix: str, k: int, names: set[str]) -> str | None:
        own = tile_file(k, self.n)
        if prefix:
            return f"{prefix}_{own}" if f"{prefix}_{own}" in names else None
        return own if own in names else next((x for x in sorted(names) if x.endswith(f"_{own}")), None)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """All filters go back to Spark: what is kept here is which tiles to open and where to stop."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column == "tile" and isinstance(f, (ds.EqualTo, ds.In)):
                values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            elif column == "mag" and isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
                self.most = min(self.most, f.value)
            elif column in self.low and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
                self.low[column] = max(self.low[column], f.value)
            if column in self.high and isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
                self.high[column] = min(self.high[column], f.value)
            yield f

    def partitions(self) -> list[ds.InputPartition]:
        out = []
        for k, path in sorted(self.files.items()):
            ra0, ra1, dec0, dec1 = bounds_of(k, self.n)
            beside = codecs.DEC_UNIT  # what rounding may have moved over a bound
            if (self.only is None or k in self.only) and self.low["ra"] <= ra1 + beside and self.high["ra"] >= ra0 - beside and self.low["dec"] <= dec1 + beside and self.high["dec"] >= dec0 - beside:
                out.append(Tile(k, path))
        return out or [Tile(0, "")]

    def read(self, partition: Tile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, at = afs.FileSystem.from_uri(partition.path) if "://" in partition.path else (afs.LocalFileSystem(), partition.path)
        with store.open_input_stream(at) as f:
            for stars in decoded(f.read, self.most):
                colour = pa.array(stars[:, 3], mask=np.isnan(stars[:, 3]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(stars), partition.number, np.int32)), *[pa.array(stars[:, k]) for k in range(3)], colour], names=["tile", "ra", "dec", "mag", "colour"])


def decoded(read, most: float = math.inf) -> Iterator[np.ndarray]:
    """Rows of ra, dec, mag, colour, up to the magnitude `most`. read(n) gives the next n bytes, or fewer at the end."""
    size = read(DESCRIPTION)[-1:] or b"\0"
    size = size[0] if size != b" " else 11
    mag = high = None
    rest = b""
    while size and (data := rest + (new := read(RECORDS * size))):
        whole = len(data) // size * size
        if not whole:
            return
        rec = np.frombuffer(data, np.uint8, whole).reshape(-1, size).astype(np.int64)
        rest = data[whole:]
        ra = rec[:, 0] | rec[:, 1] << 8 | rec[:, 2] << 16
        head = ra == HEAD
        which = np.cumsum(head)  # 0: goes on under the last piece's head
        mags = np.append(-math.inf if mag is None else mag, (rec[head, 4] - 16) / 10.0)
        highs = np.append(0 if high is None else high, rec[head, 3] - 128)
        star = ~head & (which > (mag is None) - 1) & (mags[which] <= most)
        mag, high = (mags[-1], highs[-1]) if head.any() or mag is not None else (None, None)
        dec = (highs[which[star]] << 16) + (rec[star, 4] << 8) + rec[star, 3]
        colour = rec[star, 5].astype(np.int8) / 10.0 if size >= 6 else np.full(int(star.sum()), np.nan)
        yield np.stack([ra[star] * codecs.RA_UNIT, dec * codecs.DEC_UNIT, mags[which[star]], colour], 1)
        if not new or mag is not None and mag > most:
            return


class StarTiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "star_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The source, registered, with its filters pushed down."""
    spark.dataSource.register(StarTiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("star_tiles").options(**{k: str(v) for k, v in options.items()}).load(path)


def write(stars: DataFrame, path: str, n: int = 290, name: str = "stars") -> DataFrame:
    """stars (ra, dec, mag, colour) as tiles below path: a row (tile, stars, bytes) for each. Each is written aside and
    renamed, so a task that runs again leaves the same file. The format asks for one file for each tile."""
    import pandas as pd

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        data = codecs.write_tile(pdf[["ra", "dec", "mag", "colour"]].to_numpy(float), name)
        store, root = afs.FileSystem.from_uri(path) if "://" in path else (afs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        to = f"{name}_{tile_file(int(key[0]), n)}"
        with store.open_output_stream(f"{root}/.{to}.part") as f:
            f.write(data)
        store.move(f"{root}/.{to}.part", f"{root}/{to}")
        return pd.DataFrame([(int(key[0]), len(pdf), len(data))], columns=["tile", "stars", "bytes"])

    placed = stars.select(tile(F.col("ra"), F.col("dec"), n).cast("int").alias("tile"), "ra", "dec", "mag", "colour")
    return placed.groupBy("tile").applyInPandas(one, "tile int, stars long, bytes long")
