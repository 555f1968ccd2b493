"""Frames, tiles, headers and star tables as DataFrames, read from files of any known kind and written back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions.text import file_kind
from skyframe.sources import codecs

TILES = "file string, ch int, y0 int, x0 int, h int, w int, data array<float>"
CARDS = "file string, pos int, key string, text string"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "modificationTime", "content")


def decode(name: str, data: bytes) -> np.ndarray:
    """By the name's extension, else by the first bytes."""
    ext = name.rsplit(".", 1)[-1].lower()
    if ext in ("fit", "fits", "fts") or data[:6] == b"SIMPLE":
        return codecs.read_fits(data)[1]
    if ext in ("pgm", "ppm", "pfm") or data[:2] in (b"P5", b"P6", b"Pf", b"PF"):
        return codecs.read_pnm(data)[1]
    if ext == "xisf" or data[:8] == b"XISF0100":
        return codecs.read_xisf(data)[1]
    if ext in ("tif", "tiff") or data[:4] in (b"II*\0", b"MM\0*"):
        return codecs.read_tiff(data)
    raise ValueError(f"{name}: unknown kind of image")


def read_tiles(spark: SparkSession, path: str, size: int = 256) -> DataFrame:
    """A row for each tile of each channel; frames are decoded where they are read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")

    def tiles(batches):
        for pdf in batches:
            for name, data in zip(pdf["file"], pdf["content"], strict=True):
                img = decode(name, bytes(data))
                rows = [(name, c, y, x, *img[c, y : y + size, x : x + size].shape, img[c, y : y + size, x : x + size].ravel()) for c in range(img.shape[0]) for y in range(0, img.shape[1], size) for x in range(0, img.shape[2], size)]
                yield pd.DataFrame(rows, columns=["file", "ch", "y0", "x0", "h", "w", "data"])

    return files(spark, path).select("file", "content").mapInPandas(tiles, TILES)


def pixels(tiles: DataFrame) -> DataFrame:
    """(file, ch, y, x, v)."""
    p = tiles.select("file", "ch", "y0", "x0", "w", F.posexplode("data").alias("i", "v"))
    return p.select("file", "ch", (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("int").alias("x"), "v")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Cards of FITS files; pixels are not decoded."""

    def cards(batches):
        for pdf in batches:
            rows = [(name, i, c[:8].strip(), c) for name, data in zip(pdf["file"], pdf["content"], strict=True) for i, c in enumerate(codecs.read_fits(bytes(data), pixels=False)[0])]
            yield pd.DataFrame(rows, columns=["file", "pos", "key", "text"])

    return files(spark, path).filter(file_kind(F.col("file")) == "fits").select("file", "content").mapInPandas(cards, CARDS)


def put(folder: str, name: str, data: bytes) -> None:
    """A file in a folder of any kind of store, written aside and renamed."""
    from pyarrow import fs as afs

    store, root = afs.FileSystem.from_uri(folder) if "://" in folder else (afs.LocalFileSystem(), folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/.{name}.part") as f:
        f.write(data)
    store.move(f"{root}/.{name}.part", f"{root}/{name}")


def write_images(tiles: DataFrame, out: str, bits: int = -32) -> DataFrame:
    """A FITS file for each frame, under its own name; returns (file, bytes). Each is written aside and renamed."""

    def write(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int((pdf["y0"] + pdf["h"]).max()), int((pdf["x0"] + pdf["w"]).max())
        img = np.zeros((int(pdf["ch"].max()) + 1, h, w), np.float32)
        for r in pdf.itertuples(index=False):
            img[r.ch, r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.asarray(r.data).reshape(r.h, r.w)
        data = codecs.write_fits(img, bits=bits)
        name = key[0].rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".fits"
        put(out, name, data)
        return pd.DataFrame([(name, len(data))], columns=["file", "bytes"])

    return tiles.groupBy("file").applyInPandas(write, "file string, bytes long")
