"""Live stacking: sessions, their restart rules, and the running stack, as batch and as stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(frames: DataFrame, by: list[str], order: list[str], jump: float, gap: float) -> DataFrame:
    """frames with v and a time (order[0]): a session ends when v moves by more than jump, or after gap seconds, parts of seconds included."""
    w = Window.partitionBy(*by).orderBy(*order)
    seconds = F.col(order[0]).cast("timestamp").cast("double")
    new = F.lag("v").over(w).isNull() | (F.abs(F.col("v") - F.lag("v").over(w)) > jump) | (seconds - F.lag(seconds).over(w) > gap)
    return frames.withColumn("new", new.cast("long")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new")


def frame_files(spark: SparkSession, path: str, pattern: str = "*.fit*", each: int = 4) -> DataFrame:
    """New files of a folder as a stream of (path, modificationTime, length, content), oldest first."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", each).load(path)


STACK = "session string, x int, y int, stack int, frames long, mean double"
STATE = "stack int, frames long, ra double, dec double, exposure double, mean double"


def running_stack(tiles: DataFrame, moved_deg: float = 0.2, exposure_change: float = 0.01) -> DataFrame:
    """tiles (session, x, y, at, ra, dec, exposure, v): the running mean of each pixel. A pointing or exposure that changed
    begins a new stack. State is one row for each pixel of a session; batches are taken in order of `at`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack, n, ra, dec, exposure, mean = state.get if state.exists else (0, 0, None, None, None, 0.0)
        for row in pd.concat(list(batches)).sort_values("at").itertuples(index=False):
            if n == 0 or abs(row.ra - ra) > moved_deg or abs(row.dec - dec) > moved_deg or abs(row.exposure - exposure) > exposure_change:
                stack, n, mean = stack + 1, 0, 0.0
                ra, dec, exposure = float(row.ra), float(row.dec), float(row.exposure)
            n += 1
            mean = (mean * (n - 1) + float(row.v)) / n
        state.update((stack, n, ra, dec, exposure, mean))
        yield pd.DataFrame([(*key, stack, n, mean)], columns=["session", "x", "y", "stack", "frames", "mean"])

    return tiles.groupBy("session", "x", "y").applyInPandasWithState(step, STACK, STATE, "update", GroupStateTimeout.NoTimeout)


TILES = "session string, y0 int, x0 int, stack int, frames long, rejected long, at long, reason string, mean array<double>"
TILE_STATE = "stack int, frames long, rejected long, ra double, dec double, exposure double, width int, height int, mean binary"


class TileStack:
    """The running mean of one tile, over frames in order of `at`. A pointing or exposure that changed begins a new stack, whose
    first frame sets the size; a later one of another size, or with fewer matching quads than `quads`, is rejected."""

    def __init__(self, state: tuple | None, moved_deg: float, exposure_change: float, quads: int) -> None:
        self.moved, self.change, self.quads = moved_deg, exposure_change, quads
        self.stack, self.frames, self.rejected, self.ra, self.dec, self.exposure, self.width, self.height, mean = state or (0, 0, 0, 0.0, 0.0, 0.0, 0, 0, b"")
        self.mean = np.frombuffer(bytes(mean)).copy()

    def reason(self, r) -> str | None:
        if (r.width, r.height) != (self.width, self.height):
            return "size"
        return "quads" if self.frames and r.quads < self.quads else None

    def add(self, r) -> str | None:
        """Takes a frame's tile in; or says why not."""
        if not self.frames or abs(r.ra - self.ra) > self.moved or abs(r.dec - self.dec) > self.moved or abs(r.exposure - self.exposure) > self.change:
            self.stack, self.frames, self.mean = self.stack + 1, 0, np.zeros(len(r.data))
            self.ra, self.dec, self.exposure, self.width, self.height = float(r.ra), float(r.dec), float(r.exposure), int(r.width), int(r.height)
        why = self.reason(r)
        if why is None:
            self.frames += 1
            self.mean += (np.asarray(r.data, float) - self.mean) / self.frames
        else:
            self.rejected += 1
        return why

    def state(self) -> tuple:
        return self.stack, self.frames, self.rejected, self.ra, self.dec, self.exposure, self.width, self.height, self.mean.tobytes()

    def fold(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A row for the stack as it is now; and, from the first tile of a frame alone, one for each frame rejected."""
        out = []
        for r in rows.sort_values("at", kind="stable").itertuples(index=False):
            why = self.add(r)
            if why and key[1] == key[2] == 0:
                out.append((*key, self.stack, self.frames, self.rejected, r.at, why, None))
        out.append((*key, self.stack, self.frames, self.rejected, int(rows["at"].max()), None, self.mean.tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TILES.split(", ")])


def running_tiles(tiles: DataFrame, moved_deg: float = 0.2, exposure_change: float = 0.01, quads: int = 3) -> DataFrame:
    """tiles (session, y0, x0, at, ra, dec, exposure, width, height, quads, data: the tile's values), a stream: TILES, with the
    mean of each tile as an array, and the rejected frames with their reason. State is one row for each tile of a session, an
    array in it; what a restart from the checkpoint goes on from."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = TileStack(state.get if state.exists else None, moved_deg, exposure_change, quads)
        out = own.fold(key, pd.concat(list(batches)))
        state.update(own.state())
        yield out

    return tiles.groupBy("session", "y0", "x0").applyInPandasWithState(step, TILES, TILE_STATE, "append", GroupStateTimeout.NoTimeout)


def stacked_tiles(tiles: DataFrame, moved_deg: float = 0.2, exposure_change: float = 0.01, quads: int = 3) -> DataFrame:
    """The same for a table of tiles: what the stream comes to when all have arrived."""

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return TileStack(None, moved_deg, exposure_change, quads).fold(key, rows)

    return tiles.groupBy("session", "y0", "x0").applyInPandas(step, TILES)


def monitor(frames: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str):
    """Each batch of frames to report(df, number), once; the checkpoint remembers what was seen."""
    return frames.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def magnitudes_by_window(frames: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """frames (star, t, v): number, mean and spread of each star in windows of time; t may be without a time zone."""
    return frames.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", late).groupBy(F.window("t", width), "star").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"))
