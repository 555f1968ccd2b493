"""Command line: analysis of image files on Spark.

    python -m skyframe.cli -f "frames/*.fits" -extract out/      stars of each frame as CSV
    python -m skyframe.cli -f "frames/*.fits" -analyse           median HFD and number of stars of each frame
    python -m skyframe.cli -f "frames/*.fits" -stack out/        average of the frames as Parquet (ch, y, x, v)
    python -m skyframe.cli -f "frames/*.fits" -tofits out/       any known kind of image as FITS
    python -m skyframe.cli -f "frames/*.fits" -d tiles/ -ra 5.59 -spd 84.6 -fov 1.2 -o out/    solves all frames at once

Solving: -d is a folder of star tiles, -ra (hours) and -spd (degrees from the south pole) where to begin, -fov the height of a
frame (degrees), -r how far to search (degrees), -t the tolerance of quads; -o takes an INI file for each frame (`name.ini`).

Exit codes: 0, 1 where a frame is not solved, 2 for wrong usage, 16 where no image can be read, 32 where there are no star
tiles, 33 where they can't be read.
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skyframe", add_help=True)
    p.add_argument("-f", dest="files", required=True)
    p.add_argument("-analyse", action="store_true")
    for name in ("-extract", "-stack", "-tofits"):
        p.add_argument(name)
    p.add_argument("-s", dest="stars", type=int, default=500)
    p.add_argument("-d", dest="tiles")
    p.add_argument("-o", dest="out")
    for name in ("-ra", "-spd", "-fov"):
        p.add_argument(name, type=float)
    p.add_argument("-r", dest="radius", type=float, default=0.0)
    p.add_argument("-t", dest="tolerance", type=float, default=0.007)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    if a.tiles and None in (a.ra, a.spd, a.fov):
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    from pyspark.sql.utils import AnalysisException

    from skyframe.operators import frames
    from skyframe.operators.robust import smedian
    from skyframe.sources import images

    spark = spark or SparkSession.builder.appName("skyframe").getOrCreate()
    try:
        tiles = images.read_tiles(spark, a.files)
        if tiles.isEmpty():
            return 16
    except AnalysisException:
        return 16
    if a.tofits:
        images.write_images(tiles, a.tofits).collect()  # a row for each file
    if a.stack:
        images.pixels(tiles).groupBy("ch", "y", "x").agg(F.avg("v").alias("v")).write.mode("overwrite").parquet(a.stack)
    if a.analyse or a.extract:
        numbered = images.pixels(tiles).filter("ch = 0").select(F.xxhash64("file").alias("frame"), "x", "y", "v")
        stars = frames.found_stars(numbered, a.stars)
        names = tiles.select("file", F.xxhash64("file").alias("frame")).distinct()
        if a.extract:
            stars.join(names, "frame").drop("frame").write.mode("overwrite").option("header", True).csv(a.extract)
        if a.analyse:
            counts = stars.groupBy("frame").agg(F.count("*").alias("stars"))
            for r in smedian(stars, ["frame"], "hfd", "hfd").join(counts, "frame").join(names, "frame").toLocalIterator():
                print(f"{r['file']} HFD_MEDIAN={r['hfd']:.2f} STARS={r['stars']}")
    return solved(spark, tiles, a) if a.tiles else 0


def solved(spark, tiles, a) -> int:
    """Solves all frames in one go; an INI file, or a line of output, for each."""
    import math

    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from skyframe.operators import frames as on_frames
    from skyframe.operators.scratch import stored
    from skyframe.plans import solve
    from skyframe.sources import codecs, images, startiles

    ra, dec, fov = math.radians(a.ra * 15), math.radians(a.spd - 90), math.radians(a.fov)
    rings = max(0, math.ceil(math.radians(a.radius) / (fov * solve.STEP)))
    reach = (rings * solve.STEP + solve.OVERSIZE) * fov
    try:
        catalog = startiles.read(spark, a.tiles).filter(F.col("dec").between(dec - reach, dec + reach))
        catalog = stored(catalog.select(F.xxhash64("ra", "dec", "mag").alias("id"), "ra", "dec", "mag"), "catalogue")
    except (PySparkException, OSError) as e:
        return 32 if "no star tiles" in str(e) or "FileNotFound" in str(e) else 33
    size = tiles.groupBy("file").agg(F.max(F.col("x0") + F.col("w")).cast("int").alias("width"), F.max(F.col("y0") + F.col("h")).cast("int").alias("height")).withColumn("frame", F.xxhash64("file"))
    px = images.pixels(tiles).filter("ch = 0").select(F.xxhash64("file").alias("frame"), "x", "y", "v")
    stars = on_frames.found_stars(px, a.stars).select("frame", F.monotonically_increasing_id().alias("id"), (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"))
    start = size.select("frame", F.lit(ra).alias("ra0"), F.lit(dec).alias("dec0"), F.lit(fov).alias("field"), "width", "height")
    got = solve.solve_all(stored(start, "frames"), stored(stars, "stars"), catalog, rings, a.tolerance)
    names = ("crpix1", "crpix2", "crval1", "crval2", "cd1_1", "cd1_2", "cd2_1", "cd2_2")
    code = 0
    for r in size.join(got, "frame", "left").select("file", "width", "height", "quads", *names).orderBy("file").toLocalIterator():  # a row for each frame
        solution = None if r["quads"] is None else {k.upper(): r[k] for k in names}
        text = codecs.result_ini(solution, " ".join(sys.argv), r["width"], r["height"], 0)
        code = code or int(solution is None)
        if a.out:
            images.put(a.out, r["file"].rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".ini", text.encode())
        else:
            print(r["file"], text.replace("\n", " "))
    return code


if __name__ == "__main__":
    sys.exit(main())
