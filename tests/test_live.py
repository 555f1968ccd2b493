import datetime as dt

import numpy as np
import pandas as pd

from skyframe import cli
from skyframe.sources import codecs
from skyframe.streaming import live


def test_running_stack(spark, tmp_path):
    schema = "session string, x int, y int, at long, ra double, dec double, exposure double, v double"
    src, out = f"{tmp_path}/in", []
    rows = [("s", x, 0, at, 10.0 + (at >= 3), 5.0, 60.0, float(at * 10 + x)) for at in range(5) for x in (0, 1)]
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = live.running_stack(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).foreachBatch(lambda df, n: out.append(df.toPandas())).start()
        q.awaitTermination(120)
    got = pd.concat(out).sort_values(["stack", "frames"]).groupby("x").last()
    assert got.loc[0, "stack"] == 2 and got.loc[0, "frames"] == 2 and got.loc[0, "mean"] == 35 and got.loc[1, "mean"] == 36


def test_tiles_as_stream_and_as_table(spark, tmp_path):
    """Stream and table agree, over a restart; rejected frames come once, with their reason; state rows are tiles."""
    schema = "session string, y0 int, x0 int, at long, ra double, dec double, exposure double, width int, height int, quads int, data array<double>"
    rng, rows = np.random.default_rng(1), []
    for at in range(12):
        size = 9 if at == 4 else 8
        for y0, x0 in ((0, 0), (0, 4), (4, 0)):
            rows.append(("s", y0, x0, at, 10.0 + (at >= 7), 5.0, 60.0, size, 8, 1 if at in (2, 9) else 20, rng.uniform(0, 9, 16).tolist()))
    src, out = f"{tmp_path}/in", []
    for part in (rows[:9], rows[9:24], rows[24:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = live.running_tiles(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).foreachBatch(lambda df, n: out.append(df.toPandas())).start()
        q.awaitTermination(120)
        if any("stateOperators" in p and p["stateOperators"] for p in q.recentProgress):
            assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 3
    stream, table = pd.concat(out), live.stacked_tiles(spark.createDataFrame(rows, schema)).toPandas()
    last = lambda df: df[df["reason"].isna()].sort_values("at").groupby(["y0", "x0"]).last()
    a, b = last(stream), last(table)
    assert (a[["stack", "frames", "rejected"]] == b[["stack", "frames", "rejected"]]).all().all() and set(a["stack"]) == {2} and set(a["frames"]) == {4} and set(a["rejected"]) == {3}
    for k in a.index:
        want = np.mean([r[10] for r in rows if r[1:3] == k and r[3] in (7, 8, 10, 11)], axis=0)
        assert np.allclose(a.loc[k, "mean"], want) and np.allclose(b.loc[k, "mean"], want)
    for df in (stream, table):
        assert sorted(zip(df["at"][df["reason"].notna()], df["reason"].dropna(), strict=True)) == [(2, "quads"), (4, "size"), (9, "quads")]


def test_sessions_and_windows(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, t(s), v) for s, v in ((0, 5), (10, 6), (20, 60), (30, 61), (9999, 62))]
    df = spark.createDataFrame(rows, "star long, t timestamp, v long")
    assert [r["session"] for r in live.sessions(df, ["star"], ["t"], 10, 1000).orderBy("t").collect()] == [1, 1, 2, 2, 3]
    df.selectExpr("star", "cast(t as timestamp_ntz) t", "v").write.parquet(f"{tmp_path}/in")
    q = live.magnitudes_by_window(spark.readStream.schema("star long, t timestamp_ntz, v long").parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["n"] for r in spark.sql("select n from w").collect()} == {4, 1}


def test_monitor_and_files(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/f{i}.fits").write_bytes(codecs.write_fits(np.full((1, 4, 4), float(i), np.float32)))
    for _ in range(2):
        live.monitor(live.frame_files(spark, f"{tmp_path}/in"), lambda df, n: seen.extend(r["path"] for r in df.select("path").collect()), f"{tmp_path}/ck").awaitTermination(120)
    assert len(seen) == 3


def test_cli(spark, tmp_path, capsys):
    y, x = np.mgrid[:90, :90]
    img = 100.0 + (x * 7 + y * 13) % 9 + 5000 * np.exp(-((x - 45) ** 2 + (y - 40) ** 2) / 8.0)
    (tmp_path / "a.fits").write_bytes(codecs.write_fits(img[None].astype(np.float32)))
    assert cli.main(["-h"]) == 0 and cli.main(["-x"]) == 2 and cli.main(["-f", f"{tmp_path}/none.fits"], spark) == 16
    assert cli.main(["-f", f"{tmp_path}/a.fits", "-analyse", "-s", "1", "-stack", f"{tmp_path}/st"], spark) == 0
    assert "STARS=1" in capsys.readouterr().out and spark.read.parquet(f"{tmp_path}/st").count() == 8100


def test_cli_solves(spark, tmp_path, capsys):
    """Two frames of a planted sky, one turned, solved from a start that is off; a third of nothing is not."""
    from skyframe.sources import startiles

    rng = np.random.default_rng(3)
    scale, side, ra0, dec0 = 4e-5, 400, 1.5, 0.3
    xi, eta = rng.uniform(-0.016, 0.016, (2, 150))
    d = np.cos(dec0) - eta * np.sin(dec0)
    ra, dec = ra0 + np.arctan2(xi, d), np.arctan2(np.sin(dec0) + eta * np.cos(dec0), np.hypot(xi, d))
    mag = np.round(rng.uniform(8, 13, 150), 1)
    cat = spark.createDataFrame([(float(r), float(q), float(m), 0.5) for r, q, m in zip(ra, dec, mag, strict=True)], "ra double, dec double, mag double, colour double")
    startiles.write(cat, f"file://{tmp_path}/tiles").collect()
    yy, xx = np.mgrid[:side, :side]
    for k, turn in enumerate((0.0, 0.5)):
        c, s = np.cos(turn), np.sin(turn)
        x, y = (side - 1) / 2 + (s * eta - c * xi) / scale, (side - 1) / 2 + (s * xi + c * eta) / scale
        img = 100.0 + (xx * 7 + yy * 13) % 9
        for px, py, m in zip(x, y, mag, strict=True):
            if 20 < px < side - 20 and 20 < py < side - 20:
                img += 6000 * 10 ** (-0.2 * (m - 8)) * np.exp(-((xx - px) ** 2 + (yy - py) ** 2) / 4.5)
        (tmp_path / f"f{k}.fits").write_bytes(codecs.write_fits(img[None].astype(np.float32)))
    where = ["-ra", str(np.degrees(ra0 + 0.001) / 15), "-spd", str(np.degrees(dec0 - 0.001) + 90), "-fov", str(np.degrees(scale * side))]
    args = ["-f", f"{tmp_path}/f*.fits", "-d", f"file://{tmp_path}/tiles", *where, "-s", "30", "-o", f"{tmp_path}/out"]
    assert cli.main(args, spark) == 0
    for k in range(2):
        ini = dict(line.split("=", 1) for line in (tmp_path / f"out/f{k}.ini").read_text().splitlines())
        assert ini["PLTSOLVD"] == "T" and abs(float(ini["CRVAL1"]) - np.degrees(ra0)) < 2e-4 and abs(float(ini["CRVAL2"]) - np.degrees(dec0)) < 2e-4
    assert cli.main([*args[:2], "-d", f"{tmp_path}/out", *where], spark) == 32
    assert cli.main([*args[:4]], spark) == 2
    (tmp_path / "g.fits").write_bytes(codecs.write_fits(np.full((1, 60, 60), 100, np.float32)))
    assert cli.main(["-f", f"{tmp_path}/g.fits", "-d", f"file://{tmp_path}/tiles", *where], spark) == 1
    assert "PLTSOLVD=F" in capsys.readouterr().out


def test_gaps_have_parts_of_seconds(spark):
    from skyframe.streaming.live import sessions

    rows = [(1, "2024-01-01 00:00:00.9", 5), (2, "2024-01-01 00:01:00.8", 5), (3, "2024-01-01 00:02:00.95", 5), (4, "2024-01-01 00:03:00.95", 5)]
    df = spark.createDataFrame(rows, "id long, at string, v long").selectExpr("1 as star", "id", "cast(at as timestamp) as t", "v")
    assert [r["session"] for r in sessions(df, ["star"], ["t", "id"], 100, 60).orderBy("id").collect()] == [1, 1, 2, 2]
