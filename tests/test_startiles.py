"""The star tile source: only the tiles that can hold wanted stars are opened, and reading stops at a magnitude."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.functions import tiles
from skyframe.sources import codecs, startiles


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    n = 4000
    stars = np.stack([rng.uniform(0, 2 * np.pi, n), np.arcsin(rng.uniform(-1, 1, n)), np.round(rng.uniform(6, 16, n), 1), np.round(rng.uniform(-0.5, 3, n), 1)], 1)
    df = spark.createDataFrame(stars.tolist(), "ra double, dec double, mag double, colour double")
    at = tmp_path_factory.mktemp("tiles")
    assert startiles.write(df, f"file://{at}").agg(F.sum("stars")).first()[0] == n
    return at, stars


def test_whole(spark, catalogue):
    at, stars = catalogue
    got = startiles.read(spark, f"file://{at}").toPandas()
    assert len(got) == len(stars)
    order, want = np.lexsort((got["mag"], got["ra"])), stars[np.lexsort((stars[:, 2], stars[:, 0]))]
    assert np.allclose(got.to_numpy(float)[order][:, 1:], want, atol=1e-6)
    again = startiles.read(spark, str(at)).withColumn("own", tiles.tile(F.col("ra"), F.col("dec")))
    assert again.filter("abs(own - tile) > 40").count() == 0  # rounding may move a star over a bound




def test_a_field_opens_its_corner_tiles_only(spark, catalogue, tmp_path):
    at, stars = catalogue
    ra, dec, field = 1.0, 0.4, 0.15
    want = spark.range(1).select(tiles.tiles_of_field(F.lit(ra), F.lit(dec), field)).first()[0]
    assert startiles.tiles_at_corners(ra, dec, field, 290) == set(want)
    for f in at.iterdir():  # the others can't be opened at all
        if any(f.name.endswith(tiles.tile_file(k)) for k in want):
            (tmp_path / f.name).write_bytes(f.read_bytes())
        else:
            (tmp_path / f.name).symlink_to("/nowhere")
    df = startiles.read(spark, f"file://{tmp_path}", ra=ra, dec=dec, field=field)
    assert df.rdd.getNumPartitions() == len([k for k in want if any(x.name.endswith(tiles.tile_file(k)) for x in at.iterdir())])
    inside = (np.abs(stars[:, 0] - ra) * np.cos(dec) < field / 2) & (np.abs(stars[:, 1] - dec) < field / 2)
    near = (F.abs(F.col("ra") - ra) * np.cos(dec) < field / 2) & (F.abs(F.col("dec") - dec) < field / 2)
    assert df.filter(near).count() == inside.sum()


def test_filters_prune_tiles(spark, catalogue):
    at, stars = catalogue
    df = startiles.read(spark, f"file://{at}")
    everything = df.rdd.getNumPartitions()
    north = df.filter("dec > 1.2")
    assert north.count() == (stars[:, 1] > 1.2).sum() and north.rdd.getNumPartitions() < everything / 8
    one = df.filter("tile in (145, 146)")
    assert one.rdd.getNumPartitions() == 2 and {r["tile"] for r in one.collect()} == {145, 146}
    box = df.filter("dec > -0.1 and dec < 0.1 and ra > 2 and ra < 2.2")
    assert box.rdd.getNumPartitions() <= 6 and box.count() == ((np.abs(stars[:, 1]) < 0.1) & (stars[:, 0] > 2) & (stars[:, 0] < 2.2)).sum()
    assert df.filter("tile = 999").count() == 0


def test_reading_stops_at_a_magnitude(monkeypatch):
    monkeypatch.setattr(startiles, "RECORDS", 50)
    rng = np.random.default_rng(1)
    stars = np.stack([rng.uniform(0, 6, 3000), rng.uniform(-1, 1, 3000), np.round(rng.uniform(6, 16, 3000), 1), np.zeros(3000)], 1)
    data = codecs.write_tile(stars)
    file = io.BytesIO(data)
    got = np.concatenate(list(startiles.decoded(file.read, 7.0)))
    assert len(got) == (stars[:, 2] <= 7.0).sum() and got[:, 2].max() <= 7.0
    assert file.tell() < len(data) / 4
    assert np.allclose(np.concatenate(list(startiles.decoded(io.BytesIO(data).read))), codecs.read_tile(data))


def test_edges(spark, tmp_path):
    with pytest.raises(Exception, match="no star tiles"):
        startiles.read(spark, f"file://{tmp_path}").count()
    (tmp_path / "a_0101.290").write_bytes(codecs.write_tile(np.zeros((0, 4))))
    assert startiles.read(spark, f"file://{tmp_path}").count() == 0
    five = bytearray(codecs.write_tile(np.array([[1.0, -1.5, 9.0, 0.5]])))
    five[109] = 5
    body = bytes(five[110:])
    (tmp_path / "a_0101.290").write_bytes(bytes(five[:110]) + body[:5] + body[6:11])
    r = startiles.read(spark, f"file://{tmp_path}", name="a").collect()
    assert len(r) == 1 and r[0]["colour"] is None and abs(r[0]["dec"] + 1.5) < 1e-6
