import numpy as np
import pytest

from skyframe.sources import codecs, images


@pytest.fixture(scope="module")
def img():
    return np.floor(np.random.default_rng(1).uniform(0, 65000, (3, 37, 53))).astype(np.float32)


def test_fits_round_trip(img):
    for bits in (16, -32):
        for a in (img, img[:1]):
            cards, b = codecs.read_fits(codecs.write_fits(a, [codecs.card("OBJECT", "M 31"), codecs.card("EXPTIME", 2.5)], bits))
            assert np.array_equal(a, b) and {codecs.card_value(c) for c in cards} >= {"M 31", 2.5}
    assert codecs.read_fits(codecs.write_fits(img), pixels=False)[1] is None
    many = [codecs.card(f"K{i}", i) for i in range(80)]
    new = codecs.with_cards(codecs.write_fits(img), many)
    assert np.array_equal(codecs.read_fits(new)[1], img) and len(codecs.read_fits(new)[0]) > 80


def test_other_kinds(img):
    assert np.array_equal(codecs.read_pnm(codecs.write_pnm(img))[1], img)
    assert codecs.read_pnm(b"P5\n# EXPTIME=3\n2 1\n255\n\x01\x02")[0] == {"EXPTIME": "3"}
    for bits in (16, 32):
        assert np.array_equal(codecs.read_tiff(codecs.write_tiff(img, bits, "x" * 9)), img)
        assert np.array_equal(codecs.read_tiff(codecs.write_tiff(img[:1], bits)), img[:1])
    body = (img / 65535).astype("<f4")[:, ::-1].tobytes()
    xml = b'<xisf><Image geometry="53:37:3" sampleFormat="Float32" location="attachment:1000:%d"><FITSKeyword name="OBJECT" value="\'M1\'"/></Image></xisf>' % len(body)
    data = b"XISF0100" + len(xml).to_bytes(4, "little") + b"\0" * 4 + xml
    meta, got = codecs.read_xisf(data.ljust(1000, b"\0") + body)
    assert meta["OBJECT"] == "M1" and np.allclose(got, img, atol=0.01)


def test_rice_and_tiles():
    v = np.random.default_rng(2).integers(0, 90, 500)
    data = codecs.rice_encode(v, 4)
    assert np.array_equal(codecs.rice_decode(data, 4, 500), v) and len(data) == -(-int(((v >> 4) + 5).sum()) // 8)
    assert codecs.rice_encode(np.full(10, 60000), 1) is None
    s = np.array([[1.0, -0.5, 9.1, 0.5], [6.0, 1.2, 12.3, -0.4], [0.1, 0.0, 9.1, 1.0]])
    got = codecs.read_tile(codecs.write_tile(s))
    order = np.argsort(got[:, 0])
    assert np.allclose(got[order], s[np.argsort(s[:, 0])], atol=1e-6)


def test_spark_readers(spark, img, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.fits").write_bytes(codecs.write_fits(img + i, [codecs.card("NR", i)], -32))
    t = images.read_tiles(spark, f"{tmp_path}/*.fits", 16)
    assert t.count() == 3 * 3 * 3 * 4
    p = images.pixels(t).filter("file like '%f1.fits' and ch = 2 and x = 50 and y = 30").collect()
    assert [r["v"] for r in p] == [img[2, 30, 50] + 1]
    h = images.read_headers(spark, f"{tmp_path}/*.fits").filter("key = 'NR'")
    assert sorted(codecs.card_value(r["text"]) for r in h.collect()) == [0, 1, 2]
    assert images.write_images(t, f"file://{tmp_path}/out").count() == 3
    assert np.array_equal(codecs.read_fits((tmp_path / "out/f2.fits").read_bytes())[1], img + 2)


def test_cards_that_repeat_and_new_ones(spark):
    from skyframe.operators import cards

    old = spark.createDataFrame([("f", 0, "A", "a0"), ("f", 1, "B", "b"), ("f", 2, "A", "a2"), ("g", 0, "B", "gb")], "file string, pos int, key string, text string")
    new = spark.createDataFrame([("f", "A", "new"), ("f", "D", "d"), ("f", "C", "c"), ("g", "A", "ga")], "file string, key string, text string")
    got = sorted(tuple(r) for r in cards.upserted(old, new).collect())
    assert got == [("f", 0, "A", "new"), ("f", 1, "B", "b"), ("f", 2, "A", "a2"), ("f", 3, "C", "c"), ("f", 4, "D", "d"), ("g", 0, "B", "gb"), ("g", 1, "A", "ga")]
