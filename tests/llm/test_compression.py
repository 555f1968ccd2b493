import os
import random
import zlib

import numpy as np
import pytest
import zstandard

from skyframe.llm import compression
from skyframe.llm.common import table


def sets(n=120, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(60, 200))).capitalize() + "." for _ in range(n)]
    bad = [" ".join(word() + rng.choice(["###", "$$$", "%%%"]) for _ in range(rng.randint(60, 200))) for _ in range(n)]
    return good, bad


def frames(spark, good, bad):
    texts = good + bad
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(texts))], "doc_id long, quality int")
    return docs, labels


def is_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_separates_and_holds_out(spark):
    good, bad = sets()
    docs, labels = frames(spark, good, bad)
    got = compression.judge(docs, compression.train(docs, labels)).collect()
    assert len(got) == 240 and all(r["held_out"] == is_held(r["doc_id"]) for r in got)
    assert all((r["predicted"] == 1) == (r["doc_id"] < 120) == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_change_nothing(spark):
    good, bad = sets(60)
    docs, labels = frames(spark, good, bad)
    other = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) quality")
    a, b = (sorted(tuple(r) for r in compression.judge(docs, compression.train(docs, x)).collect()) for x in (labels, other))
    assert a == b


def test_measures_against_plain_compression():
    good, bad = sets(30)
    sizes = compression.Sizes(compression.build([t.encode() for t in good]), compression.build([t.encode() for t in bad]))
    text = "né " * 3000 + good[0]
    plain = []
    for d in sizes.pack:
        plain.append(sum(len(d.compress(text[i : i + compression.BLOCK].encode())) for i in range(0, len(text), compression.BLOCK)))
    want = (plain[1] - plain[0]) / (sum(plain) + 32), np.log((sum(plain) + 32) / (2 * len(text.encode()) + 32))
    assert np.allclose(sizes.measures(text), want)
    assert sizes.measures(None) == sizes.measures("") == (0.0, 0.0)
    assert isinstance(sizes.pack[0], zstandard.ZstdCompressor)


def test_curve_is_calibrated():
    """Scores are the shares of label 1 where the two kinds overlap."""
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.8
    x = np.stack([rng.normal(size=20000) + y * 1.0, rng.normal(size=20000)], 1)
    s = compression.Curve(x, y, np.log(y.sum() / (~y).sum())).score(x)
    for low in (0.5, 0.7, 0.9):
        pick = (s >= low) & (s < low + 0.1)
        assert abs(y[pick].mean() - s[pick].mean()) < 0.03


def test_edges(spark):
    docs = spark.createDataFrame([(2**60 + 1, None, 1), (None, "", 2), (3, "x" * 300_000, 3), (3, "a", 4), (4, "a", 5)], "doc_id long, text string, score int").coalesce(1)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    got = compression.judge(docs, compression.train(docs, empty)).collect()
    assert [r["doc_id"] for r in got] == [2**60 + 1, None, 3, 3, 4] and {r["score"] for r in got} == {0.5} and {r["held_out"] for r in got} == {False, is_held(3), is_held(4), is_held(2**60 + 1)}
    for q in (0, 1):
        one = spark.createDataFrame([(i, q) for i in range(8)], "doc_id long, quality int")
        assert {(r["score"], r["predicted"]) for r in compression.judge(docs, compression.train(docs, one)).collect()} == {(float(q), q)}
    good, bad = sets(3)
    d, labels = frames(spark, good, bad)
    model = compression.train(d, labels.union(spark.createDataFrame([(None, 1), (1, 0), (2, None), (2, 7)], "doc_id long, quality int")))
    first, *rest = compression.judge(docs, model).collect()
    assert first["difference"] == 0 and 0 <= first["score"] <= 1 and len(rest) == 4
    nothing = spark.createDataFrame([], docs.schema)
    assert compression.judge(nothing, compression.train(nothing, labels)).count() == 0


def test_held_out_quarter_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    got = compression.op13_compression(spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    good, bad = [r["predicted"] for r in got if r["quality"] == 1], [r["predicted"] for r in got if r["quality"] == 0]
    assert len(good) > 500 and np.mean(good) > 0.98 and len(bad) > 50 and np.mean(bad) < 0.1
