import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import quality
from skyframe.llm.common import table

TEXTS = [None, "", " \n ", "a b c a b c", "a b c d\na b c d\n\nx y", "é b c  # $ <>", "one two three " * 30, "x\x1cy z", "word " * 60, "\n".join(f"Line number {i} says something new {i * 7}." for i in range(40))]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    in_repeat = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(in_repeat), n < 50 or 100 * len(in_repeat) > 50 * n


def test_base_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r[0]: r for r in quality.judge(docs, (np.zeros(quality.N_FEATURES), np.zeros((2, 2)))).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i])[1:7] == brute(t), t
        assert got[i]["kept"] == (not got[i]["base_failed"])


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        e, t = rng.normal(size=n), rng.normal(size=(2, 2))
        score = lambda y: sum(e[k] * y[k] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1))  # noqa: B023, E731
        assert np.isclose(score(quality.viterbi(e, t)), max(map(score, itertools.product((0, 1), repeat=n))))


def test_learned_verdict(spark):
    good = ["\n".join(f"This is sentence {i * j} of a plain text, and it goes on." for i in range(1, 9)) for j in range(1, 30)]
    bad = ["\n".join("BUY### NOW*** %%% $$$ CHEAP!!" + "|" * i for i in range(1, 16)) for j in range(1, 30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(0, len(good + bad), 2)], "doc_id long, quality int")
    got = {r[0]: r for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    assert all((got[i]["content_share"] > 0.5) == (i < len(good)) for i in got)


def plain(rng, n):
    return (" ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(n)) + ".").capitalize()


def test_boilerplate_in_good_documents(spark):
    """Menus, links and recurring lines between prose get their own label, and prose between them keeps its."""
    rng = random.Random(3)
    menus = ["Home | News | Sport | Contact | Login", "Share", "Read more", ">>> next <<< prev", "* * * * *"]

    def doc():
        lines = [(plain(rng, rng.randint(8, 30)), 1) for _ in range(rng.randint(4, 9))]
        for m in rng.sample(menus, 3):
            lines.insert(rng.randint(0, len(lines)), (m, 0))
        return lines

    good = [doc() for _ in range(60)]
    bad = [[("BUY### NOW*** %%% $$$ CHEAP!!" + "|" * i, 0) for i in range(1, 9)] for _ in range(30)]
    docs = spark.createDataFrame([(i, "\n".join(t for t, _ in x)) for i, x in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(90) if i % 4], "doc_id long, quality int")
    w, t = quality.train(docs, labels)
    right = total = 0
    for i in range(0, 60, 4):  # held out
        got = quality.viterbi(quality.describe("\n".join(x for x, _ in good[i]))[2] @ w, t)
        right += sum(int(a) == b for a, (_, b) in zip(got, good[i], strict=True))
        total += len(got)
    assert right / total > 0.97


def test_held_out_quarter_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.train(docs, labels.filter(~out))
    held = labels.filter(out).select("doc_id", "quality")
    got = quality.judge(docs.join(held, "doc_id"), model).filter("not base_failed").join(held, "doc_id").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert len(good) > 500 and len(bad) > 30
    assert sum(r["kept"] for r in good) / len(good) > 0.97 and sum(not r["kept"] for r in bad) / len(bad) > 0.9


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a"), (None, "b"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in quality.judge(docs, (np.zeros(quality.N_FEATURES), np.zeros((2, 2)))).collect()] == [big, None, big + 2]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert quality.judge(empty, quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_training_is_bounded_by_lines_and_ids(spark):
    """Rows that repeat a doc_id count once, and of long texts most_lines lines are learned from."""
    import numpy as np

    good = "\n".join(f"The harbour of the town number {k} was quiet and the boats came home before the rain." for k in range(300))
    bad = "\n".join(f"click | share | login | menu {k}" for k in range(300))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    model = quality.train(once, labels, most_lines=50)
    again = quality.train(once.union(once).union(once), labels, most_lines=50)
    assert all(np.array_equal(a, b) for a, b in zip(model, again, strict=True)) and model[0].any()
