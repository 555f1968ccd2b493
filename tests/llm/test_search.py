import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skyframe.llm import search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=10):
    words = [(d, [w.translate(UPPER) for w in re.findall(TERM, t or "")]) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n, length = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        query = {w.translate(UPPER) for w in re.findall(TERM, text or "")}
        found = []
        for d, w in words:
            tf, m = Counter(w), 10 + (90 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in query if t in tf)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ñu", "été", "naïve", "x1"]
    pick = lambda k: [vocabulary[min(int(rng.expovariate(0.03)), len(vocabulary) - 1)] for _ in range(k)]
    docs = [(i * 7 % 1009, rng.choice([" ", ", ", "\n"]).join(pick(rng.randint(1, 120)))) for i in range(n)]
    docs += [(i, t) for i, t in docs[:40]] + [(None, docs[3][1]), (None, None), (5, ""), (6, "--- !"), (2**60 + 1, "W1 w2 W3 été"), (2**60 + 3, "w1 w2 w3 été")]
    items = [(i, " ".join(pick(rng.randint(1, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "w1 w2 w3 Été"), (93, "w1 w2 w3 Été"), (None, "w2 w9")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("segment, block_chars", [(2000, 10**6), (10**7, 10**6), (10**7, 900)])
def test_same_as_brute_force(spark, segment, block_chars):
    docs, items = corpus(700)
    got = search.search(*frames(spark, docs, items), segment=segment, block_chars=block_chars)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_blocks_below_the_threshold_stay_compressed():
    rng = np.random.default_rng(2)
    out = search.Writer(6000, 6000 * 12)
    texts = [" ".join(["the"] * int(rng.integers(1, 4)) + [f"r{int(rng.integers(0, 60))}" for _ in range(10)]) for _ in range(6000)]
    texts[10] = texts[4000] = "r1 r2 r3 r4 r5"
    for i, t in enumerate(texts):
        out.add(i, t.encode())
    batch = out.segment()
    own = search.Segment({c: batch.column(c)[0].as_py() for c in batch.schema.names}, {b"r1": 0, b"r2": 1, b"r3": 2, b"r4": 3, b"r5": 4, b"the": 5})
    query = [(t, 3000) for t in range(5)] + [(5, 10)]
    all_docs, all_scores = own.search(query, 1)
    least = int(np.sort(all_scores)[-2])
    everything = len(own.open)
    own.open.clear()
    docs, scores = own.search(query, least)
    assert set(docs) == {10, 4000} and sorted(scores) == sorted(all_scores[np.isin(all_docs, docs)])
    assert len(own.open) < everything / 3


def test_packing_and_terms():
    v = np.array([0, 1, 127, 128, 300, 2**14, 2**31, 2**40, 0])
    raw, at = search.packed(v)
    assert (search.unpacked(raw) == v).all() and at[-1] == len(raw)
    text = ("Aé1_b-" * 500_000).encode()
    assert [w for part in search.terms(text) for w in part] == [w.translate(UPPER).encode() for w in re.findall(TERM, text.decode())]


def test_long_text_and_totals(spark):
    word = "y" * (search.SLICE - 3) + " " + "z" * 10 + " q" * 50
    docs = [(1, word), (2, "q z"), (3, None), (4, "... ")]
    items = [(1, "q"), (2, "z" * 10)]
    d, i = frames(spark, docs, items)
    assert search.totals(d) == (2, 54)
    assert sorted(map(tuple, search.search(d, i).collect()), key=str) == brute(docs, items)


def test_empty(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.limit(0), items.limit(0)).count() == 0
