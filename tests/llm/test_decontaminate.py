import os
import random
import subprocess
import sys

import numpy as np

from skyframe.llm import decontaminate as d


def distance_in(p, t):
    """Edits between p and the best part of t."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        s[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
    return "".join(s)


def sentence(rng, n):
    return " ".join("".join(rng.choice(["th", "on", "er", "in", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def windows(text):
    t = d.normal(text)
    return [t] if len(t) <= d.WINDOW else [t[s : s + d.WINDOW] for s in [*range(0, len(t) - d.WINDOW, d.STRIDE), len(t) - d.WINDOW]]


def test_align_is_exact():
    rng = random.Random(2)
    for _ in range(60):
        p, t = sentence(rng, 5), sentence(rng, 12)
        assert d.align(d.codes(p), d.codes(t), len(t) + 1, len(p)) == distance_in(p, t)


def test_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randint(8, 30)).capitalize()) for i in range(12)] + [(50, "Qed xyz"), (51, None), (52, ""), (53, "Tiny")]
    docs = [(0, None), (1, ""), (2, "short"), (None, items[3][1]), (4, "a qed   XYZ b"), (5, "aqed xyz")]
    for i in range(6, 60):
        body = sentence(rng, rng.randint(3, 80))
        if i % 2:
            leak = edited(rng, items[i % 12][1], rng.randint(0, 30))
            at = rng.randint(0, len(body))
            body = rng.choice([body[:at] + leak + "\n  " + body[at:], leak + body, body + leak, leak])
        docs.append((i, body))
    want = set()
    for i, t in docs:
        for k, b in items:
            if t and b and len(d.normal(b)) >= d.Q:
                if any(distance_in(w, d.normal(t)) <= min(int(d.RATE * len(w)), (len(w) - d.Q) // d.Q) for w in windows(b)):
                    want.add((i, k))
            elif t and b and f" {d.normal(b)} " in f" {d.normal(t)} ":
                want.add((i, k))
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block, hits in ((10**6, d.HITS), (600, d.HITS), (10**6, 50)):
        monkeypatch.setattr(d, "HITS", hits)
        got = d.find(df.repartition(3), bench, block_chars=block).collect()
        assert {(r[0], r[1]) for r in got} == want and len(got) == len(want)
    assert len(want) > 15 and (None, 3) in want and (4, 50) in want and (5, 50) not in want


def test_slices_find_what_one_look_finds(monkeypatch):
    rng = random.Random(6)
    index = d.Index([(str(i), sentence(rng, 25)) for i in range(6)] + [("9", "ab" * 100), ("10", "a" * 160)])
    text = sentence(rng, 900)
    for i in range(6):
        at = rng.randint(0, len(text))
        text = text[:at] + edited(rng, d.normal("".join(map(chr, index.window[i]))), 9) + text[at:]
    text += "ab" * 300 + "a" * 500
    whole = index.scan([text, text[100:]])
    monkeypatch.setattr(d, "HITS", 300)
    monkeypatch.setattr(d, "PLACES", 700)
    assert index.scan([text, text[100:]]) == whole and len(whole) > 8


def test_long_repetitive_text_needs_little_memory():
    code = """
import resource
from skyframe.llm import decontaminate as d
index = d.Index([("1", "a" * 160 + "b" * 200)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert index.scan(["a" * 1_000_000]) == [(0, "1", 0, 0)]
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000, "over 1 GB"
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    text = sentence(random.Random(1), 30)
    docs = spark.createDataFrame([(big, text), (None, text), (big + 2, "x")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(big, text), (None, text)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.find(docs, bench).collect()}
    assert got == {(a, b) for a in (big, None) for b in (big, None)}


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "some text of a document")], "doc_id long, text string"), spark.createDataFrame([(1, "some text of a document")], "item_id long, text string")
    assert d.find(docs, bench).count() == 1
    assert d.find(docs.limit(0), bench).count() == 0 and d.find(docs, bench.limit(0)).count() == 0


def test_grams_agree():
    c = d.codes("abcdefghij" * 3)
    assert (d.grams(c)[:10] == d.grams(c)[10:20]).all() and len(np.unique(d.grams(c))) == 10
