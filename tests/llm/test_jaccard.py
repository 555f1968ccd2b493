import random
import re

import pytest

from skyframe.llm import jaccard


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["The", "of", "é\x1c"]
    docs = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "a b"), (5, "A\tB"), (6, "x a b"), (7, "É b c d"), (8, "é b c d"), (None, "alone  here"), (9, "same"), (9, "other words here")]
    passage = [rng.choice(words) for _ in range(40)]
    at = 100
    for size in (20, 45, 80, 200):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for j in range(rng.choice([1, 3, 12])):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 25)) if j else 0):
                    p = rng.randrange(len(w))
                    w[p : p + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
                docs.append((at, " ".join(w)))
                at += 1
        docs += [(at + i, " ".join(passage + [rng.choice(words) for _ in range(i)])) for i in range(6)]
        at += 10
    docs += [(at + i, docs[40][1]) for i in range(5)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("k", "percent", "rounds"), [(3, 90, 3), (3, 90, 0), (5, 80, 1)])
def test_brute_force(spark, k, percent, rounds):
    docs = corpus(k)
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n long").repartition(3)
    got = sorted((tuple(r) for r in jaccard.join(df, k, percent, rounds).collect()), key=str)
    assert got == brute(docs, k, percent)
    assert len({c for _, _, c in got}) < len(docs) - 20


def test_hot_classes_and_parts(spark, monkeypatch):
    docs = corpus(5)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 3)
    monkeypatch.setattr(jaccard.link, "__defaults__", (3, 2))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for rounds in (0, 2):
        assert sorted((tuple(r) for r in jaccard.join(df, 3, 80, rounds).collect()), key=str) == brute(docs, 3, 80)


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "a b c d"), (None, "a b c d"), (big + 2, "e f g h"), (big + 4, "e f g h")], "doc_id long, text string").coalesce(1)
    got = sorted((tuple(r) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(big, 2, big), (None, 2, big), (big + 2, 2, big + 2), (big + 4, 2, big + 2)], key=str)


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
