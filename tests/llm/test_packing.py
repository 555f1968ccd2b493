import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skyframe.llm import packing


def best_fit(lengths, cap):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(cap - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def test_plan():
    rng = random.Random(3)
    for cap, top, n in [(10, 10, 50), (32, 20, 300), (64, 64, 500), (100, 30, 1000), (2048, 2048, 800), (2048, 900, 3000), (7, 7, 1)]:
        lengths = [rng.randint(1, top) for _ in range(n)]
        got = packing.plan({x: lengths.count(x) for x in set(lengths)}, cap)
        assert sum(k for _, k in got) <= best_fit(lengths, cap)
        assert all(sum(c) <= cap and k > 0 for c, k in got)
        assert sorted(x for c, k in got for _ in range(k) for x in c) == sorted(lengths)
    assert packing.plan({}) == []
    for _ in range(40):  # the indexes find a complement whenever there is one
        left = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 12))}
        filled, rest = packing.exact(left, 30)
        assert all(sum(c) == 30 for c, _ in filled)
        assert not any(sum(c) == 30 and all(rest[x] >= c.count(x) for x in c) for m in (1, 2, 3, 4) for c in itertools.combinations_with_replacement(rest, m))
    assert sum(k for _, k in packing.plan({3: 10**12, 5: 10**12, 8: 1}, 8)) == 10**12 + 1


def check(rows, docs, cap):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(str((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))) for i, x in docs for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 0]] for k, (s, n) in enumerate(packing.cut(len(ids), cap)))
    assert sorted(str(tuple(r)[:5]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= cap
    return by


def test_pack(spark):
    rng = random.Random(5)
    texts = [None, "", "Hello  world!\n\n été <|endoftext|> 漢字 \U0001f600 'll", " ".join(str(rng.random()) for _ in range(900)), "a" * 3000] + [" ".join(rng.choice(["the", "ération", "für", "x1"]) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["same text again"] * 40
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, piece string")
    for cap in (64, 2048):
        by = check(packing.pack(df, cap).collect(), docs, cap)
        assert len(by) > 1
    assert packing.pack(df.limit(0)).count() == 0


def test_special_tokens_and_large_ids(spark):
    encode = packing.encoder()
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a{0}b1{0}2 {0} {0}{0}!{0}\n{0}".format(chr(c)) for c in range(0, 0x3000, 7)] + [" " * 5000 + "x", "a<|endoftext|>", "<|endoftext|>" * 3, "<|endoftext"]
    assert all(encode(x).tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "a"), (None, "b"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    assert sorted(r["doc_id"] or 0 for r in packing.pack(df).collect()) == [0, big, big + 2]


def test_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    docs = [(i, "same") for i in range(700)] + [(1000 + i, "x " * i) for i in range(40)]
    check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), 16).collect(), docs, 16)


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)] and packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]
