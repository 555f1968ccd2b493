import random
import re
from collections import Counter, defaultdict

from skyframe.llm import linededup as d


def tokens(line):
    t = ["<*>" if re.search("[0-9]", x) else x for x in re.sub(r"[ \t\r\x0b\f]+", " ", line).strip(" ").split(" ")]
    return [] if t == [""] else t


def templates(docs, min_docs, support=0.1, variable=0.4):
    """For each document, for each line: its tokens and its templates."""
    all_ = [[tokens(x) for x in (t or "").split("\n")] for _, t in docs]
    leaf = lambda t: (len(t), *t[: min(len(t) // 8 + 1, 3)])
    count, at = Counter(), Counter()
    for own in all_:
        for t in own:
            if len(t) > 3:
                count[leaf(t)] += 1
                at.update((leaf(t), i, x) for i, x in enumerate(t))

    def keys(t):
        if not t:
            return []
        out = [("all", *t)]
        if len(t) > 3:
            m = ["<*>" if at[leaf(t), i, x] < max(min_docs, support * count[leaf(t)]) else x for i, x in enumerate(t)]
            free = sum(at[leaf(t), i, x] < max(min_docs, support * count[leaf(t)]) for i, x in enumerate(t))
            if 0 < free <= int(variable * len(t)) and len(t) - free >= d.MIN_CONSTANT:
                out.append(("tree", *m))
        return out

    return [[(len(t), keys(t)) for t in own] for own in all_]


def brute(docs, min_docs, copy_share=0.5, near_share=0.8, min_share=0.05):
    lines = templates(docs, min_docs)
    held = defaultdict(set)
    for i, own in enumerate(lines):
        for _, ks in own:
            for k in ks:
                held[k].add(i)
    again = {k for k, v in held.items() if len(v) >= min_docs}
    votes = Counter()
    for own in lines:
        total, rest = sum(n for n, _ in own), sum(n for n, ks in own if again & set(ks))
        for k in again & {k for _, ks in own for k in ks}:
            mine = sum(n for n, ks in own if k in ks)
            votes[k] += not (rest - mine >= copy_share * (total - mine) or mine >= near_share * total)
    gone = {k for k in again if votes[k] >= max(min_docs, min_share * len(held[k]))}
    return [(i, None if t is None else "\n".join(x for x, (_, ks) in zip(t.split("\n"), own, strict=True) if not gone & set(ks))) for (i, t), own in zip(docs, lines, strict=True)]


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    own = lambda n: " ".join(word() for _ in range(n))
    long = [word() for _ in range(16)]
    docs = [(0, None), (1, ""), (2, "\n\n"), (None, "All rights of X1 reserved  here"), (4, "  ")]
    for i in range(5, 60):
        lines = [own(rng.randint(1, 20)) for _ in range(rng.randint(2, 8))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, 2), f"All rights of Y{i}\treserved here")
        if i % 4 == 0:
            lines.append(" ".join(long[:12] + [word(), word()] + long[14:]))
        if i % 2:
            lines.insert(1, f"Posted by {word()} in {word()}")
        if i % 5 == 0:
            lines.append(f"Hello {word()} welcome back")
        docs.append((i, "\n".join(lines)))
    copy = "\n".join(own(9) for _ in range(6))
    docs += [(100 + i, copy if i % 2 else copy.replace("a", "b", i)) for i in range(20)] + [(100, copy)]
    passage = own(60)
    docs += [(200 + i, passage + "\n" + own(30)) for i in range(8)]  # distinct short documents
    return docs, long, copy, passage


def test_brute_force(spark):
    docs, long, copy, passage = corpus()
    df = spark.createDataFrame([(i, t, i, "z") for i, t in docs], "doc_id long, text string, row long, lines string")
    out = d.drop_lines(df.repartition(3))
    assert out.columns == ["doc_id", "text", "row", "lines", "dedup"]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter(brute(docs, 5))
    assert got[1, ""] == 1 and got[None, ""] == 1 and got[100, copy] == 2
    text = "\n".join(t for _, t in got if t)
    assert not any(x in text for x in ("rights", " ".join(long[:12]), "Posted by", "welcome back", passage))


def test_hot_templates(spark, monkeypatch):
    docs, *_ = corpus()
    monkeypatch.setattr(d, "HOT_ROWS", 10)
    monkeypatch.setattr(d, "HOT_SHARE", 1000)
    monkeypatch.setattr(d, "SMALL_ROWS", 0)
    got = Counter((r["doc_id"], r["text"]) for r in d.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == Counter(brute(docs, 5))


def test_short_lines_in_the_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = [own(20) + ("\nThe same long line stands here\nLes." if i < 8 else f"\nown{chr(97 + i)}") + ("\n\nAnd ornd." if i < 5 else "\nOnly four" if i < 9 else "") for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    gone = {"The same long line stands here", "Les.", "And ornd."}
    assert got == {i: "\n".join(x for x in t.split("\n") if x not in gone) for i, t in enumerate(texts)}
    assert sum("Only four" in t for t in got.values()) == 4 and got[0].endswith("\n")


def test_very_long_text(spark):
    """Twenty thousand recurring lines in one text, and a line of fifty thousand tokens."""
    rng = random.Random(1)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    docs = [(i, own(60) + "\nThis line recurs here") for i in range(6)] + [(9, ("This line recurs here\n" + own(2) + "\n") * 20_000 + own(50_000))]
    got = {r["doc_id"]: (r["text"], r["dedup"]["n_dropped"]) for r in d.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[9][1] == 20_000 and "recurs" not in got[9][0] and got[9][0].count("\n") == 20_000 and all(got[i][1] == 1 for i in range(6))


def test_empty(spark):
    assert d.drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
