import random

import corpus_pipeline
from skyframe.llm import packing
from test_decontaminate import windows
from test_decontaminate import distance_in
from test_jaccard import brute as near_brute
from test_linededup import brute as line_brute
from test_packing import check

WORDS = {"en": "the and with which there house about people water".split(), "de": "der und nicht auch über häuser leute wasser ganz".split(), "fr": "les des être où très maisons gens eau aussi".split()}


def corpus():
    rng = random.Random(8)
    text = lambda g, n: " ".join(rng.choice(WORDS[g]) + rng.choice(["", "", "s", "er", "ung"]) + str(rng.randint(0, 9)) * (rng.random() < 0.05) for _ in range(n))
    docs = []
    for i in range(120):
        g = rng.choice(list(WORDS))
        lines = [text(g, rng.randint(4, 30)) for _ in range(rng.randint(2, 6))]
        if i % 4 == 0:
            lines.append("Subscribe to our newsletter now")
        docs.append([i, "\n".join(lines), g, f"s{i % 3}"])
    for i in range(120, 150):
        docs.append([i, ("extra " if i % 2 else "") + docs[i % 7][1], "en", "copy"])
    docs += [[150, None, "en", "x"], [151, "12 !", "en", "x"], [152, "", None, "x"], [153, "Subscribe to our newsletter now", "en", "x"], [5, docs[5][1], "en", "again"]]
    bench = [(k, text("en", 22)) for k in range(5)]
    for i in range(90, 95):
        docs[i][1] += "\n" + bench[i - 90][1].upper()
    return [(*d, len(d[1]) if d[1] is not None else None) for d in docs], bench


def test_stages_and_run(spark, tmp_path):
    docs, bench = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(docs, schema)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, got = df, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        kept = spark.read.parquet(f"{tmp_path}/out{k}")
        got[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in kept.collect()])
        if k < 4:
            assert kept.dtypes == df.dtypes

    rows, out = got["language_id"]
    assert sorted(out, key=str) == sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=str)

    rows, out = got["line_dedup"]
    want = [(r[0], t, r[2], r[3], len(t)) for r, (_, t) in zip(rows, line_brute([r[:2] for r in rows], 5), strict=True) if t == r[1] or t.strip()]
    assert sorted(out) == sorted(want) and not any("newsletter" in r[1] for r in out) and len(out) == len(rows) - 1

    rows, out = got["near_duplicates"]
    comp = near_brute([(i, r[1]) for i, r in enumerate(rows)], 5, 80)
    groups = {}
    for i, _, c in comp:
        groups.setdefault(c, []).append(rows[i])
    ids = sorted(min(r[0] for r in g) for g in groups.values())
    assert sorted(r[0] for r in out) == ids and set(out) <= set(rows) and len(out) < len(rows) - 20

    rows, out = got["decontamination"]
    clean = [r for r in rows if not any(distance_in(w, " ".join(r[1].lower().split())) <= len(w) // 10 for _, b in bench for w in windows(b))]
    assert sorted(out) == sorted(clean) and len(rows) - len(out) == 5

    rows, _ = got["best_fit_packing"]
    check(kept.collect(), [r[:2] for r in rows], packing.CAP)

    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.columns == kept.columns and again.count() == kept.count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
