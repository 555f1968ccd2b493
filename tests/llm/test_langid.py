import os
import zlib

import pytest

from skyframe.llm import langid
from skyframe.llm.common import table

WORDS = {"en": "the and with which there house", "de": "der und nicht auch über häuser", "fr": "les des être où très maisons", "es": "los ñandú está con también casas", "sv": "och är inte också hus på"}


def text(lang, i):
    w = WORDS[lang].split()
    return " ".join(w[(i * 7 + k * k) % len(w)] for k in range(5 + i % 20)).capitalize() + "."


def test_held_out_accuracy(spark):
    rows = [(i, text(g, i), g, "s") for i in range(250) for g in [list(WORDS)[i % 5]]] + [(None, "the house", None, "s"), (900, None, "en", "s"), (901, "", "en", None), (902, "12 34!", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs.select("doc_id", "text", "lang", langid.held_out(docs.doc_id).alias("held_out")), langid.train(docs)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(250)) and by[None]["held_out"] is False
    out = [by[i]["lang_pred"] == by[i]["lang"] for i in range(250) if by[i]["held_out"]]
    assert len(out) > 30 and sum(out) / len(out) > 0.95
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert langid.train(docs) is None
    assert langid.identify(docs, None).first()["lang_pred"] == "und"
    assert langid.identify(docs.limit(0), None).count() == 0


def test_held_out_documents_of_the_tables(spark):
    """Each step by itself: the family, and the language of those whose family is right."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    docs = table(spark, sf, "documents")
    got = langid.identify(docs.filter(langid.held_out(docs.doc_id)), langid.train(docs)).filter("lang is not null and lang_pred <> 'und'").collect()
    right = [langid.family(r["lang"]) == langid.family(r["lang_pred"]) for r in got]
    within = [r["lang"] == r["lang_pred"] for r, ok in zip(got, right, strict=True) if ok]
    assert len(got) > 150 and sum(right) / len(got) > 0.97 and sum(within) / len(within) > 0.97


def test_large_ids_and_clashing_columns(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "the house", "en", "a"), (None, None, None, "b"), (big + 2, "das haus", "de", "c")], "doc_id long, text string, lang string, found string").coalesce(1)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert [(r["doc_id"], r["found"]) for r in got] == [(big, "a"), (None, "b"), (big + 2, "c")]
