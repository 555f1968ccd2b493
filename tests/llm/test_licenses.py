import random
import re

from skyframe.llm import licenses

TEXTS = [
    "Licensed under CC BY-NC 4.0.\nAll rights reserved. cc by cc  BY",
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: MIT",
    "nothing to see", "", None, "...", "den mit und der", "CC BY", "accc by", "ccé by", "all rights reserved all rights reserved",
]


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    at = [i for p, _ in licenses.BASE for i in range(len(w)) if w[i] == p.split()[0] and w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min(at), max(at)


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    hits = []
    text = " " + " ".join(w) + " " if w else ""
    for label, key, pattern, prio, conf in licenses.rules():
        if key in text:
            hits += [(m.start(), m.end(), prio, label, conf) for m in re.finditer(f"(?<= )(?:{pattern})(?= )", text)]
    kept = [h for h in hits if not any(o != h and o[0] <= h[0] and o[1] >= h[1] and (o[2] < h[2] or o[2] == h[2] and ((o[0], o[1]) != (h[0], h[1]) or o[3:] < h[3:])) for o in hits)]
    base = {x for _, x in at}
    return (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | {h[3] for h in kept})), max([0.0, *(h[4] for h in kept)]))


def test_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:8] for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), t
    assert "mit" in got[2][5] and "apache-2.0" in got[3][5] and got[0][5].split(",") == ["cc-by", "cc-by-nc", "reserved"]


def test_many_rules_and_empty(spark):
    assert len(licenses.rules()) > 200
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string, words string")).count() == 0


def test_no_rule_is_kept_from_a_text(spark):
    """Every address, and every grant of every name, alone in a text."""
    texts = ["this code is provided under the MIT terms", "https://www.eclipse.org/legal/epl-v10.html", "mariadb.com/bsl11", "bittorrent.com/legal", "gnu.org/copyleft/lesser", "w3.org/Consortium/Legal"]
    texts += [f"see https://{re.sub('[(]?[?]:.*', '', u)}" for *_, u in licenses.NAMES]
    texts += [f"it is {g} {to}{how} the {k} terms" for g in licenses.GRANTED for to in ("", "to you ") for how in ("under", "by", "with") for k in ("MIT", "BSD", "zlib", "ISC", "Python", "PHP", "curl", "OpenSSL")]
    texts += ["provided without a name", "mit und bsd", "eclipse organ", "shared with perl friends", "available under the same terms as Perl itself", "it is free to use", "permission to use copy modify and or distribute this software for any purpose with or without fee"]
    got = {r[0]: tuple(r)[1:8] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
    assert [got[i][5] for i in range(6)] == ["mit", "epl-1.0", "busl-1.1", "bittorrent-1.1", "lgpl", "w3c"]


def test_forms_from_outside_the_table(spark):
    """Texts as they are found, not made from the rules."""
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "License: MIT": "mit", "licence: BSD-3-Clause": "bsd-3-clause", "Apache-2.0": "apache-2.0", "(MPL-2.0)": "mpl-2.0", "license = \"GPL-3.0-or-later\"": "gpl-3.0",
        "under the Expat license": "mit", "the GNU Library General Public License": "lgpl", "LGPL-2.1-only": "lgpl-2.1", "License: Unlicense": "unlicense", "EUPL-1.2": "eupl-1.2",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    }
    got = {r[0]: r["labels"].split(",") for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (t, label) in enumerate(texts.items()):
        assert label in got[i], (t, got[i])
    clean = ["Python 2.0 was released in 2000", "PHP 3.0", "der Zug mit 2 Wagen", "the mit lab", "Elastic 2.0 is a server", "unicode 3.0"]
    assert {r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")).collect()} == {""}


def test_keywords_are_part_of_their_patterns():
    """Every keyword is in each text that its pattern makes: no choice of a pattern goes without it."""
    for label, key, pattern, *_ in licenses.rules():
        plain = [pattern]
        while any("(?:" in p or "[" in p or "?" in p for p in plain):
            p = next(p for p in plain if "(?:" in p or "[" in p or "?" in p)
            plain.remove(p)
            if m := re.search(r"\(\?:([^()]*)\)(\{0,\d\}|\?)?", p):
                plain += {p[: m.start()] + c + p[m.end() :] for c in [*m[1].split("|"), *[""] * bool(m[2])]}
            elif m := re.search(r"\[([^]]*)\]", p):
                plain += [p[: m.start()] + c + p[m.end() :] for c in m[1].replace("1-4", "1")]
            else:
                m = re.search(r"(.)\?", p)
                plain += [p[: m.start()] + p[m.end() :], p[: m.start()] + m[1] + p[m.end() :]]
            if len(plain) > 300:
                plain = plain[:300]
        assert all(key in f" {p} " for p in plain), (label, key, pattern)


def test_very_long_text(spark):
    """Twenty thousand detections in one text."""
    rng = random.Random(2)
    text = " ".join(rng.choice(["released under the MIT license", "all rights reserved", "cc by", "w3c software license", "it is free to use", "the gnu gpl v3"]) + " x" * rng.randint(1, 9) for _ in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = licenses.scan_licenses(docs).first()
    assert tuple(row)[1:5] == brute_base(text) and len(row["hits"]) >= 20_000
    w = text.lower().split()
    assert all(w[h["first_word"]] in "released all cc w3c is the gnu".split() for h in row["hits"][::97])
    assert {"mit", "reserved", "cc-by", "w3c", "gpl-3.0"} <= set(row["labels"].split(","))
