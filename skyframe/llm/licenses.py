"""License scans, in DataFrame functions alone.

A text is reduced to its words in lower case, one space between them. Rules are regular expressions over these words,
each gated by a keyword: a rule is only tried on texts that hold its keyword. Texts that hold nothing of what any rule needs
(`may_match`) are skipped as a whole. Detections are intervals. One that lies inside another of the same or better
priority is suppressed (a sweep over the intervals in order of their start, with the furthest end so far for each
priority: linear in the detections of a text).

Priorities: 0 identifiers and addresses, 1 grants ("licensed under ..."), 2 a licence's name with the word licence,
3 names alone and general notices.

Edge cases: a null or empty text has no words, no detections and score 0; texts are scanned whole; rows with the same
doc_id are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import ascii_lower, running, table

#: Fixed by the contract: phrase and label.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Label, keyword, pattern of the name (words in lower case), SPDX identifier as words, address as words.
NAMES = [
    ("mit", "expat", r"expat", r"expat", r"directory fsf org wiki license expat"),
    ("mit", "mit", r"mit(?: x11)?", r"mit(?: 0| cmu| feh)?", r"opensource org licenses mit"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?", r"apache 2 0", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[sc]e)?(?: version)? 1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache", "apache", r"apache(?: software)?", r"apache", r"apache org licenses"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e(?: gpl)?(?: as published by the free software foundation either)?(?: version| v)? 3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e(?: gpl)?(?: as published by the free software foundation either)?(?: version| v)? 2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl", "general public", r"(?:gnu )?general public", r"gpl 1 0(?: only| or later)?", r"gnu org copyleft gpl"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?", r"gplv3", r"gnu org licenses gplv3"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?", r"gplv2", r"gnu org licenses gplv2"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2(?: 1)?", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public", r"lgpl 2 0(?: only| or later)?", r"gnu org copyleft lesser"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public(?: licen[sc]e)?(?: version 3)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", r"gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", r"bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", r"bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)", r"bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)?", r"0bsd", r"opensource org licenses bsd license"),
    ("mpl-2.0", "mozilla", r"mozilla public(?: licen[sc]e)?(?: version| v)? 2(?: 0)?", r"mpl 2 0", r"mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: licen[sc]e)?(?: version| v)? 1 1", r"mpl 1 1", r"mozilla org mpl mpl 1 1"),
    ("mpl", "mozilla", r"mozilla public", r"mpl 1 0", r"mozilla org mpl"),
    ("epl-2.0", "eclipse", r"eclipse public(?: licen[sc]e)?(?: version| v)? 2(?: 0)?", r"epl 2 0", r"eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public(?: licen[sc]e)?(?: version| v)? 1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("epl", "eclipse", r"eclipse public", r"epl", r"eclipse org legal epl"),
    ("edl-1.0", "eclipse", r"eclipse distribution", r"edl 1 0", r"eclipse org org documents edl v10"),
    ("cddl-1.0", "common development", r"common development and distribution", r"cddl 1 [01]", r"opensource org licenses cddl"),
    ("cpl-1.0", "common public", r"common public", r"cpl 1 0", r"opensource org licenses cpl"),
    ("cpal-1.0", "common public attribution", r"common public attribution", r"cpal 1 0", r"opensource org licenses cpal"),
    ("eupl-1.2", "european union public", r"european union public", r"eupl 1 [012]", r"joinup ec europa eu (?:\S+ ){0,4}eupl"),
    ("isc", "isc", r"isc", r"isc", r"opensource org licenses isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib", r"opensource org licenses zlib"),
    ("libpng", "libpng", r"libpng", r"libpng(?: 2 0)?", r"libpng org (?:\S+ ){0,4}license"),
    ("bsl-1.0", "boost", r"boost software", r"bsl 1 0", r"boost org license 1 0"),
    ("busl-1.1", "business source", r"business source", r"busl 1 1", r"mariadb com bsl11"),
    ("artistic-2.0", "artistic", r"artistic(?: licen[sc]e)? 2(?: 0)?", r"artistic 2 0", r"opensource org licenses artistic license 2 0"),
    ("artistic", "artistic", r"artistic", r"artistic 1 0(?: perl| cl8)?", r"opensource org licenses artistic"),
    ("perl", "perl", r"same terms as perl(?: itself)?", r"perl", r"dev perl org licenses"),
    ("python-2.0", "python", r"python(?: software foundation)?", r"(?:psf|python) 2 0", r"python org (?:\S+ ){0,3}license"),
    ("php-3.01", "php", r"php", r"php 3 01?", r"php net license"),
    ("ruby", "ruby", r"ruby", r"ruby", r"ruby lang org (?:\S+ ){0,3}license"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql", r"postgresql org about licen[sc]e"),
    ("openssl", "openssl", r"openssl", r"openssl", r"openssl org source license"),
    ("openldap", "openldap", r"openldap public", r"oldap 2 8", r"openldap org software release license"),
    ("curl", "curl", r"curl", r"curl", r"curl se docs copyright"),
    ("ntp", "ntp", r"ntp", r"ntp(?: 0)?", r"opensource org licenses ntp"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)?", r"w3c(?: 19980720| 20150513)?", r"w3 org consortium legal"),
    ("unicode", "unicode", r"unicode", r"unicode (?:dfs 2016|3 0|tou)", r"unicode org (?:\S+ ){0,3}license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font", r"ofl 1 1", r"scripts sil org ofl"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", r"wtfpl net"),
    ("unlicense", "unlicen", r"unlicen[sc]e", r"unlicense", r"unlicense org"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?", r"cc0 1 0", r"creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] \d)?", r"cc by nc nd [1-4] \d", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] \d)?", r"cc by nc sa [1-4] \d", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] \d)?", r"cc by nc [1-4] \d", r"creativecommons org licenses by nc"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] \d)?", r"cc by nd [1-4] \d", r"creativecommons org licenses by nd"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] \d)?", r"cc by sa [1-4] \d", r"creativecommons org licenses by sa"),
    ("cc-by", "cc by", r"cc by(?: [1-4] \d)?", r"cc by [1-4] \d", r"creativecommons org licenses by"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] \d)?(?: international| unported)?", r"creative commons by nc", r"creativecommons org licenses by nc [1-4]"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] \d)?(?: international| unported)?", r"creative commons by sa", r"creativecommons org licenses by sa [1-4]"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] \d)?(?: international| unported)?", r"creative commons by", r"creativecommons org licenses by [1-4]"),
    ("creative-commons", "creative commons", r"creative commons", r"creative commons", r"creativecommons org licenses"),
    ("odbl-1.0", "open database", r"open database", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution", r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", "open data commons", r"open data commons public domain(?: dedication)?(?: and)?", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("ogl-uk-3.0", "open government", r"open government", r"ogl uk [123] 0", r"nationalarchives gov uk doc open government licen[sc]e"),
    ("sspl-1.0", "server side public", r"server side public", r"sspl 1 0", r"mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", r"elastic(?: licen[sc]e)?(?: 2 0)?", r"elastic 2 0", r"elastic co licensing elastic license"),
    ("openrail", "rail", r"(?:open ?rail|bigscience rail|creativeml open rail)(?: m)?", r"openrail(?: m)?", r"huggingface co spaces bigscience license"),
    ("afl-3.0", "academic free", r"academic free", r"afl [123] [01]", r"opensource org licenses afl"),
    ("osl-3.0", "open software", r"open software", r"osl [123] [01]", r"opensource org licenses osl"),
    ("ms-pl", "microsoft", r"microsoft public", r"ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", r"ms rl", r"opensource org licenses ms rl"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)?(?: open source)?", r"ncsa", r"opensource org licenses ncsa"),
    ("bittorrent-1.1", "bittorrent", r"bittorrent open source", r"bittorrent 1 [01]", r"bittorrent com legal"),
    ("vim", "vim", r"vim", r"vim", r"vimhelp org uganda"),
]

#: Label, keyword, pattern, priority, confidence: notices that go by no licence's name.
NOTICES = [
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put|is) (?:in|in to|into|to) the public domain", 1, 0.9),
    ("public-domain", "public domain", r"public domain", 3, 0.5),
    ("reserved", "rights reserved", r"(?:all|some|no|certain) rights reserved", 2, 0.8),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?", 2, 0.7),
    ("copyright", "copyright", r"copyright (?:by|notice|holder|holders|owner)", 3, 0.5),
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0, 0.98),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 0, 0.98),
    ("bsd", "redistribution and use in", r"redistribution and use in source and binary forms", 0, 0.95),
    ("zlib", "altered source", r"altered source versions must be plainly marked", 0, 0.95),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 1, 0.8),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution)(?: \S+){0,4} (?:prohibited|forbidden)", 1, 0.8),
    ("non-commercial", "commercial use", r"(?:not for|no|non|prohibits|excluding) commercial use", 2, 0.7),
    ("permissive", "free to use", r"(?:you are|is|are) free to use(?: copy)?(?: share)?(?: modify)?", 3, 0.4),
]

GRANTED = "licensed licenced released distributed available published provided shared covered governed".split()
HEAD = rf"(?:{'|'.join(GRANTED)}) (?:to you )?(?:under|by|with) "
GRANT = HEAD + r"(?:a |an |the )?(?:terms (?:and conditions )?of )?(?:a |an |the )?"


def rules() -> list[tuple[str, str, str, int, float]]:
    """Label, keyword, pattern, priority, confidence. Each name gives an identifier, an address, a grant, a reference and a field
("License: MIT"); identifiers with a version also count alone. A keyword is text that every match of its pattern holds."""
    out = []
    for label, key, name, spdx, url in NAMES:
        plain = literal(spdx)
        out.append((label, f"e {plain}" if plain else "licen", rf"licen[sc]e {spdx}", 2, 0.75))
        if versioned(key, spdx):
            out.append((label, f" {plain}", spdx, 3, 0.6))
        out += [(label, "spdx", rf"spdx licen[sc]e identifier {spdx}", 0, 1.0), (label, url.split(" ")[0], url, 0, 0.95), (label, key, GRANT + name + r"(?: (?:public )?licen[sc]e)?", 1, 0.9), (label, key, name + r" (?:public )?licen[sc]es?", 2, 0.8)]
        if alone(key):
            out.append((label, key, name, 3, 0.6))
    return out + NOTICES


def literal(pattern: str) -> str:
    """What a pattern begins with, up to its first choice."""
    return re.match(r"[a-z0-9 ]*(?![?*+])", pattern)[0]


#: Keywords of names whose versions are those of a product as often as of a licence.
PRODUCTS = ("php", "python", "elastic", "bittorrent")


def versioned(key: str, spdx: str) -> bool:
    """Whether an identifier holds a version in any case, so that it counts without the word licence."""
    plain = literal(spdx)
    return key not in PRODUCTS and (re.search(r" \d", plain) is not None or spdx[len(plain) :].startswith("["))


def alone(key: str) -> bool:
    """Whether a name with this keyword counts without a grant or the word licence."""
    return " " in key or key in ("cc0", "gpl", "lgpl", "wtfpl")


def may_match(words: Column) -> Column:
    """False only for words (lower case) in which no rule and no phrase of BASE can match: identifiers and references
    hold 'licen', addresses their first two words, grants HEAD, all else its keyword."""
    needed = {"licen"} | {f" {literal(x)}" for _, k, _, x, _ in NAMES if versioned(k, x)} | {" ".join(u.split(" ")[:2]) for *_, u in NAMES} | {k for _, k, *_ in NAMES if alone(k)} | {k for _, k, *_ in NOTICES} | {p for p, _ in BASE}
    needed = sorted(k for k in needed if not any(o != k and o in k for o in needed))
    gate = F.lit(False)
    for k in needed:
        gate = gate | F.contains(words, F.lit(k))
    grant = F.lit(False)
    for g in GRANTED:
        grant = grant | F.contains(words, F.lit(g + " "))
    return gate | grant & words.rlike(HEAD)


def words_of(text: Column) -> Column:
    """The words of a text between single spaces, with a space before and after; empty without words. Case stays."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return F.when(body == "", "").otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("int")


SPAN = "struct<b:int,e:int>"


def spans(words: Column, pattern: Column) -> Column:
    """Places of a pattern that stand between spaces: array of struct (b, e), its first word and the word after it."""
    marked = F.split(F.regexp_replace(words, F.concat(F.lit("(?<= )("), pattern, F.lit(")(?= )")), F.lit("\x01$1\x02")), "\x01")

    def step(at: Column, piece: Column) -> tuple[Column, Column]:
        end = at["n"] + _spaces(F.call_function("substring_index", piece, F.lit("\x02"), F.lit(1)))
        found = F.when(F.contains(piece, F.lit("\x02")), F.array(F.struct((at["n"] - 1).alias("b"), end.alias("e"))))
        return F.struct((at["n"] + _spaces(piece)).alias("n")), F.coalesce(found, F.expr(f"cast(array() as array<{SPAN}>)"))

    return running(marked, F.struct(F.lit(0).alias("n")), step, SPAN)


HIT = "struct<b:int,neg_e:int,priority:int,label:string,confidence:double>"


def detections(words: Column, table_: list | None = None) -> Column:
    """Unsuppressed detections of the rules in words (lower case)."""
    table_ = rules() if table_ is None else table_
    lit = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(p).alias("pattern"), F.lit(pr).alias("priority"), F.lit(label).alias("label"), F.lit(float(c)).alias("confidence")) for label, k, p, pr, c in table_])
    tried = F.filter(lit, lambda r: F.contains(words, r["key"]))
    hits = F.array_sort(F.flatten(F.transform(tried, lambda r: F.transform(spans(words, r["pattern"]), lambda s: F.struct(s["b"].alias("b"), (-s["e"]).alias("neg_e"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence"))))))
    ends = [f"m{k}" for k in range(4)]  # the furthest end so far, for each priority

    def step(acc: Column, h: Column) -> tuple[Column, Column]:
        inside = F.lit(False)
        for k, m in enumerate(ends):
            inside = inside | ((h["priority"] >= k) & (acc[m] >= -h["neg_e"]))
        state = F.struct(*[F.when(h["priority"] == k, F.greatest(acc[m], -h["neg_e"])).otherwise(acc[m]).alias(m) for k, m in enumerate(ends)])
        return state, F.when(~inside, F.array(h)).otherwise(F.expr(f"cast(array() as array<{HIT}>)"))

    return running(hits, F.struct(*[F.lit(-1).alias(m) for m in ends]), step, HIT)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the contract's columns and hits, the detections with their places among the words."""
    table_ = rules()
    gate = may_match(F.lower("words"))
    df = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    df = df.select("doc_id", F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) - 1).cast("long").alias("n_words"), F.when(gate, ascii_lower(F.col("words"))).alias("words"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    df = df.select("*", *[F.when(F.contains("words", F.lit(f" {p} ")), spans(F.col("words"), F.lit(p))).otherwise(none).alias(f"base{k}") for k, (p, _) in enumerate(BASE)], F.when(F.col("words").isNotNull(), detections(F.col("words"), table_)).otherwise(F.expr(f"cast(array() as array<{HIT}>)")).alias("found"))
    places = F.concat(*[F.transform(f"base{k}", lambda s: s["b"]) for k in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"base{k}") > 0, label) for k, (_, label) in enumerate(BASE)]))
    df = df.withColumns({"places": places, "base": base})
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda h: h["label"]))))
    return df.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda h: h["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("found", lambda h: F.struct(h["label"].alias("label"), h["priority"].alias("priority"), h["b"].cast("long").alias("first_word"), (-h["neg_e"] - 1).cast("long").alias("last_word"))).alias("hits"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("hits")


QUERIES = {"op5_licenses": op5_licenses}
ORACLE: dict[str, str] = {}
