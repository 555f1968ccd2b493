"""N-gram Jaccard join by set-relation skipping.

A document's set holds the hashes (64 bits) of its distinct word shingles; two sets link when 100 * intersection >=
percent * union. The result is exact: one row per document with the smallest doc_id that links reach.

Set relations:
- Equal sets are one class; a class is treated once and its members take over its answer.
- A set of which more than (1 - t) n shingles stand in no other set links with nothing. Such sets are found first on a
  fixed share of all shingles (those of some hash values), where it takes no second look at the text, then, among the
  rest, on all of theirs. This leaves the near copies.
- The rest is indexed by its prefix in the global order (rarest shingle first). An index list is parted into blocks by
  set size, overlapping so that each two sets that may link meet in a block; entries of a block whose position shows
  that they can't link with the smallest set of it are skipped, and so are blocks with fewer than two entries left.
- Each block has a leader, the set with the fewest shingles of its own; the others' intersections with it are counted.
  From these answers those of the other sets of the block are derived: a set that links with its leader is of its
  component; and for any two sets, what each differs from the leader by bounds their intersection from both sides, so
  that most pairs are known to link, or not to, without a look at their shingles. Only blocks that hold several
  components are looked at again, with the next leader. After `rounds` rounds, the pairs of different components that
  are left undecided are verified one by one, in parts of about PART sets by PART sets, so that a block of many sets is
  no single task; this finishes exactly what any number of leaders might leave.

No group's pairs are emitted whole, and nothing is collected: components are found by min-label propagation over tables.
Copies meet their class by broadcast where the class is hot (HOT_SHARE bounds how many can be), else by shuffle.

Edge cases: a null text, or one without words, has an empty set, links with nothing and is its own component; a text
with fewer than k words has one shingle, the whole sequence; rows that repeat a doc_id are separate rows of that id; a
null doc_id is never the smallest if there is another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm.common import id_text, small_batches, table, with_long, written

K, PERCENT = 3, 90
SMALL_ROWS = 1_000_000  # text digests are broadcast up to this
HOT_ROWS, HOT_SHARE = 5_000, 1000  # a class is hot from HOT_ROWS rows and a HOT_SHARE-th of all on
PART = 64
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M3
    return h ^ (h >> np.uint64(27))


class Shingler:
    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        try:
            w = [known[x] for x in words]
        except KeyError:
            for x in words:
                if x not in known:
                    known[x] = xxhash.xxh64_intdigest(x)
            w = [known[x] for x in words]
        w = np.array(w, np.uint64)
        m = min(self.k, n)
        h = np.full(n - m + 1, m, np.uint64)
        for j in range(m):
            h = _mixed(h * _M1 + w[j : n - m + 1 + j] * _M2)
        return np.unique(h).view(np.int64)


def linked(both: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * both >= percent * (n + m - both)


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> v, l: the least vertex of each vertex's component."""
    both = written(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "l"), "w").groupBy("v").agg(F.min("l").alias("near"))
        step = labels.join(near, "v").select("v", "l", F.least("l", "near").alias("x"))
        jump = step.join(labels.select(F.col("v").alias("x"), F.col("l").alias("y")), "x").select("v", F.least("x", "y").alias("l"), (F.least("x", "y") < F.col("l")).alias("changed"))
        jump = written(jump, "labels")
        labels = jump.select("v", "l")
        if jump.filter("changed").isEmpty():
            return labels


def _counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, and what else they have) with the size of their sets' intersection, both."""
    one = pairs.join(sets.select(F.col("c").alias("a"), F.col("hashes").alias("ha")), "a")
    two = one.join(sets.select(F.col("c").alias("b"), F.col("hashes").alias("hb")), "b")
    return two.select(*pairs.columns, F.size(F.array_intersect("ha", "hb")).cast("long").alias("both"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """sets (c, n, hashes) -> postings (h, c, n, u, pos) of the prefixes, without shingles that stand in one set only."""
    rows = sets.select("c", "n", F.explode("hashes").alias("h"))
    counts = rows.groupBy("h").agg(F.count("*").alias("df"), F.min("c").alias("c"))
    alone = counts.filter("df = 1").groupBy("c").agg(F.count("*").alias("u"))
    kept = sets.select("c", "n").join(alone, "c", "left").na.fill(0, ["u"]).filter(100 * (F.col("n") - F.col("u")) >= percent * F.col("n"))
    shared = rows.drop("n").join(counts.filter("df > 1").select("h", "df"), "h").join(kept, "c")
    place = F.col("u") + F.row_number().over(Window.partitionBy("c").orderBy("df", "h")) - 1
    return shared.withColumn("pos", place).filter(F.col("pos") <= F.col("n") - F.ceil(percent * F.col("n") / F.lit(100))).select("h", "c", "n", "u", "pos")


def _blocks(postings: DataFrame, percent: int) -> DataFrame:
    """Postings in overlapping blocks by size: entries that can reach the smallest set of their block by position."""
    step = math.log(100 / percent) * 1.0001
    size = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    rows = postings.select("*", F.explode(F.array(size, size + 1)).alias("block"))
    least = rows.groupBy("h", "block").agg(F.count("*").alias("k"), F.min("n").alias("low")).filter("k > 1").drop("k")
    reach = rows.join(least, ["h", "block"]).filter((F.col("n") - F.col("pos") >= _needed(F.col("n"), F.greatest(F.col("low"), F.ceil(percent * F.col("n") / F.lit(100))), percent)))
    return reach.drop("low")


def _may_link(x: str, y: str, percent: int) -> Column:
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    need = _needed(n, m, percent)
    return (n - F.col(f"{x}pos") >= need) & (m - F.col(f"{y}pos") >= need)


def _open(entries: DataFrame) -> DataFrame:
    """Entries of the blocks that hold several components."""
    key = ["h", "block"]
    return entries.join(entries.groupBy(*key).agg(F.min("l").alias("x"), F.max("l").alias("y")).filter("x < y").select(*key), key)


def _relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """labels (v, l) after merged (label, new label), whose labels may be sets that had none of their own."""
    old = labels.join(merged.select(F.col("v").alias("l"), F.col("l").alias("r")), "l", "left").select("v", F.coalesce("r", "l").alias("l"))
    return old.union(merged.join(labels, "v", "left_anti").select("v", "l"))


def _known(x: str, y: str, percent: int) -> tuple[Column, Column]:
    """Whether two entries of a block are known to link, and known not to, by their answers with the block's leaders:
    in a leader's shingles they share at least `a + b - leader`, at most the less of both; elsewhere at most the less of
    what they have there, but for what stands in one set only."""
    need = _needed(F.col(f"{x}n"), F.col(f"{y}n"), percent)
    answers = F.arrays_zip(F.col(f"{x}met").alias("p"), F.col(f"{y}met").alias("q"))
    least = F.aggregate(answers, F.lit(0).cast("long"), lambda m, z: F.greatest(m, z["p"]["both"] + z["q"]["both"] - z["p"]["n"]))
    most = F.aggregate(answers, F.lit(1 << 60).cast("long"), lambda m, z: F.least(m, F.least(z["p"]["both"], z["q"]["both"]) + F.least(F.col(f"{x}n") - F.col(f"{x}u") - z["p"]["both"], F.col(f"{y}n") - F.col(f"{y}u") - z["q"]["both"])))
    return least >= need, most < need


def link(sets: DataFrame, percent: int, rounds: int = 3, part: int = PART) -> DataFrame:
    """sets (c, n, hashes) -> v, l: components of the sets that link with another one."""
    key = ["h", "block"]
    none = F.expr("cast(array() as array<struct<n:long,both:long>>)")
    entries = written(_open(_blocks(_prefixes(sets, percent), percent).withColumns({"l": F.col("c"), "met": none})), "blocks")
    labels = None
    for turn in range(rounds + 1):
        if entries.isEmpty():
            break
        if turn < rounds:
            lead = entries.groupBy(*key).agg(F.min(F.struct((F.col("u") / F.col("n")).alias("o"), "c", "n", "u", "pos", "l", "met")).alias("lead"))
            other = lead.select(*key, *[F.col(f"lead.{x}").alias(y) for x, y in (("c", "b"), ("n", "bn"), ("u", "bu"), ("pos", "bpos"), ("l", "bl"), ("met", "bmet"))])
            pairs = entries.join(other, key).filter("c <> b")
        else:
            # every part of a block meets every part: a pair in the one place that its two parts name
            parts = entries.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts"))
            cut = entries.join(parts, key).withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
            cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            cut = cut.select("*", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
            other = cut.select(*key, "x", "y", F.col("own").alias("bown"), F.col("c").alias("b"), F.col("n").alias("bn"), F.col("u").alias("bu"), F.col("pos").alias("bpos"), F.col("l").alias("bl"), F.col("met").alias("bmet"))
            pairs = cut.join(other, [*key, "x", "y"]).filter((F.col("c") < F.col("b")) & ((F.col("own") != F.col("bown")) | (F.col("x") == F.col("y"))))
        linked_, unlinked = _known("", "b", percent)
        pairs = pairs.withColumns({"sure": linked_, "never": unlinked})
        wanted = pairs.filter((F.col("l") != F.col("bl")) & ~F.col("never") & _may_link("", "b", percent))
        wanted = written(wanted.select(F.col("c").alias("a"), "b", F.col("n").alias("an"), "bn", F.col("l").alias("la"), F.col("bl").alias("lb"), "sure").distinct(), "pairs")
        asked = wanted if turn < rounds else wanted.filter("not sure")
        answers = written(_counted(asked.select("a", "b", "an", "bn", "la", "lb").distinct(), sets), "answers")
        found = answers.filter(linked(F.col("both"), F.col("an"), F.col("bn"), percent)).select("la", "lb").union(wanted.filter("sure").select("la", "lb"))
        if not found.isEmpty():
            # only components that a link joins are looked at; the others keep their label
            merged = components(found.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
            labels = merged if labels is None else written(_relabelled(labels, merged), "labels")
        if turn == rounds:
            break
        # the leaders have met their blocks: what derives its answer from one is in its component now, and the others
        # keep their intersection with it; without one that was counted, they know nothing of it
        seen = answers.select(F.col("a").alias("c"), "b", F.col("bn").cast("long").alias("ln"), "both").dropDuplicates(["c", "b"])
        left = entries.join(other.select(*key, "b"), key).filter("c <> b").join(seen, ["c", "b"], "left")
        known = F.struct(F.coalesce("ln", F.lit(None).cast("long")).alias("n"), F.col("both").alias("both"))
        left = left.withColumn("met", F.concat("met", F.array(known))).select(*entries.columns)
        if labels is not None:
            left = left.drop("l").join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("l", F.coalesce("l", "c"))
        entries = written(_open(left), "blocks")
    return sets.sparkSession.createDataFrame([], "v long, l long") if labels is None else labels


def join(docs: DataFrame, k: int = K, percent: int = PERCENT, rounds: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    return groups(docs, k, percent, rounds).select("doc_id", "n_shingles", "component_id")


def groups(docs: DataFrame, k: int = K, percent: int = PERCENT, rounds: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_md5, n_shingles, component_id and component: a number that is the
    component's own, also where rows repeat a doc_id; null without words."""
    spark = docs.sparkSession
    small_batches(spark)
    share = 4 if percent >= 90 else 3  # of the shingles, a quarter or third is enough to set most documents apart
    text = F.col("text").cast("string")
    rows = docs.select(id_text("doc_id"), text.alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("t"))

    def first(batches):
        shingles = Shingler(k)
        for pdf in batches:
            out = []
            for doc_id, text, t in zip(pdf["doc_id"], pdf["text"], pdf["t"], strict=True):
                h = shingles(text)
                d = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                out.append((doc_id, t, len(h), d[0], d[1], h[h % share == 0]))
            yield pd.DataFrame(out, columns=["doc_id", "t", "n", "f1", "f2", "some"])

    seen = written(with_long(rows.mapInPandas(first, "doc_id string, t string, n long, f1 long, f2 long, some array<long>"), "doc_id"), "shingled")
    same = ["f1", "f2", "n"]
    classes = seen.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.min("t").alias("t"), F.count("*").alias("rows")).withColumn("c", F.monotonically_increasing_id())
    classes = written(classes, "classes")
    # a shingle stands in one set only if all documents that have it are of one class: no copies need to be set aside
    held = seen.select("f1", F.explode("some").alias("h")).groupBy("h").agg(F.min("f1").alias("f1"), F.max("f1").alias("other"))
    alone = held.filter("f1 = other").groupBy("f1").agg(F.count("*").alias("u"))
    left = classes.select("c", "t", *same).join(alone, "f1", "left").filter(100 * (F.col("n") - F.coalesce("u", F.lit(0))) >= percent * F.col("n")).drop("u")
    left = written(left, "near")
    texts = left.select("t").distinct()
    if left.count() <= SMALL_ROWS:
        texts = F.broadcast(texts)

    def second(batches):
        shingles = Shingler(k)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                h = shingles(text)
                d = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                out.append((len(h), d[0], d[1], h))
            yield pd.DataFrame(out, columns=["n", "f1", "f2", "hashes"])

    # one text of each class: those of a class's least text digest
    again = rows.join(texts, "t", "left_semi").dropDuplicates(["t"]).select("text").mapInPandas(second, "n long, f1 long, f2 long, hashes array<long>").dropDuplicates(same)
    sets = written(again.join(left.select("c", *same), same).select("c", "n", "hashes"), "sets")
    labels = link(sets, percent, rounds)
    named = classes.select("c", *same, "least", "rows").join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("component", F.coalesce("l", "c"))
    named = written(named, "named")
    # most components are one class; the others' least ids are few
    roots = named.filter("l is not null").groupBy("component").agg(F.min("least").alias("root"))
    by_class = written(named.join(roots, "component", "left").select(*same, "rows", "component", F.coalesce("root", "least").alias("component_id")), "by-class")
    hot = max(HOT_ROWS, seen.count() // HOT_SHARE)
    base = seen.select("doc_id", "t", *same)
    often = base.join(F.broadcast(by_class.filter(F.col("rows") >= hot).drop("rows")), same, "left")
    rest = often.filter("component is null").select(*base.columns).join(by_class.filter(F.col("rows") < hot).drop("rows"), same, "left")
    out = often.filter("component is not null").unionByName(rest)
    return out.select("doc_id", F.col("t").alias("text_md5"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


QUERIES = {"op2_jaccard": op2_jaccard}
#: Every pair by shared shingles: for small tables.
ORACLE = {
    "op2_jaccard": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
u AS (SELECT r, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
c(r, root) AS (SELECT r, r FROM s UNION SELECT e.y, c.root FROM c JOIN e ON c.r = e.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id FROM c JOIN s ON s.r = c.r JOIN s t ON t.r = c.root GROUP BY c.r, s.doc_id, len(s.sh)
""",
}
