"""Line dedup by a log-template tree, in DataFrame functions alone.

Tokens of a line that hold a digit are variable fields, written <*>. The tree has a fixed depth: a line goes to a leaf by
its number of tokens and its leading tokens (1, from 8 tokens on 2, from 16 on 3). Within a leaf a token is constant if
at least `support` of the leaf's lines, and `min_docs` of them, have it at its place; the other places are variable. A
line's templates are the line with its fields masked and, if its leaf leaves it between one and `variable` of its tokens
variable and at least MIN_CONSTANT constant, the line with these masked too.

A template recurs if it is found in `min_docs` documents. Copies of a document don't make its lines boilerplate: a
document votes on a template unless recurring lines make up `copy_share` of its other words, or the template's own lines
`near_share` of all its words. A template is dropped if `min_docs` documents, and `min_share` of all that hold it, vote.
Dropped lines go from all documents, copies included.

Counts are by hash of template, pre-aggregated before the shuffle; texts meet only the numbers of their own lines.
Templates that very many lines have are joined by broadcast (HOT_SHARE bounds how many there can be), others by shuffle.

Edge cases: a null text stays null and an empty one empty; a line without tokens has no template and stays; a line that
repeats within a document counts once for its template; rows with the same doc_id are separate rows; lines are parted
by \\n and kept as they are, a text whose lines are all dropped gets empty; an empty table gives no rows; all other
columns are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import bound, table, upto, written

MIN_CONSTANT = 3
SMALL_ROWS = 2_000_000  # keys of 8 bytes are broadcast up to this, else both sides are shuffled
HOT_ROWS, HOT_SHARE = 50_000, 1000  # a template is hot from HOT_ROWS documents and a HOT_SHARE-th of all on


def masked(line: Column) -> Column:
    """Single spaces, and <*> for tokens with a digit."""
    even = F.when(line.rlike(r"[\t\r\x0B\f]|  |^ | $"), F.trim(F.regexp_replace(line, r"[ \t\r\x0B\f]+", " "))).otherwise(line)
    return F.when(even.rlike("[0-9]"), F.regexp_replace(even, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(even)


def lines_of(text: Column) -> Column:
    """For each line: w, its tokens, whole, the hash of its masked tokens, and leaf; null where it has none."""
    lines = F.transform(F.split(text, "\n", -1), masked)
    counted = F.transform(lines, lambda m: F.struct(m.alias("m"), F.when(m == "", 0).otherwise(F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1).alias("w")))

    def keys(s: Column) -> Column:
        leading = F.call_function("substring_index", s["m"], F.lit(" "), F.least(F.floor(s["w"] / 8).cast("int") + 1, F.lit(3)))
        leaf = F.when(s["w"] > MIN_CONSTANT, F.xxhash64(F.lit("leaf"), s["w"], leading))
        return F.struct(s["w"].alias("w"), F.when(s["w"] > 0, F.xxhash64(s["m"])).alias("whole"), leaf.alias("leaf"))

    return F.transform(counted, keys)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _met(rows: DataFrame, keys: DataFrame, key: str, hot: int) -> DataFrame:
    """rows joined with keys (key, docs). Hot keys are broadcast, so that their rows stay where they are."""
    often = F.broadcast(keys.filter(F.col("docs") >= hot))
    return rows.join(often, key).unionByName(rows.join(keys.filter(F.col("docs") < hot), key))


def tree_keys(keyed: DataFrame, min_docs: int, support: float, variable: float) -> DataFrame:
    """keyed (row, doc, lines) -> row, at, w, key: the lines that their leaf gives a template with variable tokens."""
    leaves = keyed.select("row", F.explode("lines.leaf").alias("leaf")).filter("leaf is not null").groupBy("leaf").agg(F.count("*").alias("lines"), F.min("row").alias("a"), F.max("row").alias("b"))
    leaves = written(leaves.filter((F.col("lines") >= min_docs) & (F.col("a") < F.col("b"))).select("leaf", "lines"), "leaves")
    lines = keyed.select("row", F.posexplode(F.arrays_zip(F.split("doc.text", "\n", -1).alias("line"), "lines")).alias("at", "x")).select("row", "at", "x.line", "x.lines.w", "x.lines.leaf")
    lines = lines.join(_small(leaves), "leaf").select("leaf", "lines", "row", "at", "w", F.split(masked(F.col("line")), " ", -1).alias("tokens"))
    lines = written(lines, "leaf-lines")
    places = lines.select("leaf", "lines", "w", F.posexplode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("at", "token"))
    counts = places.groupBy("leaf", "lines", "w", "at", "token").agg(F.count("*").alias("n"))
    constant = F.when((F.col("n") >= min_docs) & (F.col("n") >= support * F.col("lines")), F.col("token"))
    by_place = counts.groupBy("leaf", "w", "at").agg(F.collect_list(constant).alias("constant"))  # 1 / support tokens at most
    able = by_place.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "constant")))["constant"].alias("constant"), F.first("w").alias("w"))
    held = F.size(F.filter("constant", lambda c: F.size(c) > 0))
    able = written(able.filter((held >= MIN_CONSTANT) & (F.col("w") - held <= F.floor(variable * F.col("w")))).select("leaf", "constant"), "constants")
    fixed = F.zip_with("tokens", "constant", lambda t, c: F.when(F.array_contains(c, F.xxhash64(t)), t))
    rows = lines.join(able, "leaf").select("row", "at", "w", fixed.alias("fixed"))
    free = F.size(F.filter("fixed", lambda t: t.isNull()))
    rows = rows.filter((free > 0) & (free <= F.floor(variable * F.col("w"))) & (F.col("w") - free >= MIN_CONSTANT))
    return rows.select("row", "at", "w", F.xxhash64(F.lit("tree"), F.array_join("fixed", " ", "<*>")).alias("key"))


def drop_lines(docs: DataFrame, min_docs: int = 5, copy_share: float = 0.5, near_share: float = 0.8, min_share: float = 0.05, support: float = 0.1, variable: float = 0.4) -> DataFrame:
    """docs with text -> the same columns with text replaced, then n_lines and n_dropped in a struct `dedup`."""
    keyed = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"), lines_of(F.col("text")).alias("lines")), "lines")
    hot = max(HOT_ROWS, keyed.count() // HOT_SHARE)
    totals = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["w"])
    votes = keyed.select(F.explode(F.array_distinct("lines.whole")).alias("key"))
    whole = written(votes.filter("key is not null").groupBy("key").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs), "whole")
    lines = keyed.select("row", F.posexplode("lines").alias("at", "line")).select("row", "at", "line.w", F.col("line.whole").alias("key"))
    tree = written(tree_keys(keyed, min_docs, support, variable), "tree")
    tree_docs = tree.select("row", "key").distinct().groupBy("key").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    found = written(_met(lines, whole, "key", hot).unionByName(_met(tree, tree_docs, "key", hot)), "recurring")
    in_row = found.select("row", "at", "w").distinct().groupBy("row").agg(F.sum("w").alias("again"))
    in_row = in_row.join(keyed.select("row", totals.alias("total")), "row")
    held = found.groupBy("row", "key", "docs").agg(F.sum("w").alias("own")).join(in_row, "row")
    copy = (F.col("again") - F.col("own") >= copy_share * (F.col("total") - F.col("own"))) | (F.col("own") >= near_share * F.col("total"))
    voted = held.filter(~copy).groupBy("key", "docs").agg(F.count("*").alias("voters"))
    boilerplate = written(voted.filter((F.col("voters") >= min_docs) & (F.col("voters") >= min_share * F.col("docs"))).select("key", "docs"), "boilerplate")
    gone = _met(found.drop("docs"), boilerplate, "key", hot).groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    out = keyed.select("row", "doc").join(gone, "row", "left").withColumn("split", F.split("doc.text", "\n", -1))
    split = F.col("split")
    # the lines between two dropped ones, place by place: linear in the lines
    ends = F.concat("gone", F.array(F.size(split)))

    def lines_between(z: Column) -> Column:
        after = lambda k: F.coalesce(F.get(z["ends"], k - 1), F.lit(-1)) + 1
        return F.flatten(F.transform(z["ends"], lambda g, k: F.transform(upto(after(k), g), lambda i: F.get(z["split"], i))))

    left = bound(F.struct(split.alias("split"), ends.alias("ends")), lines_between)
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(left, "\n"))
    dedup = F.struct(F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns], dedup.alias("dedup"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "dedup.n_lines", "dedup.n_dropped")


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE = {
    "op4_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL),
tk AS MATERIALIZED (SELECT *, list_transform(list_filter(string_split_regex(line, '[ \t\r\x0B\f]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM ln),
lf AS MATERIALIZED (SELECT r, i, t, len(t) AS n, len(t) || ' ' || array_to_string(t[1:least(len(t) // 8 + 1, 3)], ' ') AS leaf FROM tk WHERE len(t) > 3),
lv AS (SELECT leaf, count(*) AS k FROM lf GROUP BY leaf HAVING count(*) >= 5 AND count(DISTINCT r) > 1),
ps AS (SELECT leaf, k, unnest(t) AS tok, unnest(range(1, n + 1)) AS p FROM lf JOIN lv USING (leaf)),
co AS (SELECT leaf, p, tok FROM ps GROUP BY leaf, k, p, tok HAVING count(*) >= 5 AND count(*) >= 0.1 * k),
lt AS (SELECT r, i, n, leaf, unnest(t) AS tok, unnest(range(1, n + 1)) AS p FROM lf JOIN lv USING (leaf)),
tr AS (SELECT r, i, n, 'tree ' || string_agg(CASE WHEN co.p IS NULL THEN '<*>' ELSE lt.tok END, ' ' ORDER BY lt.p) AS k FROM lt LEFT JOIN co ON co.leaf = lt.leaf AND co.p = lt.p AND co.tok = lt.tok
  GROUP BY r, i, n HAVING n > count(co.p) AND n - count(co.p) <= floor(0.4 * n) AND count(co.p) >= 3),
ky AS MATERIALIZED (SELECT r, i, len(t) AS n, 'all ' || array_to_string(t, ' ') AS k FROM tk WHERE len(t) > 0 UNION ALL SELECT r, i, n, k FROM tr),
hd AS (SELECT k, count(DISTINCT r) AS docs FROM ky GROUP BY k HAVING count(DISTINCT r) >= 5),
fd AS MATERIALIZED (SELECT r, i, n, k, docs FROM ky JOIN hd USING (k)),
tot AS (SELECT r, sum(len(t)) AS total FROM tk GROUP BY r),
ag AS (SELECT r, sum(n) AS again FROM (SELECT DISTINCT r, i, n FROM fd) GROUP BY r),
ow AS (SELECT r, k, docs, sum(n) AS own FROM fd GROUP BY r, k, docs),
vt AS (SELECT k FROM ow JOIN ag USING (r) JOIN tot USING (r) WHERE again - own < 0.5 * (total - own) AND own < 0.8 * total GROUP BY k, docs HAVING count(*) >= 5 AND count(*) >= 0.05 * docs),
dr AS (SELECT DISTINCT r, i FROM ky JOIN vt USING (k)),
out AS (SELECT ln.r, string_agg(CASE WHEN dr.i IS NULL THEN line END, chr(10) ORDER BY ln.i) AS kept, count(*) AS n_lines, count(dr.i) AS n_dropped FROM ln LEFT JOIN dr ON ln.r = dr.r AND ln.i = dr.i GROUP BY ln.r)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM d LEFT JOIN out USING (r)
""",
}
