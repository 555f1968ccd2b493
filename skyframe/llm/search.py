"""Ranked lexical search by Block-Max WAND over a written index of compressed posting blocks.

The index is cut into segments, as many documents of a partition as have about SEGMENT terms; a segment is a row of a
written table and is complete in itself, so postings are never shuffled. Each term's postings stand in blocks of BLOCK:
gaps of documents and term counts as variable-length bytes, and beside them, uncompressed, the block's first and last
document and the largest impact in it. Impacts need the number and mean length of all documents, which a first pass
counts.

A query's terms are looked up in each segment, and their pointers are moved over its documents: short lists (one block)
are opened, of all others only the blocks' ends and largest impacts are read (shallow moves). A document at which the sum
of these reaches the threshold, the tenth score so far, is a pivot. Then lists are moved to the pivots, the one with
the largest impact first: only blocks that hold pivots are decompressed, exact impacts take the place of the largest ones,
and the pivots below the threshold go, so that later lists skip more. What stays has its exact score. All pivots of a
segment are moved together (numpy) rather than one after the other; the skipping is the same. Thresholds go on from
segment to segment of a task, and start from those of a first search in the first segments of SEED tasks; skipped is only what is below a
score that ten documents have, so the result is exact.

A query set is looked up in blocks of at most `block_chars` characters, each against all segments.

Edge cases: null texts and texts without a term are in no list and never found; items without a term, or whose terms no
document holds, have no rows; equal rows of items are ranked each by itself; documents with equal scores are ranked by
doc_id, a null one last; documents that repeat a doc_id are ranked each by itself; empty tables give no rows; other
columns are ignored. Long texts are cut into terms in slices of a megabyte.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm.common import id_text, small_batches, table, with_long, written

BLOCK = 64
SEGMENT = 2_000_000  # terms, with repeats
SLICE = 1 << 20
SEED = 8
TOP = 10
BLOCK_CHARS = 2_000_000
#: The bytes of terms as they are, A-Z lower-cased, and a space for any other byte.
_TERM = [48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)]
FOLD = bytes((i + 32 if 65 <= i <= 90 else i) if t else 32 for i, t in enumerate(_TERM))
IS_TERM = np.array(_TERM)
INDEX = "task int, number int, docs array<long>, norms binary, terms binary, df binary, first binary, last binary, most binary, at binary, postings binary"
FOUND = "item int, doc_id long, score long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, slice by slice."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and _TERM[text[end]]:
            end += 1
        yield text[at:end].translate(FOLD).split()
        at = end


def raw_bytes(texts: pa.Array) -> Iterator[bytes]:
    """Texts in UTF-8; null ones are empty."""
    for t in texts.cast(pa.large_binary()):
        yield t.as_py() or b""


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats."""

    def count(batches):
        n = length = 0
        for b in batches:
            for text in raw_bytes(b.column(0)):
                own = 0
                for i in range(0, len(text), SLICE):
                    on = IS_TERM[np.frombuffer(text, np.uint8, min(SLICE, len(text) - i), i)]
                    own += int((on[1:] & ~on[:-1]).sum()) + int(on[0] and not (i and _TERM[text[i - 1]]))
                n, length = n + (own > 0), length + own
        yield pa.RecordBatch.from_pydict({"n": [n], "length": [length]})

    got = docs.select("text").mapInArrow(count, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return got[0] or 0, got[1] or 0


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of 7 bits, the last of each below 128; and where each begins, and the end."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << (7 * k)
    at = np.append(0, np.cumsum(size))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[at[own] + k] = (values[own] >> (7 * k)) & 127 | np.where(size[own] > k + 1, 128, 0)
    return out, at


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class Codes(dict):
    """Terms -> numbers by first appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Writer:
    """Gathers documents for a segment."""

    def __init__(self, n: int, length: int, task: int = 0) -> None:
        self.n, self.length, self.task, self.number = n, length, task, 0
        self.clear()

    def clear(self) -> None:
        self.codes, self.parts, self.ids, self.sizes, self.total = Codes(), [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        get, size = self.codes.__getitem__, 0
        for words in terms(text):
            self.parts.append(np.array(list(map(get, words)), np.int32))
            size += len(words)
        if size:
            self.ids.append(doc_id)
            self.sizes.append(size)
            self.total += size

    def segment(self) -> pa.RecordBatch:
        d = len(self.ids)
        key = np.concatenate(self.parts).astype(np.int64) * d + np.repeat(np.arange(d), self.sizes)
        self.parts = []
        key, tf = np.unique(key, return_counts=True)
        code, doc = key // d, key % d
        norms = np.array([10 + (90 * s * self.n) // self.length for s in self.sizes], np.int64)  # Python's numbers: no overflow
        df = np.bincount(code, minlength=len(self.codes))
        rank = np.arange(len(key)) - np.repeat(np.cumsum(df) - df, df)
        begin = np.flatnonzero(rank % BLOCK == 0)
        end = np.append(begin[1:], len(key)) - 1
        most = np.maximum.reduceat(impacts(tf, norms[doc]), begin)
        gap = np.diff(doc, prepend=0)
        gap[begin] = 0
        postings, at = packed(np.stack([gap, tf], 1).ravel())
        own = zstandard.compress(b" ".join(self.codes))
        small = [df, doc[begin], doc[end], most, np.append(at[2 * begin], at[-1])]
        row = [pa.array([self.task], pa.int32()), pa.array([self.number], pa.int32()), pa.array([self.ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in (norms.tobytes(), own, *[x.astype(np.int32).tobytes() for x in small], postings.tobytes())]]
        self.number += 1
        self.clear()
        return pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, int, int]:
    """docs (doc_id, text) -> the written segments, and the totals."""
    small_batches(docs.sparkSession)
    n, length = totals(docs)

    def build(batches):
        out = Writer(n, length, TaskContext.get().partitionId())
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), raw_bytes(b.column(1)), strict=True):
                out.add(doc_id, text)
                if out.total >= segment:
                    yield out.segment()
        if out.total:
            yield out.segment()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, INDEX), "segments"), n, length


class Segment:
    """A segment's lists of the wanted terms."""

    def __init__(self, row: dict, wanted: dict[bytes, int]) -> None:
        self.ids = row["docs"]
        self.norms = np.frombuffer(row["norms"], np.int64)
        self.first, self.last, self.most, self.at = (np.frombuffer(row[c], np.int32) for c in ("first", "last", "most", "at"))
        self.postings = np.frombuffer(row["postings"], np.uint8)
        df = np.frombuffer(row["df"], np.int32)
        ends = np.cumsum(-(-df.astype(np.int64) // BLOCK))
        self.lists = {}  # number of a wanted term -> its blocks
        for code, term in enumerate(zstandard.decompress(row["terms"]).split(b" ")):
            if term in wanted:
                self.lists[wanted[term]] = range(int(ends[code - 1]) if code else 0, int(ends[code]))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # decompressed blocks; no more than the segment has

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        got = self.open.get(b)
        if got is None:
            v = unpacked(self.postings[self.at[b] : self.at[b + 1]]).reshape(-1, 2)
            doc = self.first[b] + np.cumsum(v[:, 0])
            got = self.open[b] = doc, impacts(v[:, 1], self.norms[doc])
        return got

    def search(self, query: list[tuple[int, int]], threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score reaches the threshold, and the scores. query: (term, weight)."""
        n = len(self.ids)
        bound = np.zeros(n, np.int64)
        long = []
        change = np.zeros(n + 1, np.int64)
        for t, w in query:
            own = self.lists.get(t)
            if own is None:
                continue
            if len(own) == 1:
                doc, impact = self.block(own[0])
                bound[doc] += w * impact
            else:
                part = slice(own[0], own[-1] + 1)
                most = w * self.most[part].astype(np.int64)
                np.add.at(change, self.first[part], most)
                np.subtract.at(change, self.last[part] + 1, most)
                long.append((int(most.max()), w, own, most))
        bound += np.cumsum(change[:-1])
        pivots = np.flatnonzero(bound >= threshold)
        bound = bound[pivots]
        for _, w, own, most in sorted(long, key=lambda x: -x[0]):
            if not len(pivots):
                break
            at = np.searchsorted(self.last[own[0] : own[-1] + 1], pivots)  # a shallow move
            inside = at < len(own)
            inside[inside] = self.first[own[0] + at[inside]] <= pivots[inside]
            bound[inside] -= most[at[inside]]
            for b in np.unique(at[inside]):
                doc, impact = self.block(own[0] + int(b))
                low, high = np.searchsorted(pivots, (doc[0], doc[-1] + 1))
                k = np.minimum(np.searchsorted(doc, pivots[low:high]), len(doc) - 1)
                bound[low:high] += np.where(doc[k] == pivots[low:high], w * impact[k], 0)
            stays = bound >= threshold
            pivots, bound = pivots[stays], bound[stays]
        return pivots, bound


def best(found: list[tuple[int, int | None]], top: int) -> list[tuple[int, int | None]]:
    """The first of (score, doc_id)."""
    return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:top]


def lookup(segments: DataFrame, queries: list[list[tuple[int, int]]], wanted: dict[bytes, int], start: list[int], top: int) -> DataFrame:
    """FOUND: of each task, the highest-scoring documents of each query that reach its start threshold."""

    def search(batches):
        kept: list[list] = [[] for _ in queries]
        for b in batches:
            for k in range(b.num_rows):
                own = Segment({c: b.column(c)[k].as_py() for c in b.schema.names}, wanted)
                for i, query in enumerate(queries):
                    least = max(start[i], kept[i][-1][0] if len(kept[i]) == top else 1)
                    docs, scores = own.search(query, least)
                    if len(docs):
                        if len(docs) > top:  # more than top only with ties at the top-th score
                            docs, scores = (x[scores >= np.partition(scores, -top)[-top]] for x in (docs, scores))
                        kept[i] = best(kept[i] + [(int(s), own.ids[d]) for d, s in zip(docs, scores, strict=True)], top)
        rows = [(i, d, s) for i, own in enumerate(kept) for s, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return segments.mapInArrow(search, FOUND)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """FOUND -> the first of each item, with rank; in two steps, so that no task sorts what all tasks found for an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(32))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top).drop("part")


def frequencies(segments: DataFrame, wanted: dict[bytes, int]) -> dict[int, int]:
    """In how many documents each wanted term is."""

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for own, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df = np.frombuffer(df, np.int32)
                for code, term in enumerate(zstandard.decompress(own).split(b" ")):
                    if term in wanted:
                        total[wanted[term]] += int(df[code])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    return {r["term"]: r["df"] for r in segments.select("terms", "df").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS, segment: int = SEGMENT) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    segments, n, _ = index(docs, segment)
    items = items.filter("text is not null").select(id_text("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    done = []
    small_batches(spark, 1)  # a row is a segment
    for b in range(blocks):
        own = sorted(((r[0], r[1]) for r in items.filter(part == b).collect()), key=str)  # block_chars about
        words = [{w for part_ in terms(t.encode("utf-8", "surrogatepass")) for w in part_} for _, t in own]
        wanted = {w: k for k, w in enumerate(sorted(set().union(*words)))}
        df = frequencies(segments, wanted)
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
        queries = [sorted((wanted[w], weight[wanted[w]]) for w in ws if wanted[w] in df) for ws in words]
        start = [1] * len(own)
        for r in ranked(lookup(segments.filter((F.col("task") < SEED) & (F.col("number") == 0)), queries, wanted, start, top), top).filter(F.col("rank") == top).collect():
            start[r["item"]] = max(1, r["score"])
        found = written(lookup(segments, queries, wanted, start, top), "found")
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(own)], "item int, item_id string")
        done.append(ranked(found, top).join(F.broadcast(names), "item"))  # block_chars about
    small_batches(spark)
    return with_long(reduce(DataFrame.unionByName, done), "item_id").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_search": op11_search}
ORACLE = {
    "op11_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS t FROM benchmark),
c AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
u AS (SELECT r, unnest(ws) AS t FROM d),
p AS (SELECT r, t, count(*) AS tf FROM u WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * CAST(n AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, n),
m AS (SELECT r, doc_id, 10 + (90 * len(ws) * n) // l AS m FROM d, c WHERE len(ws) > 0),
s AS (SELECT q.i, q.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score FROM q JOIN p ON p.t = q.t JOIN w ON w.t = q.t JOIN m ON m.r = p.r GROUP BY q.i, q.item_id, m.r, m.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
""",
}
