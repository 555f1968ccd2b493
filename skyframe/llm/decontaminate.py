"""Benchmark decontamination by q-gram filtering.

Benchmark items, in lower case with single spaces, are cut into overlapping windows (a shorter item is one window). A
window of m characters that occurs with at most e edits shares at least m - q + 1 - q * e q-grams with the text, all
within e + 1 neighbouring diagonals. So the shared q-grams are counted in overlapping bands of diagonals, each at least
e + 1 wide twice over; bands that reach the bound are verified by a banded alignment, whose distance is reported.

Texts are scanned whole, in the partitions that they are read in; nothing is shuffled. Within a worker, places of a text
are looked up in slices, as many as have about HITS q-grams of windows, so that memory doesn't grow with a text's length
or repetitions. The windows of at most `block_chars` characters of the benchmark go to the executors at once; a larger
benchmark is taken in blocks, one after the other, one scan of the documents and one written result for each.

Edge cases: null and empty texts match nothing; an item without text is never found; items shorter than q characters
must occur exactly, between spaces or the text's ends; rows with the same doc_id are separate rows; equal items are
all reported; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import id_text, small_batches, table, with_long, written

Q, RATE, WINDOW, STRIDE = 8, 0.1, 160, 80
BLOCK_CHARS = 5_000_000
FOUND = "doc_id string, item_id string, distance int, begins long"
HITS, PLACES = 1_000_000, 1 << 18  # looked up at once: q-grams of windows, and places of a text
_TABLE_BITS = 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Hashes of the runs of 8."""
    h = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    h = h[:-2] * np.uint32(0xC2B2AE3D) + h[2:]
    h = h[:-4] * np.uint32(0x85EBCA6B) + h[4:]
    return h ^ (h >> np.uint32(15))


def align(pattern: np.ndarray, text: np.ndarray, width: int, margin: int) -> int:
    """The least edits between the pattern and a part of text, on the diagonals -margin .. width - 1: text[i + d] meets
    pattern[i] on diagonal d."""
    far = np.int32(1 << 20)
    n = len(pattern)
    width += margin
    padded = np.full(n + width, 0xFFFFFFFF, np.uint32)
    text = text[: n + width - margin]
    padded[margin : margin + len(text)] = text
    step = np.arange(width, dtype=np.int32)
    row = np.zeros(width, np.int32)
    for i in range(n):
        new = row + (padded[i : i + width] != pattern[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum(np.minimum.accumulate(new - step) + step, far)
    return int(row.min())


class Index:
    """The distinct windows of some items, and where each q-gram stands in them."""

    def __init__(self, items: list[tuple[str | None, str]], rate: float = RATE, window: int = WINDOW, stride: int = STRIDE):
        self.short, self.items, self.window, self.edits, self.needed = [], [], [], [], []
        known: dict[str, int] = {}
        for item, text in items:
            text = normal(text)
            if 0 < len(text) < Q:
                self.short.append((item, text))
            starts = [0] if len(text) <= window else [*range(0, len(text) - window, stride), len(text) - window]
            for s in starts if len(text) >= Q else []:
                at = known.setdefault(text[s : s + window], len(known))
                if at < len(self.items):
                    self.items[at].append(item)
                    continue
                w = codes(text[s : s + window])
                e = min(int(rate * len(w)), (len(w) - Q) // Q)
                self.items.append([item])
                self.window.append(w)
                self.edits.append(e)
                self.needed.append(len(w) - Q + 1 - Q * e)
        self.edits, self.needed = np.array(self.edits, np.int64), np.array(self.needed, np.int64)
        self.step = np.maximum(self.edits + 1, 16)
        self.longest = max(map(len, self.window), default=0)
        self.span = self.longest + 2 * int(self.step.max(initial=16))  # places that a band may reach over
        self.gap = self.span + Q
        h = np.concatenate([grams(w) for w in self.window]) if self.window else np.zeros(0, np.uint32)
        which = np.repeat(np.arange(len(self.window)), [len(w) - Q + 1 for w in self.window])
        at = np.concatenate([np.arange(len(w) - Q + 1) for w in self.window]) if self.window else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.which, self.at = which[order].astype(np.int32), at[order].astype(np.int32)
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hash >> np.uint32(32 - _TABLE_BITS)] = True

    def candidates(self, c: np.ndarray):
        """Windows and the first diagonals of bands that reach the bound, slice by slice. Slices overlap by a band's
        reach, so that each band lies within one."""
        begin, size = 0, PLACES
        while begin + Q <= len(c) and len(self.hash):
            h = grams(c[begin : begin + size + self.span + Q - 1])
            pos = np.flatnonzero(self.table[h >> np.uint32(32 - _TABLE_BITS)])
            k = np.minimum(np.searchsorted(self.hash, h[pos]), len(self.hash) - 1)
            ok = self.hash[k] == h[pos]
            pos, k = pos[ok], k[ok]
            if size > self.span and self.count[k].sum() > HITS:
                size //= 2
                continue
            yield from self._bands(pos + begin, k, len(c))
            begin += size
            size = min(PLACES, 2 * size)

    def _bands(self, pos: np.ndarray, k: np.ndarray, length: int) -> list[tuple[int, int]]:
        n = self.count[k]
        hit = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        w = self.which[hit].astype(np.int64)
        band = (np.repeat(pos, n) - self.at[hit] + self.longest) // self.step[w] + 1
        bands = length + self.longest + 4
        key = w * bands + band
        key = np.concatenate([key, key - 1])  # each diagonal is in two bands
        coarse = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
        many = np.flatnonzero(np.bincount(coarse, minlength=1 << 22)[coarse] >= self.needed[key // bands])
        # a window's q-gram counts once in a band, however often the text repeats it there
        pair = np.unique(key[many] * (self.longest + 1) + self.at[hit[many % len(hit)]]) if len(many) else many
        key, n = np.unique(pair // (self.longest + 1), return_counts=True)
        key = key[n >= self.needed[key // bands]]
        return [(int(x // bands), int((x % bands - 1) * self.step[x // bands] - self.longest)) for x in key]

    def scan(self, texts: list[str]) -> list[tuple[int, str | None, int, int]]:
        """Text, item, least distance and the place (in the text in lower case with single spaces) of each pair."""
        parts, starts, ends, at = [], [], [], 0
        for t in texts:
            c = codes(t)
            parts += [c, np.zeros(self.gap, np.uint32)]
            starts.append(at)
            ends.append(at + len(c))
            at += len(c) + self.gap
        all_ = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        best: dict[tuple[int, str | None], tuple[int, int]] = {}
        for w, diagonal in self.candidates(all_):
            e, pattern = int(self.edits[w]), self.window[w]
            a = diagonal - e
            t = int(np.searchsorted(starts, diagonal + 2 * int(self.step[w]) + len(pattern) - 1, side="right")) - 1
            for doc in {max(t - 1, 0), max(t, 0)}:  # the band may reach into the gap before a text
                low, high = max(a, starts[doc]), min(diagonal + 2 * int(self.step[w]) + len(pattern) + e, ends[doc])
                if high - low < len(pattern) - e:
                    continue
                if all(best.get((doc, i), (1, 0))[0] == 0 for i in self.items[w]):
                    continue
                d = align(pattern, all_[low:high], min(2 * int(self.step[w]) + 2 * e, high - low) + 1, e)
                if d <= e:
                    for key in ((doc, i) for i in self.items[w]):
                        best[key] = min(best.get(key, (d, low - starts[doc])), (d, low - starts[doc]))
        for doc, t in enumerate(texts):
            for item, s in self.short:
                if f" {s} " in f" {t} ":
                    best[doc, item] = (0, f" {t} ".index(f" {s} "))
        return [(*k, *v) for k, v in sorted(best.items(), key=str)]


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, window: int = WINDOW, stride: int = STRIDE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (doc_id, a number or a string, and text), benchmark (item_id, text) -> FOUND, a row for each document row and
    item in it."""
    small_batches(docs.sparkSession)
    bench = benchmark.filter("text is not null").select(id_text("item_id"), "text")
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    named = dict(docs.dtypes)["doc_id"] == "string"
    texts = docs.select(F.col("doc_id") if named else id_text("doc_id"), "text")

    def scanned(own: DataFrame) -> DataFrame:
        index = Index(sorted(((r[0], r[1]) for r in own.collect()), key=str), rate, window, stride)  # block_chars about

        def search(batches):
            for pdf in batches:
                ids, texts_, size, out = [], [], 0, []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    if isinstance(text, str) and text:
                        ids.append(doc_id)
                        texts_.append(normal(text))
                        size += len(texts_[-1])
                    if size > 1_000_000:
                        out += [(ids[d], *r) for d, *r in index.scan(texts_)]
                        ids, texts_, size = [], [], 0
                out += [(ids[d], *r) for d, *r in index.scan(texts_)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "begins"])

        return with_long(texts.mapInPandas(search, FOUND), "item_id", *(() if named else ("doc_id",)))

    if blocks == 1:
        return scanned(bench)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return reduce(DataFrame.union, [written(scanned(bench.filter(part == b)), "found") for b in range(blocks)])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance")


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE: dict[str, str] = {}
