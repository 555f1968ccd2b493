"""Best-fit packing of documents into sequences of at most `cap` tokens.

Texts are tokenised once, into a table of pieces (their lengths and checksums; no ids). What is packed is the histogram
of lengths, at most `cap` rows at any size of the input. For each length, longest first, hash indexes of the single, pair
and triple sums of the lengths that are left give combinations that fill the gap exactly; each is consumed as often as
the counts allow, so every step uses up a length. What can't be completed goes by best fit, decreasing. If that leaves
more sequences than the tokens need, the last exact combinations are opened again, 1, 2, 4 ... of them, and go by best
fit with the rest, until nothing is to be gained. The outcome is a short list of patterns (lengths and how many
sequences have them). Pieces get a rank within their length, in salted groups whose number grows with the length's
count, so that a length of very many documents is no single task; the rank gives the sequence and the place in it.

Edge cases: a null or empty text has the closing id alone; texts that repeat are packed each by itself; a special
token's string in a text is that token, as the tokeniser has it; an empty table gives no rows; other columns are ignored.
A document longer than cap is cut so that its first piece takes the remainder.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm.common import id_text, small_batches, table, with_long, written

CAP, END = 2048, 0
GROUP_ROWS, GROUPS = 20_000, 100_000  # rows of a salted group, and about how many groups there are at most
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, object] = {}


def encoder(path: str | None = None):
    """Text -> ids (uint32), those of the JSON file's tokeniser. Texts without a special token's string take the rank file
    of the same vocabulary, whose ids are the same in a fifth of the time."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(path)
        special = [t.content for t in exact.get_added_tokens_decoder().values()]

        def encode(text: str) -> np.ndarray:
            if not any(x in text for x in special):
                try:
                    return np.array(fast.encode_ordinary(text), np.uint32)
                except (ValueError, RuntimeError):  # its pattern gives up on some very long runs
                    pass
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def cut(n: int, cap: int = CAP) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens."""
    first = n if n <= cap else n % cap or cap
    return [(0, first), *((s, cap) for s in range(first, n, cap))]


def pieces(docs: DataFrame, cap: int = CAP, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> PIECES."""
    small_batches(docs.sparkSession)

    def tokens(batches):
        encode = encoder(path)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(encode(text) if isinstance(text, str) else np.zeros(0, np.uint32), np.uint32(END)).astype("<u4")
                out += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), cap))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return with_long(docs.select(id_text("doc_id"), "text").mapInPandas(tokens, PIECES), "doc_id")


class Complements:
    """Indexes of the sums of one, two and three lengths that are left. An entry is the combination of its sum whose
    shortest part is longest (short pieces are kept, as they fill any gap); as counts only fall, an entry that is used up
    moves on and never returns."""

    def __init__(self, left: list[int]):
        self.left, self.pairs, self.triples = left, {}, {}

    def _has(self, *combo: int) -> bool:
        return all(self.left[x] >= combo.count(x) for x in combo)

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if total > 0 and self.left[total] else None

    def pair(self, total: int) -> tuple[int, ...] | None:
        a = self.pairs.get(total, total // 2)
        while a > 0 and not self._has(a, total - a):
            a -= 1
        self.pairs[total] = a
        return (total - a, a) if a > 0 else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        a, found = self.triples.get(total, total // 3), None
        while a > 0:
            found = self.pair(total - a) if self.left[a] else None
            if found and found[1] >= a and self._has(a, *found):
                break
            a -= 1
        self.triples[total] = a
        return (*found, a) if a > 0 else None


def exact(counts: dict[int, int], cap: int = CAP) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """counts: pieces of each length. Combinations of up to four lengths that fill a sequence exactly, with how many
    sequences have each, in the order in which they were found; and the counts of what has no complement."""
    left = [0] * (cap + 1)
    for n, k in counts.items():
        left[n] = int(k)
    index, out, rest = Complements(left), [], {}
    for longest in range(cap, 0, -1):
        while left[longest]:
            gap = cap - longest
            if gap == 0:
                combo = (longest,)
            else:
                left[longest] -= 1  # the others are looked for beside it
                more = index.single(gap) or index.pair(gap) or index.triple(gap)
                left[longest] += 1
                if not more:
                    rest[longest], left[longest] = left[longest], 0
                    break
                combo = (longest, *more)
            k = min(left[x] // combo.count(x) for x in combo)
            for x in combo:
                left[x] -= k
            out.append((combo, k))
    return out, rest


def plan(counts: dict[int, int], cap: int = CAP) -> list[tuple[tuple[int, ...], int]]:
    """counts: pieces of each length. Patterns: lengths of a sequence, and how many sequences have them."""
    filled, rest = exact(counts, cap)
    total = sum(k for _, k in filled)
    least = -(-sum(n * k for n, k in counts.items()) // cap)  # no packing has fewer
    best, opened = None, 0
    while best is None or sum(k for _, k in best) > least and opened < total:
        if best is not None:
            opened = min(total, max(1, opened * 2))
        kept, loose, more = [], dict(rest), opened
        for combo, k in reversed(filled):
            use = min(k, more)
            more -= use
            for x in combo if use else ():
                loose[x] = loose.get(x, 0) + use
            if k > use:
                kept.append((combo, k - use))
        now = kept + best_fit(loose, cap)
        if best is None or sum(k for _, k in now) < sum(k for _, k in best):
            best = now
    return best


def best_fit(counts: dict[int, int], cap: int = CAP) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing: groups of equal sequences by their gap."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in sorted(counts, reverse=True):
        k = counts[n]
        while k:
            fit = min((g for g, groups in open_.items() if g >= n and groups), default=None)
            if fit is None:
                each = cap // n
                for m, times in ((each, k // each), (k % each, 1)):
                    if m and times:
                        open_.setdefault(cap - m * n, []).append(((n,) * m, times))
                break
            combo, times = open_[fit].pop()
            each = min(fit // n, max(1, k // times)) if k >= times else 1
            used = min(times, k // each)
            if used < times:
                open_[fit].append((combo, times - used))
            open_.setdefault(fit - each * n, []).append((combo + (n,) * each, used))
            k -= used * each
    return [g for groups in open_.values() for g in groups]


def slots(patterns: list[tuple[tuple[int, ...], int]], cap: int = CAP) -> dict[str, np.ndarray]:
    """For each length (first[n] .. first[n + 1]): the rank at which a slot begins, its first sequence and its offset."""
    rows, base = [], 0
    for combo, k in patterns:
        at = 0
        for n in combo:
            rows.append((n, k, base, at))
            at += n
        base += k
    rows.sort(key=lambda r: (r[0], r[2], r[3]))
    a = np.array(rows, np.int64).reshape(-1, 4)
    begin = np.cumsum(a[:, 1]) - a[:, 1]
    first = np.searchsorted(a[:, 0], np.arange(cap + 2))
    start = np.append(begin, 0)[first]  # the ranks of a length begin at 0
    return {"first": first, "begin": begin - start[a[:, 0]], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(docs: DataFrame, cap: int = CAP, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> the contract's columns."""
    rows = written(pieces(docs, cap, path), "pieces")
    counts = np.zeros(cap + 1, np.int64)  # at most so many rows, whatever the input
    for n, k in rows.groupBy("length").count().collect():
        counts[n] = k
    salts = 1 + counts // max(GROUP_ROWS, int(counts.sum()) // GROUPS)
    salted = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.lit(salts.tolist()), F.col("length").cast("int")))
    rows = rows.withColumn("salt", salted.cast("int"))
    # where the ranks of each group begin within its length: GROUPS groups at most, and one for each length
    start = np.cumsum(salts) - salts
    sizes = np.zeros(int(salts.sum()), np.int64)
    for n, salt, k in rows.groupBy("length", "salt").count().collect():
        sizes[start[n] + salt] = k
    before = np.cumsum(sizes) - sizes
    before -= np.repeat(before[start], salts)
    s = slots(plan({n: int(k) for n, k in enumerate(counts) if k}, cap), cap)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))

    def place(batches):
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy() - 1
            rank = rank + before[start[n] + pdf["salt"].to_numpy()]
            at = np.empty(len(n), np.int64)
            for x in np.unique(n):
                own, (a, b) = n == x, s["first"][x : x + 2]
                at[own] = a + np.searchsorted(s["begin"][a:b], rank[own], side="right") - 1
            yield pdf.drop(columns=["salt", "rank"]).assign(sequence_id=s["sequence"][at] + rank - s["begin"][at], offset=s["offset"][at])

    placed = ranked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, f"{PIECES}, sequence_id long, offset long")
    return with_long(placed, "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLE: dict[str, str] = {}
