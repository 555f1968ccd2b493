"""Quality rules: base counts of a text, and a line labeller whose verdict decides retention.

A linear-chain conditional random field with two labels (content, boilerplate) is trained by gradient ascent on the
lines of a bounded sample of labelled documents. Lines get weak labels of their own, so that a sequence holds both: in a
good document all is content but lines that recur elsewhere between other lines, that the document repeats, or that look
like links, menus or junk; in a bad document all is boilerplate but plain prose. Viterbi decoding labels the lines of
every whole text; a document is kept if at least `share` of its words stand in content lines and the base rules did not
fail it.

Bound of the training sample: `per_class` documents of each quality (those with the smallest hash of doc_id), with all
their lines, in sequences of SEQUENCE lines. Decoding has no bounds.

Edge cases: a null or empty text has no words, so the base rules fail it; without both kinds of lines the model is
neutral and the base rules alone decide; rows with the same doc_id are separate rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import id_text, small_batches, table, with_long

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
N_FEATURES = 16
SEQUENCE = 64
COLUMNS = "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
_CLASS = None


def classes() -> np.ndarray:
    """Code point -> 0 other letter or sign, 1 lower case, 2 upper case, 3 digit, 4 symbol, 5 punctuation, 6 white space of SPACES."""
    global _CLASS
    if _CLASS is None:
        _CLASS = np.zeros(0x110000, np.uint8)
        for c in range(0x3000):
            x = chr(c)
            _CLASS[c] = 6 if x in SPACES else 4 if x in SYMBOLS else 3 if x.isdigit() else 1 if x.islower() else 2 if x.isupper() else 5 if c < 0x80 else 0
    return _CLASS


def repeated(codes: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that are found twice or more."""
    n = len(codes)
    if n < 4:
        return 0
    c = codes.astype(np.int64)
    if distinct < 2_000_000:
        key = (c[:-2] * distinct + c[1:-1]) * distinct + c[2:]
    else:
        pair = np.unique(c[:-1] * distinct + c[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * distinct + c[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    mark = np.zeros(n, bool)
    mark[:-2] |= twice
    mark[1:-1] |= twice
    mark[2:] |= twice
    return int(mark.sum())


def describe(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray, np.ndarray]:
    """The base counts; for each line with a word, its words, its features and its number among the text's different lines."""
    text = text or ""
    kind = classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lines = text.split("\n")
    ids: dict[bytes, int] = {}
    codes: list[int] = []
    seen: dict[str, int] = {}
    rows, size, uniq, dups, which, at = [], [], [], [], [], 0
    order: dict[str, int] = {}
    starts = []
    for line in lines:
        words = line.encode("utf-8", "surrogatepass").split()
        if words:
            own = [ids.setdefault(w, len(ids)) for w in words]
            codes += own
            k = seen.get(line, 0)
            seen[line] = k + 1
            starts.append(at)
            rows.append(at + len(line))
            size.append(len(words))
            uniq.append(len(set(own)))
            dups.append(k)
            which.append(order.setdefault(line, len(order)))
        at += len(line) + 1
    n = len(codes)
    base = (n, len(kind) - int((kind == 6).sum()), int((kind == 4).sum()), sum(k > 0 for k in dups), repeated(np.array(codes), max(1, len(ids))))
    if not n:
        return base, np.zeros(0), np.zeros((0, N_FEATURES)), np.zeros(0, np.int64)
    size = np.array(size, float)
    cuts = np.array([x for p in zip(starts, rows, strict=True) for x in p])
    pad = np.append(kind, 0)
    count = np.stack([np.add.reduceat(pad == c, cuts, dtype=np.int64)[::2] for c in (1, 2, 3, 4, 5)], 1).astype(float)
    chars = np.array(rows) - np.array(starts)
    share = count / np.maximum(chars, 1)[:, None]
    uniq = np.array(uniq) / size
    which = np.array(which)
    copies = np.bincount(which)[which] - 1
    end = np.arange(len(size))
    last = kind[np.array(rows) - 1]
    feats = np.stack([np.ones(len(size)), share[:, 0], 2 * share[:, 1], 4 * share[:, 2], 10 * share[:, 3], 4 * share[:, 4], np.minimum(count[:, 3] / size, 2), np.minimum(count[:, 4] / size, 3), (last == 5) * 1.0, uniq, (uniq < 0.4) * 1.0, np.minimum(copies, 3) / 3, np.minimum(size, 60) / 30, np.minimum(chars / size, 30) / 10, (end == 0) * 1.0, (end == len(size) - 1) * 1.0], 1)
    return base, size, feats, which


def weak_labels(docs: list[tuple[int, np.ndarray, list[int]]]) -> list[np.ndarray]:
    """docs: quality, features and keys (equal for equal lines) of the lines. 1 where a line counts as content."""
    around: dict[int, set] = {}
    for _, x, keys in docs:
        for i, k in enumerate(keys):
            around.setdefault(k, set()).add((keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None))
    # copies of a document have a line between the same others; boilerplate stands between different ones on both sides
    often = {k for k, pairs in around.items() if min(len({a for a, _ in pairs}), len({b for _, b in pairs})) >= 3}
    out = []
    for quality, x, keys in docs:
        words, signs = 30 * x[:, 12], x[:, 6]
        again = np.array([k in often for k in keys], bool) | (x[:, 11] > 0)
        junk = (signs > 0.2) | (x[:, 2] > 1.2) | (x[:, 9] < 0.4) | (words <= 4) & (x[:, 8] == 0)
        prose = (words >= 5) & (x[:, 8] == 1) & (signs < 0.05) & (x[:, 2] < 0.6) & (x[:, 9] >= 0.5)
        out.append(~again & (~junk if quality == 1 else prose))
    return out


def fit_crf(docs: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """docs: features of the lines, their labels (1 content). Returns emission weights (score of content) and
    transitions[from, to]."""
    w, t = np.zeros(N_FEATURES), np.zeros((2, 2))
    docs = [(x[i : i + SEQUENCE], y[i : i + SEQUENCE]) for x, y in docs for i in range(0, len(x), SEQUENCE)]
    if len({int(v) for _, y in docs for v in np.unique(y)}) < 2:
        return w, t
    n, longest = len(docs), max(len(x) for x, _ in docs)
    x, on, y = np.zeros((n, longest, N_FEATURES)), np.zeros((n, longest), bool), np.zeros((n, longest))
    for i, (f, label) in enumerate(docs):
        x[i, : len(f)], on[i, : len(f)], y[i, : len(f)] = f, True, label
    main = y.sum(1) * 2 >= on.sum(1)  # either kind of sequence counts as much
    heavy = np.where(main, 0.5 / max(1, main.sum()), 0.5 / max(1, (~main).sum())) / on.sum(1)
    vw, vt = np.zeros_like(w), np.zeros_like(t)
    for _ in range(steps):
        e = np.zeros((n, longest, 2))
        e[..., 1] = x @ w
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = e[:, 0]
        for k in range(1, longest):
            step = np.logaddexp(fwd[:, k - 1, :1] + t[0], fwd[:, k - 1, 1:] + t[1]) + e[:, k]
            fwd[:, k] = np.where(on[:, k, None], step, fwd[:, k - 1])
        for k in range(longest - 2, -1, -1):
            z = e[:, k + 1] + bwd[:, k + 1]
            step = np.stack([np.logaddexp(t[a, 0] + z[:, 0], t[a, 1] + z[:, 1]) for a in (0, 1)], 1)
            bwd[:, k] = np.where(on[:, k + 1, None], step, 0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - total[:, None, None])[..., 1] * on
        gw = np.einsum("n,nl,nlf->f", heavy, y - p, x) - ridge * w
        gt = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                q = np.exp(fwd[:, :-1, a] + t[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - total[:, None]) * on[:, 1:]
                gt[a, b] = (heavy[:, None] * ((y[:, :-1] == a) & (y[:, 1:] == b) & on[:, 1:])).sum() - (heavy[:, None] * q).sum()
        gt -= ridge * t
        vw, vt = 0.9 * vw + gw, 0.9 * vt + gt
        w, t = w + rate * vw, t + rate * vt
    return w, t


def viterbi(emission: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best labels for content scores of lines."""
    n = len(emission)
    back = np.zeros((n, 2), np.int8)
    t00, t01, t10, t11 = t.ravel().tolist()
    a, b = 0.0, 0.0
    steps = []
    for k, e in enumerate(emission.tolist()):
        if k == 0:
            a, b = 0.0, e
            continue
        s0, s1 = (a + t00, 0) if a + t00 >= b + t10 else (b + t10, 1)
        r0, r1 = (a + t01, 0) if a + t01 > b + t11 else (b + t11, 1)
        steps.append((s1, r1))
        a, b = s0, r0 + e
    if n > 1:
        back[1:] = steps
    out, now = np.zeros(n, np.int8), int(b >= a)
    for k in range(n - 1, -1, -1):
        out[k] = now
        now = int(back[k, now])
    return out


def train(documents: DataFrame, labels: DataFrame, per_class: int = 1200, most_lines: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The model learns from per_class documents of each label, of a document's lines from most_lines that follow one another
    from a place by the text's hash on; rows that repeat a doc_id and a label count once. So 2 * per_class * most_lines
    lines of N_FEATURES numbers are the most that is collected."""
    spark = documents.sparkSession
    small_batches(spark)
    labels = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").withColumn("h", F.xxhash64("doc_id"))
    chosen = [labels.filter(F.col("quality") == q).orderBy("h", "doc_id").limit(per_class) for q in (0, 1)]
    chosen = chosen[0].union(chosen[1]).drop("h")  # 2 * per_class rows at most

    def feats(batches):
        for pdf in batches:
            out = []
            for doc_id, quality, text in zip(pdf["doc_id"], pdf["quality"], pdf["text"], strict=True):
                text = text if isinstance(text, str) else ""
                _, _, x, which = describe(text)
                lines = list(dict.fromkeys(t for t in text.split("\n") if t.strip(SPACES)))
                keys = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in lines]
                begin = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % max(1, len(x) - most_lines + 1)
                part = slice(begin, begin + most_lines)
                out.append((doc_id, quality, x[part].astype(np.float32).tobytes(), [keys[i] for i in which[part]]))
            yield pd.DataFrame(out, columns=["doc_id", "quality", "x", "keys"])

    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(id_text("doc_id"), "quality", "text").mapInPandas(feats, "doc_id string, quality int, x binary, keys array<long>")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("x", "keys")).alias("least")).select("doc_id", "quality", "least.*").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    docs = [(int(r["quality"]), np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, N_FEATURES).astype(float), r["keys"]) for r in rows]
    return fit_crf([(x, y) for (_, x, _), y in zip(docs, weak_labels(docs), strict=True)])


def judge(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = 0.5) -> DataFrame:
    """documents (doc_id, text) -> COLUMNS."""
    small_batches(documents.sparkSession)
    w, t = model
    neutral = not w.any()

    def rules(batches):
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                base, size, x, _ = describe(text if isinstance(text, str) else None)
                n, *_, again = base
                failed = n < 50 or 100 * again > 50 * n
                content = float((size * viterbi(x @ w, t)).sum() / n) if n and not neutral else float(n > 0)
                out.append((doc_id, *base, failed, not failed and content >= share, content))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return with_long(documents.select(id_text("doc_id"), "text").mapInPandas(rules, COLUMNS), "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
