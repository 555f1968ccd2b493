"""A quality classifier by compression: one zstandard dictionary is built from good and one from bad labelled text; a
text that packs better with the good one is better.

A text is taken whole, in blocks of BLOCK characters; each is compressed with either dictionary, and the sizes are added
up over the text. Its measures are the normalised difference of the sizes, (bad - good) / (bad + good), and the logarithm
of the rate (bad + good) / (2 * bytes): a text that repeats itself packs well with any dictionary, so that its difference
says little, but its rate is low. A logistic curve over both, fitted on labelled texts that the dictionaries were not
built from, makes them a score; the curve's bias is that of the labels' shares, so the score is calibrated to them.
Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2; the input of a score is the text alone.

Bound of the training sample: `per_class` rows of either quality (those with the smallest hash of doc_id and text), and
of these at most PIECES blocks of a text, spread evenly over it. Scoring has no bounds.

Edge cases: a null or empty text has difference and rate 0; with one quality alone, or none, among the labels every score
is 1, 0, or 0.5; a doc_id with several labels is learned from under each; a null doc_id is not held out and not learned
from; rows with the same doc_id are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import id_text, small_batches, table, with_long

BLOCK, PIECES, LEVEL = 512, 16, 3
SMOOTH = 16  # bytes added to either size: a few bytes more or less of a very short text say little
DICTIONARY = 112_640  # bytes of a dictionary at most
PASSED = 0.7  # the score from which a text is predicted to be good


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def blocks(text: str) -> list[bytes]:
    return [text[i : i + BLOCK].encode("utf-8", "surrogatepass") for i in range(0, len(text), BLOCK)]


def build(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY bytes; of few samples, the samples themselves."""
    size = min(DICTIONARY, sum(map(len, samples)) // 4)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text for the builder
        return b"\n".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of texts with a good and a bad dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        dicts = [zstandard.ZstdCompressionDict(d) for d in (good, bad)]
        for d in dicts:
            d.precompute_compress(level=LEVEL)
        self.pack = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False) for d in dicts]

    def measures(self, text: str | None) -> tuple[float, float]:
        """The normalised difference, above 0 for texts nearer to the good ones, and the logarithm of the rate."""
        good = bad = whole = 0
        for b in blocks(text or ""):
            good += len(self.pack[0].compress(b))
            bad += len(self.pack[1].compress(b))
            whole += len(b)
        return (bad - good) / (bad + good + 2 * SMOOTH), float(np.log((bad + good + 2 * SMOOTH) / (2 * whole + 2 * SMOOTH)))


class Curve:
    """A logistic curve over measures, by Newton's method with a small ridge; `odds` is the logarithm of the odds of label 1
    in what it will be used on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, odds: float, ridge: float = 1e-3) -> None:
        self.middle, self.spread = x.mean(0), x.std(0) + 1e-9
        f, self.w, self.shift = self.design(x), np.zeros(x.shape[1] + 1), 0.0
        weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())  # either label weighs the same in all
        hold = ridge * np.append(np.ones(x.shape[1]), 1e-3)
        for _ in range(60):
            p = self.score(x)
            bend = (f * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ f + np.diag(hold)
            step = np.linalg.solve(bend, f.T @ (weight * (p - y)) + hold * self.w)
            self.w = self.w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-9:
                break
        self.shift = odds

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.middle) / self.spread, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.w + self.shift, -30, 30)))


def train(documents: DataFrame, labels: DataFrame, per_class: int = 1500) -> dict:
    """documents (doc_id, text), labels (doc_id, quality) -> the dictionaries and the curve's numbers."""
    small_batches(documents.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    able = documents.select("doc_id", "text").filter("text is not null and text <> ''").join(known, "doc_id")
    able = able.select("quality", "text", F.xxhash64("doc_id", "text").alias("h"))
    few = {r["quality"]: r["count"] for r in able.groupBy("quality").count().collect()}  # two rows
    if len(few) < 2:
        return {"constant": float(next(iter(few))) if few else 0.5}
    # of many rows only those with small hashes are sorted: a fifth more than are needed, and some for chance
    share = {q: min(1.0, (1.2 * per_class + 200) / c) for q, c in few.items()}
    rows = able.filter(F.col("h") / 2.0**64 + 0.5 <= F.when(F.col("quality") == 1, share[1]).otherwise(share[0]))
    n = F.ceil(F.length("text") / BLOCK).cast("int")
    taken = F.least(F.lit(PIECES), n)
    pieces = F.transform(F.sequence(F.lit(0), taken - 1), lambda i: F.substring("text", F.floor(i * n / taken).cast("int") * BLOCK + 1, F.lit(BLOCK)))
    rows = rows.select("quality", "h", pieces.alias("pieces"))
    got = [rows.filter(F.col("quality") == q).orderBy("h", "pieces").limit(per_class).collect() for q in (1, 0)]
    # two thirds build the dictionaries, a third fits the curve
    texts = [[[p.encode("utf-8", "surrogatepass") for p in r["pieces"]] for r in part] for part in got]
    good, bad = (build([p for k, t in enumerate(part) if k % 3 or len(part) < 3 for p in t]) for part in texts)
    sizes = Sizes(good, bad)
    fit = [("".join(r["pieces"]), q) for q, part in ((True, got[0]), (False, got[1])) for k, r in enumerate(part) if k % 3 == 0]
    curve = Curve(np.array([sizes.measures(t) for t, _ in fit]), np.array([q for _, q in fit]), float(np.log(few[1] / few[0])))
    return {"good": good, "bad": bad, "curve": curve}


def judge(documents: DataFrame, model: dict) -> DataFrame:
    """documents (doc_id, text) -> doc_id, held_out, score, predicted, difference, rate."""
    small_batches(documents.sparkSession)

    def scored(batches):
        sizes = Sizes(model["good"], model["bad"]) if "curve" in model else None
        for pdf in batches:
            x = np.array([sizes.measures(t if isinstance(t, str) else None) if sizes else (0.0, 0.0) for t in pdf["text"]], float).reshape(-1, 2)
            s = model["curve"].score(x) if sizes else np.full(len(x), model["constant"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "difference": x[:, 0], "rate": np.exp(x[:, 1])})

    out = with_long(documents.select(id_text("doc_id"), "text").mapInPandas(scored, "doc_id string, score double, difference double, rate double"), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PASSED).cast("int").alias("predicted"), "difference", "rate")


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op13_compression": op13_compression}
ORACLE: dict[str, str] = {}
