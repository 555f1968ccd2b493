"""Language ID in two steps: linear SVMs (one against the rest) choose the language family, then one-versus-one linear
SVMs choose the language within it.

A text is its letters in lower case with one space between words; features are hashed counts of its 1- to 3-grams,
square-rooted and normalised. Only text and lang of rows whose crc32(doc_id as text) mod 4 is not 2 are learned from;
doc_id, lang and source are never inputs of a prediction.

Bound of the training sample: about `sample` rows in all, the same for each language (chosen by a hash of doc_id).
Prediction reads every whole text.

Edge cases: a null text, or one without letters, is `und` with score 0; rows with a null lang or doc_id aren't learned
from; a null doc_id is not held out; without any learned language every text is `und`; with one language each text with
letters gets it with score 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import small_batches, table

DIM = 4096
#: Families of languages by ISO 639-1 code; another code is a family by itself.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz tt ky",
    "indo-aryan": "hi mr ne bn pa gu ur",
    "semitic": "ar he mt am",
}
_LETTER = None


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


def letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def features(text: str | None) -> np.ndarray | None:
    """None without letters."""
    if not isinstance(text, str):
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, np.uint32(32))
    c = c[np.append(True, is_letter[1:] | is_letter[:-1])]  # one space for a run of other signs
    two = c[:-1] * np.uint32(2654435761) + c[1:]
    three = two[:-1] * np.uint32(2654435761) + c[2:]
    out = np.zeros(DIM)
    for h in (c, two, three):
        out += np.bincount((h * np.uint32(2246822519)) >> np.uint32(20), minlength=DIM)
    out = np.sqrt(out)
    return (out / np.sqrt((out * out).sum())).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of an L2-regularised hinge-loss SVM, by dual coordinate ascent; y is +1 or -1.
    Either sign weighs the same in all."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, norm = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), (x * x).sum(1)
    most = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            a = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / norm[i], 0), most[i])
            if a != alpha[i]:
                w += np.float32((a - alpha[i]) * y[i]) * x[i]
                alpha[i] = a
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """families: names; to_family: their weights; within: for each family its languages and the weights of each pair."""
    langs = np.array(langs, dtype=object)
    fam = np.array([family(g) for g in langs], dtype=object)
    names = sorted(set(fam))
    model = {"families": names, "to_family": np.stack([fit_svm(x, np.where(fam == f, 1, -1)) for f in names]) if len(names) > 1 else None, "within": {}}
    for f in names:
        own = sorted(set(langs[fam == f]))
        pairs = {}
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                pick = (langs == a) | (langs == b)
                pairs[a, b] = fit_svm(x[pick], np.where(langs[pick] == a, 1, -1))
        model["within"][f] = (own, pairs)
    return model


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores in 0..1: the logistic of twice the least margin that the decision hung on."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    margin = np.full(len(x), np.inf)
    which = np.zeros(len(x), int)
    if model["to_family"] is not None:
        s = x @ model["to_family"].T
        which = s.argmax(1)
        top = np.sort(s, axis=1)
        margin = (top[:, -1] - top[:, -2]) / 2
    lang = np.empty(len(x), object)
    for k, f in enumerate(model["families"]):
        at = np.flatnonzero(which == k)
        own, pairs = model["within"][f]
        if not len(at):
            continue
        votes, least = np.zeros((len(at), len(own))), np.full((len(at), len(own)), np.inf)
        for (a, b), w in pairs.items():
            s = x[at] @ w
            for name, sign in ((a, 1), (b, -1)):
                j = own.index(name)
                votes[:, j] += sign * s > 0
                least[:, j] = np.minimum(least[:, j], sign * s)
        best = (votes + np.tanh(np.clip(least, -20, 20)) * 0.25).argmax(1) if pairs else np.zeros(len(at), int)
        lang[at] = [own[j] for j in best]
        margin[at] = np.minimum(margin[at], least[np.arange(len(at)), best])
    return list(lang), 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = 2400) -> dict | None:
    """docs (doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != "und") & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # as many rows as languages
    if not counts:
        return None
    most = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, most / n))])
    picked = rows.filter((F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) / 1e6) < share[F.col("lang")])

    def feats(batches):
        for pdf in batches:
            got = [(i, g, f) for i, g, f in zip(pdf["doc_id"], pdf["lang"], map(features, pdf["text"]), strict=True) if f is not None]
            yield pd.DataFrame({"doc_id": [i for i, _, _ in got], "lang": [g for _, g, _ in got], "x": [f.astype(np.float16).tobytes() for _, _, f in got]}).astype({"doc_id": "int64"})

    # rows that repeat a doc_id and a language count once, so that the sample's size bounds what is collected
    got = picked.mapInPandas(feats, "doc_id long, lang string, x binary").groupBy("doc_id", "lang").agg(F.min("x").alias("x")).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["x"]))
    return fit(np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in got]).astype(np.float32), [r["lang"] for r in got])


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with text -> the same columns, then lang_pred and score. Python sees the texts alone."""
    small_batches(docs.sparkSession)

    def predicted(texts: pd.Series) -> pd.DataFrame:
        got = [features(t) for t in texts] if model else [None] * len(texts)
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        at = [i for i, f in enumerate(got) if f is not None]
        if at:
            lang[at], score[at] = predict(model, np.stack([got[i] for i in at]))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    udf = F.pandas_udf(predicted, "lang_pred string, score double").asNondeterministic()  # else a filter runs it twice
    docs = docs.drop("lang_pred", "score")
    rows = docs.select(F.struct("*").alias("doc"), udf(F.col("text").cast("string")).alias("found"))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], "found.lang_pred", "found.score")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    out = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op3_langid": op3_langid}
ORACLE: dict[str, str] = {}
