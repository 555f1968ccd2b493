"""The corpus pipeline: documents -> language ID -> line dedup -> n-gram Jaccard join -> benchmark decontamination ->
best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Null texts are rejected by the first stage; an empty table
passes through all stages; columns besides doc_id, text, lang and n_chars are passed on unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import decontaminate, jaccard, langid, linededup, packing
from skyframe.llm.common import table, written

SMALL_ROWS = 500_000  # keys of some 50 bytes are broadcast up to this, else both sides are shuffled
SHINGLE, PERCENT = 5, 80


def _without(docs: DataFrame, key: list[F.Column], keys: DataFrame) -> DataFrame:
    """docs whose key columns are no row of keys (distinct)."""
    names = [f"__key{i}" for i in range(len(key))]
    keys = written(keys.toDF(*names), "keys")
    keys = F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys
    docs = docs.withColumns(dict(zip(names, key, strict=True)))
    same = [docs[n].eqNullSafe(keys[n]) for n in names]
    return docs.join(keys, same, "left_anti").drop(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: without text or letters."""
    found = langid.identify(docs, langid.train(docs))
    return found.filter(F.col("lang_pred") != "und").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines, however short; a document that held nothing else goes."""
    out = linededup.drop_lines(docs)
    out = out.filter((F.col("dedup.n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links (five words, similarity 0.8 or more) connect, the one with the smallest doc_id stays; of
    rows that repeat both doc_id and text, one. A row is known by its doc_id and the digest of its text, so no copy of
    the texts is made and no group meets in one task."""
    own = ["doc_id", "text_md5"]
    key = [F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))]
    found = jaccard.groups(docs.select("doc_id", "text"), SHINGLE, PERCENT)
    found = written(found.groupBy(*own, "component").agg(F.count("*").alias("rows")), "groups")
    of_several = found.filter("component is not null")
    stays = of_several.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), *own)).alias("stays")).select("stays.doc_id", "stays.text_md5")
    goes = of_several.alias("f").join(stays.alias("s"), F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("f.text_md5") == F.col("s.text_md5")), "left_anti")
    left = _without(docs, key, goes.select(*own).distinct())
    again = found.filter("rows > 1").select(*own).distinct()
    if again.isEmpty():
        return left
    again = written(again, "again")
    named = left.withColumns({"__id": key[0], "__md5": key[1]}).alias("d")
    once = named.join(again.alias("a"), F.col("d.__id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.__md5") == F.col("a.text_md5")), "left_semi").dropDuplicates(["__id", "__md5"])
    return _without(left, key, again).unionByName(once.select(*left.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; they are known by the digest of their text."""
    key = F.sha2("text", 256)
    found = decontaminate.find(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, [key], found.select("doc_id").distinct())


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # language ID, decontamination and packing are not SQL; tests/llm/test_pipeline.py has brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
