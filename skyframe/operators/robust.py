"""Robust statistics for groups. Values are counted before any window, so that a group of very many rows is a window over
its distinct values only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.operators.scratch import stored


def _ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values with the ranks (lo, hi) that they take among n."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    up = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*by, "v", "k", F.sum("k").over(up).alias("hi"), F.sum("k").over(Window.partitionBy(*by)).alias("n")).withColumn("lo", F.col("hi") - F.col("k") + 1)


def _middle(ranked: DataFrame, by: list[str], first: Column, last: Column, name: str) -> DataFrame:
    """The mean of the values of ranks first .. last."""
    here = F.greatest(F.lit(0), F.least(F.col("hi"), last) - F.greatest(F.col("lo"), first) + 1)
    return ranked.withColumn("here", here).filter("here > 0").groupBy(*by).agg((F.sum(F.col("v") * F.col("here")) / F.sum("here").cast("double")).alias(name))


def smedian(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """The middle value; of an even number the mean of the middle two, of an odd number from 5 on that of the middle three."""
    n = F.col("n")
    half = F.floor(n / 2)
    first = F.when(n % 2 == 0, half).when(n >= 5, half).otherwise(half + 1)
    last = F.when(n % 2 == 0, half + 1).when(n >= 5, half + 2).otherwise(half + 1)
    return _middle(_ranked(df, by, value), by, first, last, name)


def upper_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """The value of rank n div 2 + 1."""
    at = F.floor(F.col("n") / 2) + 1
    return _ranked(df, by, value).filter((F.col("lo") <= at) & (at <= F.col("hi"))).select(*by, F.col("v").alias(name))


def _deviations(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values with their counts k, the group's size n, median and mad. Windows over the counts take the place of
    joins of the rows with their group's statistics."""
    group = Window.partitionBy(*by)
    n = F.col("n")
    half = F.floor(n / 2)
    first = F.when(n % 2 == 0, half).when(n >= 5, half).otherwise(half + 1)
    last = F.when(n % 2 == 0, half + 1).when(n >= 5, half + 2).otherwise(half + 1)
    here = F.greatest(F.lit(0), F.least(F.col("hi"), last) - F.greatest(F.col("lo"), first) + 1)

    def middle(ranked: DataFrame, v: str, name: str) -> DataFrame:
        return ranked.withColumn("here", here).withColumn(name, F.sum(F.col(v) * F.col("here")).over(group) / F.sum("here").over(group).cast("double"))

    own = middle(_ranked(df, by, value), "v", "median").withColumn("d", F.abs(F.col("v") - F.col("median")))
    up = Window.partitionBy(*by).orderBy("d", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("hi", F.sum("k").over(up)).withColumn("lo", F.col("hi") - F.col("k") + 1)
    return middle(own, "d", "mad").drop("here", "lo", "hi")


def mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """median, and mad: the robust median of the distances from it."""
    return _deviations(df, by, value).groupBy(*by).agg(F.first("median").alias("median"), F.first("mad").alias("mad"))


def best_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, sem and used: values within 1.5 * 1.4826 * mad of the median (less than; so if mad is 0 none is used, and
    the mean is null); of one or two values all."""
    sigma = F.col("mad") * 1.4826
    kept = (F.col("n") <= 2) | (F.col("d") < 1.5 * sigma)
    out = _deviations(df, by, value).groupBy(*by).agg(F.first("n").alias("n"), F.first("mad").alias("mad"), F.sum(F.when(kept, F.col("k"))).alias("used"), F.sum(F.when(kept, F.col("v") * F.col("k"))).alias("total"))
    sem = F.when(F.col("n") <= 2, 0.0).when(F.col("used") > 0, sigma / F.sqrt(F.col("used").cast("double")))
    return out.select(*by, (F.col("total") / F.col("used")).alias("mean"), sem.alias("sem"), F.coalesce("used", F.lit(0)).cast("long").alias("used"))


BINS, FEW = 1024, 10_000
OCTAVE, COARSE = 65536, 4096  # first bins for a doubling of the value; first bins that are summed up for the driver


def _bin_of(counts: DataFrame, rank: int) -> tuple[int, int, int]:
    """counts (bin, k), some thousands at most: the bin with the value of that rank, the rank within it, and its count."""
    for bin_, k in sorted(tuple(r) for r in counts.collect()):
        if rank <= k:
            return bin_, rank, k
        rank -= k
    raise AssertionError("ranks and counts disagree")


def overall_upper_median(df: DataFrame, value: str) -> float | None:
    """The value of rank n div 2 + 1 of all rows (None without any), by histograms that close in on it: no task sees more
    than FEW values at the end, however many rows there are. df is worked out twice and never written, so it may be a join with
    very many rows: first for counts in bins of the logarithm, then for the values of the one bin that has the rank."""
    v = F.col(value).cast("double")
    size = F.coalesce(F.floor(F.log2(F.abs("v")) * OCTAVE), F.lit(0)) + 1100 * OCTAVE  # over 0 for every double
    rows = df.filter(F.col(value).isNotNull()).select(v.alias("v")).withColumn("first", (F.signum("v") * size).cast("long"))
    counts = stored(rows.groupBy("first").agg(F.count("*").alias("k")), "bins")
    n = counts.agg(F.sum("k")).first()[0]
    if not n:
        return None
    rank = n // 2 + 1  # counted within what is left
    coarse = F.floor(F.col("first") / COARSE)
    at, rank, _ = _bin_of(counts.groupBy(coarse.alias("bin")).agg(F.sum("k").alias("k")), rank)
    at, rank, inside = _bin_of(counts.filter(coarse == at).select(F.col("first").alias("bin"), "k"), rank)
    rows = stored(rows.filter(F.col("first") == at).select("v"), "values")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    while inside > FEW and low < high:
        width = (high - low) / BINS
        bins = rows.filter(F.col("v").between(low, high)).groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
        for b in sorted(bins.collect()):  # BINS at most
            if rank <= b["k"]:
                break
            rank -= b["k"]
        if (b["low"], b["high"]) == (low, high):  # the bins are no finer than the values
            break
        low, high, inside = b["low"], b["high"], b["k"]
    counts = rows.filter(F.col("v").between(low, high)).groupBy("v").count().orderBy("v").collect()
    for r in counts:
        if rank <= r["count"]:
            return r["v"]
        rank -= r["count"]
    raise AssertionError("ranks and counts disagree")
