"""PCA whitening of embeddings by matrix-free block subspace iteration.

The covariance V of the vectors is never formed. Each Spark pass multiplies it by a block of columns: a task adds up
X'(XQ) of its centred rows, Spark adds the tasks' blocks, and one block of `d` rows reaches the driver (its size depends
on the dimension and the block alone). There, the block is made orthonormal (QR) against the directions at hand, the
Rayleigh-Ritz step gives the components within them, and the residuals |V v - e v| say which are certified. Directions
of the residuals of those that are not make the next block. Earlier directions are kept, as plain iteration would need
hundreds of passes where eigenvalues lie close together; with more than `most` of them, the iteration restarts from the
leading ones. It ends when all components have residuals of at most TOLERANCE times the largest eigenvalue; it raises an
error if that takes more than `passes`.

Entries are whole numbers x = floor(64 c) + 1000000, so counts, sums and n * x - S are exact; rows are centred before
anything is multiplied.

Edge cases: rows whose vector is null, is empty or holds a null or non-finite entry are dropped; of vectors of several
lengths those of the most frequent length stay (the smaller of equally frequent ones); repeated rows and null ids are
rows like others; components without variance (fewer rows or distinct vectors than dimensions) aren't returned, so
equal vectors and an empty table give no rows; a deviation beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import table, written

SCALE, SHIFT = 64, 1_000_000
TOLERANCE = 1e-12
BATCH = 4096
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The batch's row numbers that hold vectors of finite entries alone, by length: [(rows, x)], x as whole numbers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(size.sum()) if len(size) else 0)
    at = np.cumsum(size) - size
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    good = np.asarray(vectors.is_valid()) & (size > 0)
    bad = np.add.accumulate(np.append(0, ~np.isfinite(c)))
    good &= bad[at + size] == bad[at]
    out = []
    for length in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == length))
        out.append((rows, entries(c[at[rows][:, None] + np.arange(length)])))
    return good, out


def entries(c: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000; as Python's numbers where 64 bits wouldn't do."""
    x = np.floor(SCALE * c)
    if not x.size or np.abs(x).max() < 2**52:
        return x.astype(np.int64) + SHIFT
    return np.array([int(v) + SHIFT for v in x.ravel()], object).reshape(x.shape)


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - s, exactly; s holds Python's numbers."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, s)) if x.size else 0
    if most < 2**62 and x.dtype != object:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Sum of the squares of each row; None beyond 64 bits."""
    if y.dtype != object and y.size and int(np.abs(y).max()) ** 2 * y.shape[1] < 2**62:
        return (y * y).sum(1).tolist()
    found = (y.astype(object) ** 2).sum(1).tolist()
    return [int(v) if v < 2**63 else None for v in found]


def sums(rows: DataFrame, vector: str) -> tuple[int, list[int]]:
    """n and the sum of each dimension, of the most frequent length."""

    def partial(batches):
        found: dict[int, list] = {}
        for b in batches:
            for own, x in whole(b.column(0))[1]:
                n, s = found.get(x.shape[1], (0, 0))
                found[x.shape[1]] = [n + len(own), s + x.sum(0).astype(object)]
        out = [(length, i, n, decimal.Decimal(int(v))) for length, (n, s) in found.items() for i, v in enumerate(s)]
        kinds = [("length", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds))

    each = written(rows.select(vector).mapInArrow(partial, "length int, i int, n long, s decimal(38,0)").groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "sums")
    top = each.filter("i = 0").orderBy(F.desc("n"), "length").first()
    if top is None:
        return 0, []
    return top["n"], [int(r["s"]) for r in each.filter(F.col("length") == top["length"]).orderBy("i").collect()]


def product(rows: DataFrame, vector: str, n: int, s: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q and the trace of V, in one pass. A task gives one row for each dimension; Spark adds them up."""
    d, p = q.shape

    def partial(batches):
        total, trace = np.zeros((d, p)), 0.0
        for b in batches:
            for _, x in whole(b.column(0))[1]:
                if x.shape[1] == d:
                    y = centred(x, n, s).astype(float) / n
                    total += y.T @ (y @ q)
                    trace += float((y * y).sum())
        block = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), p).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), block, pa.array([trace] * d)], names=["i", "v", "trace"])

    parts = rows.select(vector).mapInArrow(partial, "i int, v array<double>, trace double")
    got = parts.groupBy("i").agg(F.max("i").alias("at"), F.sum("trace").alias("trace"), *[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(p)]).orderBy("i").collect()
    if not got:
        return np.zeros((d, p)), 0.0
    return np.array([r[3:] for r in got]) / n, got[0]["trace"] / n


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block has beside the columns of against."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):  # the second time takes out what rounding left
        block = block - against @ (against.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block


def components(rows: DataFrame, vector: str, n: int, s: list[int], k: int, spare: int = 8, most: int = 256, passes: int = 300, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), eigenvectors as columns, residuals and the trace, of at most k components."""
    d = len(s)
    k = min(k, d)
    rng = np.random.default_rng(seed)
    q, vq, trace = np.zeros((d, 0)), np.zeros((d, 0)), 0.0
    new = orthonormal(rng.normal(size=(d, min(d, k + spare))), q)
    for _ in range(passes):
        v_new, trace = product(rows, vector, n, s, new)
        q, vq = np.hstack([q, new]), np.hstack([vq, v_new])
        h = q.T @ vq
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        x, vx = q @ u, vq @ u
        left = vx[:, : k + spare] - x[:, : k + spare] * e[: k + spare]
        residual = np.linalg.norm(left, axis=0)[:k]
        open_ = residual > TOLERANCE * max(e[0], np.finfo(float).tiny)
        if not open_.any() or q.shape[1] == d:
            some = e[:k] > 64 * d * np.finfo(float).eps * max(e[0], 0)
            return e[:k][some], x[:, :k][:, some], residual[some], trace
        if q.shape[1] + k + spare > most:
            q, vq = x[:, : 2 * k], vx[:, : 2 * k]
        new = orthonormal(left[:, np.append(open_, np.ones(left.shape[1] - k, bool))], q)
        if not new.shape[1]:
            new = orthonormal(rng.normal(size=(d, min(k + spare, d - q.shape[1]))), q)
    raise RuntimeError(f"{int(open_.sum())} of {k} components are not certified after {passes} passes")


def whiten(rows: DataFrame, k: int = 32, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """rows (key, vector) -> OUT, a row for each vector and component."""
    spark = rows.sparkSession
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    n, s = sums(rows, "v")
    if not n:
        return spark.createDataFrame([], OUT)
    e, x, _, trace = components(rows, "v", n, s, k)
    if not len(e):
        return spark.createDataFrame([], OUT)
    d, scaled = len(s), x / np.sqrt(e)

    def project(batches):
        for b in batches:
            for own, x_ in whole(b.column(1))[1]:
                if x_.shape[1] != d:
                    continue
                for at in range(0, len(own), BATCH):
                    y = centred(x_[at : at + BATCH], n, s)
                    z = (y.astype(float) / n) @ scaled
                    block = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own[at : at + BATCH])), pa.array(deviations(y), pa.int64()), block], names=["vec_id", "deviation", "z"])

    z = rows.mapInArrow(project, "vec_id long, deviation long, z array<double>")
    error = identity_error(z, len(e))
    share = F.array(*[F.lit(float(v / trace)) for v in e])
    out = z.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(z: DataFrame, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""

    def partial(batches):
        n, one, two = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            part = np.asarray(b.column(0).flatten()).reshape(-1, k)
            n, one, two = n + len(part), one + part.sum(0), two + part.T @ part
        block = pa.FixedSizeListArray.from_arrays(pa.array(np.hstack([two, one[:, None]]).ravel()), k + 1).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array([n] * k, pa.int64()), block], names=["i", "n", "v"])

    parts = z.select("z").mapInArrow(partial, "i int, n long, v array<double>")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(k + 1)]).orderBy("i").collect()
    v = np.array([r[2:] for r in got]) / got[0]["n"]
    mean = v[:, k]
    return float(np.abs(v[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
