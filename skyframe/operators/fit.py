"""Least squares as sums, and the solutions from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trend(points: DataFrame, by: list[str]) -> DataFrame:
    """Slope and intercept of y over x."""
    return points.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def trend_clipped(points: DataFrame, by: list[str]) -> DataFrame:
    """Fitted again to the points nearer in y than 1.5 times the root mean square distance from the line."""
    line = trend(points, by)
    r = F.col("slope") * F.col("x") - F.col("y") + F.col("intercept")
    off = points.join(line, by)
    sd = off.groupBy(*by).agg(F.sqrt(F.avg(r * r / (F.col("slope") * F.col("slope") + 1.0))).alias("sd"))
    return trend(off.join(sd, by).filter(F.abs(r) < 1.5 * F.col("sd")).select(*by, "x", "y"), by)


def affine(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs (x, y, u, v): a, b, c of u = a x + b y + c and d, e, f of v, by Cramer's rule on the centred sums; null where
    the points lie on a line."""
    s = lambda p, q: F.covar_pop(p, q)
    m = pairs.groupBy(*by).agg(s("x", "x").alias("xx"), s("x", "y").alias("xy"), s("y", "y").alias("yy"), *[s(p, q).alias(p + q) for q in "uv" for p in "xy"], *[F.avg(c).alias(f"m{c}") for c in "xyuv"])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = F.when(F.abs(det) > 1e-30, det)
    out = {}
    for q, (a, b, c) in {"u": "abc", "v": "def"}.items():
        out[a] = (F.col(f"x{q}") * F.col("yy") - F.col(f"y{q}") * F.col("xy")) / ok
        out[b] = (F.col(f"y{q}") * F.col("xx") - F.col(f"x{q}") * F.col("xy")) / ok
        out[c] = F.col(f"m{q}") - out[a] * F.col("mx") - out[b] * F.col("my")
    return m.select(*by, *[v.alias(k) for k, v in out.items()])


POWERS = [(i, j) for n in range(4) for i in range(n, -1, -1) for j in [n - i]]


def cubic_sums(pairs: DataFrame) -> DataFrame:
    """One row: the sums of all monomials that the normal equations of a full cubic in x, y need."""
    aggs = [F.sum(F.pow("x", F.lit(i)) * F.pow("y", F.lit(j))).alias(f"s{i}{j}") for i in range(7) for j in range(7 - i)]
    aggs += [F.sum(F.pow("x", F.lit(i)) * F.pow("y", F.lit(j)) * F.col(q)).alias(f"{q}{i}{j}") for q in "uv" for i, j in POWERS]
    return pairs.agg(F.count("*").alias("n"), *aggs)


def cubic(pairs: DataFrame) -> dict[str, float] | None:
    """Coefficients u_ij and v_ij of x^i y^j; None with fewer than 10 points or a singular system."""
    import numpy as np

    r = cubic_sums(pairs).first()
    if r["n"] < 10:
        return None
    m = np.array([[r[f"s{i + k}{j + n}"] for k, n in POWERS] for i, j in POWERS])
    try:
        if np.linalg.matrix_rank(m) < 10:
            return None
        return {f"{q}_{i}{j}": float(x) for q in "uv" for (i, j), x in zip(POWERS, np.linalg.solve(m, np.array([r[f"{q}{i}{j}"] for i, j in POWERS])), strict=True)}
    except np.linalg.LinAlgError:
        return None


def hyperbola_error(points: DataFrame, by: list[str]) -> DataFrame:
    """points (hfd, model): the mean of their relative distance, over the lesser of both."""
    return points.groupBy(*by).agg(F.avg(F.when(F.col("model") > F.col("hfd"), F.col("model") / F.col("hfd") - 1).otherwise(F.col("hfd") / F.col("model") - 1)).alias("error"))
