"""Two-dimensional projections: PCA of all points, t-SNE and neighbour embedding of landmarks beyond a bound."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.functions import vectors as V
from timbrel.operators import density

#: Points that exact t-SNE embeds, at most: it holds several N * N matrices.
TSNE_LIMIT = 5_000
REDUCERS = ("pca", "tsne", "umap")


def tsne(x: np.ndarray, perplexity: float = 30.0, steps: int = 500, seed: int = 7) -> np.ndarray:
    """Exact t-SNE: bisected perplexity, PCA start, early exaggeration, momentum."""
    n = len(x)
    if n < 3:
        return np.zeros((n, 2))
    perplexity = min(perplexity, (n - 1) / 3)
    square = (x * x).sum(axis=1)
    d = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    nearest = d.min(axis=1, keepdims=True)
    for _ in range(60):
        p = np.exp(-(d - nearest) * beta[:, None])
        total = p.sum(axis=1)
        with np.errstate(invalid="ignore"):
            entropy = np.log(total) + beta * np.where(p > 0, p * (d - nearest), 0).sum(axis=1) / total
        wide = entropy > np.log(max(perplexity, 1.01))
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p /= total[:, None]
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    centred = x - x.mean(axis=0)
    y = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    y = np.pad(y, ((0, 0), (0, 2 - y.shape[1])))
    y = 1e-4 * y / max(y[:, 0].std(), 1e-12)
    speed, gain = np.zeros_like(y), np.ones_like(y)
    rate = max(n / 48, 50.0)
    for step in range(steps):
        square = (y * y).sum(axis=1)
        q = 1 / (1 + np.maximum(square[:, None] + square[None, :] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        force = ((12.0 if step < 150 else 1.0) * p - q / q.sum()) * q
        slope = 4 * (force.sum(axis=1)[:, None] * y - force @ y)
        gain = np.maximum(np.where(np.sign(slope) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if step < 150 else 0.8) * speed - rate * gain * slope
        y = y + speed
    return y


def _pca(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    points = df.select(F.col(id_col).cast("long").alias("id"), array_to_vector(V.doubles(vector)).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(points)
    loadings = model.pc.toArray()
    sign = [float(np.sign(loadings[np.abs(loadings[:, i]).argmax(), i]) or 1.0) for i in range(2)]
    out = model.transform(points).select("id", vector_to_array("xy").alias("xy"))
    return out.select("id", (F.col("xy")[0] * sign[0]).alias("x"), (F.col("xy")[1] * sign[1]).alias("y"))


def project(df: DataFrame, reducer: str = "pca", id_col: str = "id", vector: str = "v", seed: int = 7, limit: int | None = None) -> DataFrame:
    """(id, x, y).  "pca" is distributed; "tsne" and "umap" embed at most ``limit`` points (TSNE_LIMIT, density.LIMIT) and place the others among them."""
    if reducer not in REDUCERS:
        raise ValueError(f"reducer must be one of {REDUCERS}")
    if reducer == "pca":
        return _pca(df, id_col, vector)

    def fit(x: np.ndarray) -> np.ndarray:
        y = tsne(x, seed=seed) if reducer == "tsne" else density.umap(x, 15, 2, 0.1, seed=seed)
        return np.pad(y, ((0, 0), (0, 2 - y.shape[1])))

    most = limit or (TSNE_LIMIT if reducer == "tsne" else density.LIMIT)
    return density.embedded(df, fit, id_col, vector, most).select("id", F.col("y")[0].alias("x"), F.col("y")[1].alias("y"))


def centers(assigned: DataFrame) -> DataFrame:
    """(clust, x, y): centre of each cluster's projected points."""
    return assigned.groupBy("clust").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def scatter_grid(assigned: DataFrame, width: int = 1200, height: int = 900) -> DataFrame:
    """(px, py, clust): the commonest cluster of each pixel that has points, the smaller label on ties; y grows upwards, pixels downwards.

    Points of any number become at most ``width * height`` rows by partial aggregation.
    """
    known = assigned.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    span = known.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    place = lambda c, size: F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}")) * (size - 1) + 0.5), F.lit(0)).cast("int")
    put = known.crossJoin(F.broadcast(span)).select(place("x", width).alias("px"), (F.lit(height - 1) - place("y", height)).alias("py"), "clust")  # one row is broadcast
    counts = put.groupBy("px", "py", "clust").agg(F.count("*").alias("n"))
    return counts.groupBy("px", "py").agg(F.min_by("clust", F.struct(-F.col("n"), "clust")).alias("clust"))
