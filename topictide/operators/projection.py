"""Dimension reduction, map coordinates and centroid clusters of embeddings.

Principal components come from block Krylov iteration: a job multiplies the covariance with a
few columns, so neither the driver nor a task holds a square matrix of the dimensions."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kernels travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OVERSAMPLE = 8
TOLERANCE = 1e-9  # of the retained share, between two steps
MOST_STEPS = 30
SLICE = 256  # rows of a partial product to a row of the exchange


def _rows(batch: pa.RecordBatch, unit_length: bool) -> np.ndarray:
    x = np.array(batch.column("embedding").to_pylist(), float)
    if unit_length and len(x):
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = x / np.where(size > 0, size, 1.0)
    return x


@dataclass
class Reduction:
    """Mean and principal components; each component's largest loading is positive.
    ``variance`` has their shares of all variance, falling."""

    mean: np.ndarray
    components: np.ndarray
    variance: list[float]
    unit_length: bool = False

    @property
    def retained(self) -> float:
        return float(sum(self.variance))

    def transform(self, df: DataFrame, out: str = "reduced") -> DataFrame:
        mean, components, unit_length = self.mean, self.components, self.unit_length

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list((_rows(pa.RecordBatch.from_arrays([pa.array(x)], ["embedding"]), unit_length) - mean) @ components))

        return df.withColumn(out, project(F.col("embedding").cast("array<double>")))


def _summed(vectors: DataFrame, product, unit_length: bool) -> np.ndarray:
    """The sum over all tasks of ``product`` (a matrix) of their rows, exchanged in slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                x = _rows(whole.slice(at, 1_000), unit_length)
                total = product(x) if total is None else total + product(x)
        if total is not None:
            starts = range(0, len(total), SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array([total[i:i + SLICE].tobytes() for i in starts], pa.binary())], ["at", "part"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": part["at"].iloc[:1], "part": [sum(np.frombuffer(p, float) for p in part["part"]).tobytes()]})

    got = vectors.mapInArrow(run, "at long, part binary").groupBy("at").applyInPandas(add, "at long, part binary").collect()
    return np.concatenate([np.frombuffer(r.part, float) for r in sorted(got, key=lambda r: r["at"])])


def fit_reduction(df: DataFrame, n_components: int = 128, unit_length: bool = False, seed: int = 42) -> Reduction:
    """PCA on at most ``min(n_components, rows, dimensions)`` components. Steps go on until
    the retained share stands still or all dimensions are spanned, so it is that of the full
    decomposition."""
    vectors = df.select(F.col("embedding").cast("array<double>").alias("embedding"))
    rows, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    k = max(1, min(n_components, rows, dims))
    mean = _summed(vectors, lambda x: x.sum(axis=0)[:, None], unit_length) / rows
    width = min(dims, k + OVERSAMPLE)
    whole = float(_summed(vectors, lambda x: np.array([[((x - mean) ** 2).sum()]]), unit_length)[0]) / max(rows - 1, 1)
    step = lambda q: _summed(vectors, lambda x: (x - mean).T @ ((x - mean) @ q), unit_length).reshape(dims, -1) / max(rows - 1, 1)
    basis, image, last = np.zeros((dims, 0)), np.zeros((dims, 0)), -1.0
    fresh = np.random.default_rng(seed).normal(size=(dims, width))
    for _ in range(MOST_STEPS):
        for _ in range(2):  # once more, for what rounding leaves
            fresh = fresh - basis @ (basis.T @ fresh)
        q, r = np.linalg.qr(fresh)
        fresh = q[:, np.abs(np.diag(r)) > 1e-10 * max(np.abs(np.diag(r)).max(), 1e-300)][:, :dims - basis.shape[1]]
        if not fresh.shape[1]:
            break
        moved = step(fresh)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, moved])
        inner = basis.T @ image
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        kept = float(np.maximum(values[:k], 0).sum() / whole) if whole > 0 else 0.0
        if basis.shape[1] >= dims or kept - last < TOLERANCE and basis.shape[1] >= 2 * width:
            break
        last, fresh = kept, moved
    components = basis @ turns[:, :k]
    signs = np.where(np.take_along_axis(components, np.abs(components).argmax(axis=0)[None, :], 0)[0] >= 0, 1.0, -1.0)
    shares = np.maximum(values[:k], 0) / whole if whole > 0 else np.zeros(k)
    return Reduction(mean, components * signs, [float(v) for v in shares], unit_length)


def reduce_embeddings(df: DataFrame, n_components: int = 128) -> DataFrame:
    return fit_reduction(df, n_components).transform(df)


def map_coordinates(df: DataFrame) -> DataFrame:
    """2-D layout by direction: unit vectors, centred, first two components."""
    fitted = fit_reduction(df, 2, unit_length=True)
    xy = fitted.transform(df, "_xy2")
    return xy.withColumns({"proj_x": F.get("_xy2", F.lit(0)),
                           "proj_y": F.coalesce(F.get("_xy2", F.lit(1)), F.lit(0.0))}).drop("_xy2")


def centroid_clusters(df: DataFrame, k: int = 80, seed: int = 42, bisecting: bool = False) -> DataFrame:
    """Clusters by centroid when the number of topics is given."""
    vec = df.withColumn("_vec", array_to_vector(F.col("embedding").cast("array<double>")))
    algo = BisectingKMeans if bisecting else KMeans
    model = algo(k=k, seed=seed, featuresCol="_vec", predictionCol="cluster").fit(vec.select("_vec"))
    return model.transform(vec).drop("_vec")


def silhouette(clustered: DataFrame) -> float:
    """Mean silhouette of (embedding, cluster) rows by squared distance, -1 to 1."""
    vec = clustered.withColumn("_vec", array_to_vector(F.col("embedding").cast("array<double>")))
    return float(ClusteringEvaluator(featuresCol="_vec", predictionCol="cluster", distanceMeasure="squaredEuclidean").evaluate(vec))
