"""Random projection, spherical k-means, principal axes and their validation."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.clusters import unit


def random_projection(vector: Column, inputs: int, outputs: int, seed: int = 7) -> Column:
    """Gaussian projection; the matrix depends on the seed only."""
    matrix = np.random.default_rng(seed).normal(size=(inputs, outputs)) / np.sqrt(outputs)

    def project(s: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(s.to_numpy()).astype(np.float64) @ matrix)) if len(s) else s

    return F.pandas_udf(project, "array<double>")(vector)


def spherical_kmeans(vectors: DataFrame, k: int, seed: int = 7, iterations: int = 20) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, cluster) by cosine distance, with ++ style seeding."""
    rows = vectors.select("vec_id", array_to_vector(unit(F.col("embedding"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(rows)
    return model.transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


def _products(basis: np.ndarray, mean: np.ndarray):
    """Vectors -> (at, x): one row a task of sums of (v - mean) (v - mean)' basis, flat."""

    def run(batches):
        total = np.zeros(basis.shape)
        for b in batches:
            v = np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, -1) - mean
            total += v.T @ (v @ basis)
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "x"])

    return run


def principal_axes(vectors: DataFrame, k: int, oversample: int = 8, passes: int = 6, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """vectors(vec_id, embedding) -> ((vec_id, axes), the k axes as columns): randomised principal components.

    A random basis of k + ``oversample`` columns is multiplied by the covariance in each pass over the vectors and made
    orthonormal again, so no task and not the driver holds more than dimensions x columns; the small problem in the last
    basis gives the axes.  Signs are such that the largest entry of an axis is positive.  Vectors aren't NULL and of one length.
    """
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    first = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    sums = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).toPandas()  # a row a dimension
    mean = np.zeros(first)
    mean[sums["at"].to_numpy(int)] = sums["x"].to_numpy(float)

    def multiplied(basis: np.ndarray) -> np.ndarray:
        got = rows.select("v").mapInArrow(_products(basis, mean), "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros(basis.size)
        out[got["at"].to_numpy(int)] = got["x"].to_numpy(float)
        return out.reshape(basis.shape)

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(first, min(first, k + oversample))))[0]
    for _ in range(passes):
        basis = np.linalg.qr(multiplied(basis))[0]
    values, small = np.linalg.eigh(basis.T @ multiplied(basis))
    axes = basis @ small[:, np.argsort(-values)[:k]]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    @F.arrow_udf("array<double>")
    def project(v: pa.Array) -> pa.Array:
        x = (np.asarray(v.flatten(), np.float64).reshape(len(v), -1) - mean) @ axes
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))

    return rows.select("vec_id", project("v").alias("axes")), axes


def projection_error(pairs: DataFrame, exact: str, projected: str) -> DataFrame:
    """Correlation and mean absolute error of projected similarities."""
    return pairs.agg(F.corr(exact, projected).alias("pearson"), F.avg(F.abs(F.col(exact) - F.col(projected))).alias("mae"))


def mock_vector(text: Column, dimension: int) -> Column:
    """A deterministic stand-in for a provider: floats in [-1, 1) from chained digests of the text."""

    def one(x: str | None) -> list[float]:
        seed, out, n = (x or "").encode(), [], 0
        while len(out) < dimension:
            digest = hashlib.sha256(seed + n.to_bytes(4, "big")).digest()
            out += [int.from_bytes(digest[i : i + 4], "big") / 2**31 - 1 for i in range(0, 32, 4)]
            n += 1
        return out[:dimension]

    return _series(one)(text)


def _series(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return F.pandas_udf(run, "array<double>")
