"""Usable vectors of the table of vectors, and exact cosines between blocks of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, dataset_info: DataFrame) -> DataFrame:
    """(dataset, part, vec_id, embedding) of the vectors that are not null, have the dimension of their dataset, only
    finite numbers and not all zero. Rows delivered again stay; who uses the rows groups them by what the embedding
    decides and takes each vec_id once there. Null datasets and vec_ids, and datasets without a dimension, have none; of several
    dimensions of a dataset the least counts."""
    e = F.col("embedding")
    dims = dataset_info.filter(F.col("dimension") > 0).groupBy("dataset").agg(F.min("dimension").alias("__d"))
    finite = F.forall(e, lambda x: x.isNotNull()) & (F.array_max(e) < float("inf")) & (F.array_min(e) > float("-inf"))
    some = (F.array_max(e) != 0) | (F.array_min(e) != 0)
    rows = vectors.select("dataset", "part", "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & (F.size(e) > 0) & finite & some)
    return rows.join(dims, "dataset").filter(F.size(e) == F.col("__d")).select("dataset", "part", "vec_id", F.col("embedding").cast("array<float>"))


def stack(rows) -> np.ndarray:
    """A matrix of a pandas column of arrays."""
    return np.stack(rows.to_numpy()) if len(rows) else np.empty((0, 0), np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double; a scale by the largest entry keeps tiny and huge vectors from under- or overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def pair_cosines(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, block: int = 65536) -> np.ndarray:
    """Cosines of rows a[i] and b[j] of unit matrices, in double, rounded to six decimals."""
    out = np.empty(len(i))
    for at in range(0, len(i), block):
        s = slice(at, at + block)
        out[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]])
    return np.round(out, 6)
