"""Statistics of vector sets: moments, covariance, Mahalanobis, PCA, and distances between distributions.

What is collected is of the size of the dimension (squared), never of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecquarry.operators.ordered import positions
from vecquarry.operators.sums import tree_sum


def moments(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(j, n, mean, variance) of each dimension; the variance is unbiased and not below 0, null for a single row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = _blocks(b, embedding)
                n, s, ss = n + len(x), s + x.sum(axis=0), ss + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([v], pa.list_(pa.float64())) for v in (s, ss)]], names=["n", "s", "ss"])

    # a row of each partition, of the dimension
    parts = df.select(embedding).filter(F.col(embedding).isNotNull()).mapInArrow(run, "n bigint, s array<double>, ss array<double>")
    at = parts.select("n", F.posexplode(F.arrays_zip("s", "ss")).alias("j", "x"))
    s = at.groupBy("j").agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    return s.select("j", "n", mean.alias("mean"), F.greatest(F.lit(0.0), (F.col("ss") - F.col("n") * mean * mean) / F.nullif(F.col("n") - 1, F.lit(0))).alias("variance"))


def _blocks(b: pa.RecordBatch, name: str = "embedding") -> np.ndarray:
    e = b.column(name)
    return np.asarray(e.flatten(), dtype=np.float64).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 0))


def covariance(df: DataFrame, ddof: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance): partial sums of x and x x' per partition, relative to one row, added up in a tree."""
    kept = df.select("embedding").filter("embedding IS NOT NULL")
    first = kept.first()
    if first is None:
        return 0, np.empty(0), np.empty((0, 0))
    origin = np.array(first["embedding"], float)

    d = len(origin)

    def sums(b: pa.RecordBatch) -> np.ndarray:
        x = _blocks(b) - origin
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    found = tree_sum(kept, 1 + d + d * d, sums)
    n, s, ss = int(found[0]), found[1 : 1 + d], found[1 + d :].reshape(d, d)
    mean = s / n
    return n, origin + mean, (ss - n * np.outer(mean, mean)) / max(n - ddof, 1)


def mahalanobis(df: DataFrame, mean: np.ndarray, cov: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(key, distance) from a mean and a covariance, through its pseudo-inverse. In one dimension without variance the
    distance is 0 at the mean and infinite elsewhere."""
    if mean.ndim != 1 or cov.shape != (len(mean),) * 2 or not np.isfinite(cov).all() or not np.isfinite(mean).all():
        raise ValueError("a finite mean and a square finite covariance of its size are needed")
    flat = len(mean) == 1 and abs(cov[0, 0]) < 1e-12
    inverse = np.linalg.pinv(cov, hermitian=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _blocks(b) - mean if b.num_rows else np.empty((0, len(mean)))
            d = np.where(np.abs(x[:, 0]) < 1e-12, 0.0, np.inf) if flat else np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, inverse, x), 0))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(d)], names=[key, "distance"])

    return df.select(key, "embedding").filter("embedding IS NOT NULL").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, distance double")


def mahalanobis_diagonal(df: DataFrame, of: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, distance) with the variances of each dimension alone; dimensions without variance count nothing."""
    m = F.sort_array(F.collect_list(F.struct("j", "mean", "variance")))
    per = moments(of).agg(m.alias("m"))
    term = lambda x, s: F.when(s["variance"] > 1e-12, (x - s["mean"]) * (x - s["mean"]) / s["variance"]).otherwise(0.0)
    joined = df.select(key, "embedding").join(F.broadcast(per))  # one row of the dimension
    return joined.select(key, F.sqrt(F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), "m", term), F.lit(0.0), lambda a, b: a + b)).alias("distance"))


def pca(df: DataFrame, of: DataFrame, k: int = 2, key: str = "vec_id") -> DataFrame:
    """(key, components): standardized vectors along the first k principal axes of `of`; of an axis the entry of the largest size is positive."""
    n, mean, cov = covariance(of)
    scale = np.sqrt(np.where(np.diag(cov) > 1e-18, np.diag(cov), 1.0))
    values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = ((_blocks(b) - mean) / scale) @ axes if b.num_rows else np.empty((0, k))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(list(p), pa.list_(pa.float64()))], names=[key, "components"])

    return df.select(key, "embedding").filter("embedding IS NOT NULL").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, components array<double>")


def _root(c: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def frechet(a: DataFrame, b: DataFrame) -> float:
    """Distance of the normal distributions with the moments of a and b (not squared)."""
    (_, m1, c1), (_, m2, c2) = covariance(a), covariance(b)
    if len(m1) != len(m2):
        raise ValueError("both sets need vectors of one dimension")
    r = _root(c1)
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(r @ c2 @ r), 0)).sum()
    return float(np.sqrt(((m1 - m2) ** 2).sum() + max(0.0, np.trace(c1) + np.trace(c2) - 2 * cross)))


def median_bandwidth(df: DataFrame, sample: int = 4096, seed: int = 1, key: str = "vec_id") -> float:
    """Median of the positive distances within a bounded sample drawn by a hash of the key."""
    rows = df.filter("embedding IS NOT NULL").orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select("embedding").collect()  # at most `sample` rows
    x = np.array([r["embedding"] for r in rows], float)
    i, j = np.triu_indices(len(x), 1)
    g = x @ x.T
    d = np.sqrt(np.maximum(np.diag(g)[i] + np.diag(g)[j] - 2 * g[i, j], 0))
    return float(np.median(d[d > 0])) if (d > 0).any() else 1.0


def mmd(a: DataFrame, b: DataFrame, bandwidth: float, scales: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0), features: int = 1024, seed: int = 1) -> float:
    """Squared maximum mean discrepancy, averaged over scales, by random Fourier features, less the bias of the sample
    (so that it may fall below 0). Each partition sends sums of its features, not rows."""
    dims = {len(r["embedding"]) for x in (a, b) if (r := x.filter("embedding IS NOT NULL").first())}
    if len(dims) != 1:
        raise ValueError("both sets need vectors of one dimension")
    d = dims.pop()
    rng = np.random.default_rng(seed)
    w = np.concatenate([rng.standard_normal((d, features)) / (bandwidth * s) for s in scales], axis=1)
    shift = rng.random(w.shape[1]) * 2 * np.pi

    size = w.shape[1]

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(1 + 2 * size)
        for at in range(0, batch.num_rows, 4096):
            z = np.sqrt(2 / features) * np.cos(_blocks(batch.slice(at, 4096)) @ w + shift)
            total += np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])
        return total

    def of(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = tree_sum(df.select("embedding").filter("embedding IS NOT NULL"), 1 + 2 * size, sums)
        n, mean = found[0], found[1 : 1 + size] / found[0]
        spread = (found[1 + size :] - n * mean**2) / max(n - 1, 1) / n
        return mean, spread

    (m1, v1), (m2, v2) = of(a), of(b)
    per = ((m1 - m2) ** 2 - v1 - v2).reshape(len(scales), features).sum(axis=1)
    return float(per.mean())


def sliced_wasserstein(a: DataFrame, b: DataFrame, directions: int = 128, quantiles: int = 1024, seed: int = 1) -> float:
    """Root of the mean squared difference of the sorted projections on random directions. The sets may differ in size:
    their quantile functions are compared at the middles of `quantiles` equal steps, exact where the sizes are equal to it."""
    first = a.filter("embedding IS NOT NULL").first()
    d = len(first["embedding"])
    u = np.random.default_rng(seed).standard_normal((d, directions))
    u /= np.linalg.norm(u, axis=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _blocks(batch) @ u
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(directions, dtype=np.int32), len(p))), pa.array(p.ravel())], names=["direction", "p"])

    def curve(df: DataFrame) -> dict[int, np.ndarray]:
        p = df.select("embedding").filter("embedding IS NOT NULL").mapInArrow(project, "direction int, p double")
        ranks = positions(p, ["direction"], [F.col("p").asc()], "rank")
        n = ranks.groupBy("direction").agg(F.max("rank").alias("n"))
        at = ranks.join(F.broadcast(n), "direction")  # a row per direction
        # row of rank r covers steps whose middles lie in (r - 1, r] / n
        low, high = F.ceil((F.col("rank") - 1) * quantiles / F.col("n") - 0.5), F.ceil(F.col("rank") * quantiles / F.col("n") - 0.5)
        rows = at.filter(high > low).select("direction", "p", F.explode(F.sequence(low, high - 1)).alias("step")).collect()  # directions * quantiles rows
        out = {i: np.zeros(quantiles) for i in range(directions)}
        for r in rows:
            out[r["direction"]][r["step"]] = r["p"]
        return out

    x, y = curve(a), curve(b)
    return float(np.sqrt(np.mean([(x[i] - y[i]) ** 2 for i in range(directions)])))


def kde(df: DataFrame, value: str, by: list[str], low: float = 0.0, high: float = 3.5, steps: int = 1000, width: float = 0.05) -> DataFrame:
    """(by..., x, density): Gaussian kernel density of value on an even grid. A partition adds its values to the whole
    grid of each group, so that only grids are shuffled."""
    grid = np.linspace(low, high, steps)
    names = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, g in f.groupby(by, dropna=False, sort=False):
                v = g[value].to_numpy(float)
                s = np.zeros(steps)
                for at in range(0, len(v), 1024):
                    z = (grid - v[at : at + 1024, None]) / width
                    s += np.exp(-0.5 * z * z).sum(axis=0)
                yield pd.DataFrame({**dict(zip(by, key)), "x": grid, "s": s, "n": len(v)})

    parts = df.select(*by, value).filter(F.col(value).isNotNull() & ~F.isnan(value)).mapInPandas(run, f"{names}, x double, s double, n bigint")
    return parts.groupBy(*by, "x").agg((F.sum("s") / F.sum("n") / (width * np.sqrt(2 * np.pi))).alias("density"))


def ood_table(data: DataFrame, learn: DataFrame, cosine: bool = False, seed: int = 1) -> DataFrame:
    """(measure, null_distance, distance): data against learn (vec_id, embedding), and one half of data, drawn by a hash
    of vec_id, against the other as the null. cosine: vectors are set to length 1 first."""
    from vecquarry.functions.vector import l2_normalize

    sizes = [x.select(F.size("embedding").alias("d")).filter("d > 0").distinct().limit(2).collect() for x in (data, learn)]
    if not sizes[1]:
        raise ValueError("there are no learn vectors")
    if any(len(s) != 1 for s in sizes) or sizes[0] != sizes[1]:
        raise ValueError("data and learn need vectors of one dimension")
    if cosine:
        data, learn = (x.withColumn("embedding", l2_normalize(F.col("embedding"))) for x in (data, learn))
    half = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(2))
    a, b = data.filter(half == 0), data.filter(half == 1)
    width = median_bandwidth(data.select("vec_id", "embedding").unionByName(learn.select("vec_id", "embedding")), seed=seed)
    measures = {"mmd": lambda x, y: mmd(x, y, width, seed=seed), "frechet": frechet, "sliced_wasserstein": lambda x, y: sliced_wasserstein(x, y, seed=seed)}
    rows = [(n, float(f(a, b)), float(f(data, learn))) for n, f in measures.items()]
    return data.sparkSession.createDataFrame(rows, "measure string, null_distance double, distance double")
