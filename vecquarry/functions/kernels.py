"""Distance matrices between blocks of vectors, for use inside Arrow and pandas passes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def matrix(rows) -> np.ndarray:
    return np.stack([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.empty((0, 0))


def prepare(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return np.divide(x, length, out=np.full_like(x, np.nan), where=length > 0)
    return x.astype(np.int64) if metric == "hamming" else x


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of rows of a and b, both already given to prepare(); those of a zero vector under cosine are nan."""
    if metric == "euclidean":
        square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0))
    if metric in ("cosine", "normalized"):
        return np.clip(1 - a @ b.T, 0, 2)
    if metric == "ip":
        return -(a @ b.T)
    if metric == "hamming":
        out = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            out += np.bitwise_count(a[:, j][:, None] ^ b[:, j][None])
        return out
    raise ValueError(f"unknown metric {metric}")


def top_k(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers and distances of the k least of each row, ties by id; nan is left to the end."""
    if not d.shape[1]:
        return np.empty((len(d), 0), int), np.empty((len(d), 0))
    k = min(k, d.shape[1])
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero((d <= kth) | np.isnan(kth))
    by = np.lexsort((ids[col], d[row, col], row))
    row, col = row[by], col[by]
    first = np.searchsorted(row, np.arange(len(d)))  # every row has at least k
    cols = col[first[:, None] + np.arange(k)]
    return cols, np.take_along_axis(d, cols, 1)


def nearest_of(rows: int, ids: np.ndarray, k: int, digits: int, tile_of: Callable[[slice], np.ndarray], tile: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(places in ids, rounded distances) of the k nearest of each row, ties by id, tile_of(slice of ids) being their
    distances, so that no more than rows * (tile + k) distances are held at once."""
    best, near = np.empty((rows, 0), int), np.empty((rows, 0))
    for at in range(0, len(ids), tile):
        some = slice(at, at + tile)
        cols, found = top_k(np.round(tile_of(some), digits), ids[some], k)
        best, near = np.concatenate([best, cols + at], axis=1), np.concatenate([near, found], axis=1)
        by = np.lexsort((ids[best], near), axis=1)[:, :k]  # nan sorts last
        best, near = np.take_along_axis(best, by, 1), np.take_along_axis(near, by, 1)
    return best, near


def nearest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, metric: str, k: int, digits: int, tile: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers of b, rounded distances) of the k nearest of each row of a, in tiles of b."""
    return nearest_of(len(a), ids, k, digits, lambda some: distances(a, b[some], metric), tile)
