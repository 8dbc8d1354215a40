"""Neighbour graphs over a bounded block of vectors, in memory: building, pruning and searching by beams."""

from __future__ import annotations

import numpy as np

from vecquarry.functions.kernels import nearest

#: Descent within a block ends when a step changes at most this share of the edges.
CHANGED_LEAST = 0.001


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of a[i] and b[i], both already given to prepare()."""
    if metric == "euclidean":
        return np.sqrt(np.einsum("ij,ij->i", a - b, a - b))
    if metric == "hamming":
        return np.bitwise_count(a ^ b).sum(axis=1).astype(float)
    p = np.einsum("ij,ij->i", a, b)
    return -p if metric == "ip" else np.clip(1 - p, 0, 2)


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run, place in it) of the elements of runs of these lengths."""
    back = np.repeat(np.arange(len(lengths)), lengths)
    return back, np.arange(len(back)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def best_of(row: np.ndarray, column: np.ndarray, distance: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, distances) of the k least of each of n rows, each column once; -1 and infinity where there are fewer."""
    by = np.lexsort((column, distance, row))
    row, column, distance = row[by], column[by], distance[by]
    once = np.unique(row * (column.max(initial=0) + 1) + column, return_index=True)[1]
    once.sort()
    row, column, distance = row[once], column[once], distance[once]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    out, near = np.full((n, k), -1), np.full((n, k), np.inf)
    out[row[kept], place[kept]], near[row[kept], place[kept]] = column[kept], distance[kept]
    return out, near


def descend(x: np.ndarray, k: int, metric: str, seed: int = 1, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, distances) of k rows each: neighbours of neighbours in either direction are tried, step by step from
    random ones, until a step changes few edges. x has been given to prepare()."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.full((n, 1), -1), np.full((n, 1), np.inf)
    start = np.random.default_rng(seed).integers(0, n, (n, k))
    row = np.repeat(np.arange(n), k)
    col = start.ravel()
    other = row != col
    near, far = best_of(row[other], col[other], pair_distances(x[row[other]], x[col[other]], metric), n, k)
    for _ in range(most):
        s, d = np.repeat(np.arange(n), k), near.ravel()
        s, d = s[d >= 0], d[d >= 0]
        s, d = np.concatenate([s, d]), np.concatenate([d, s])
        by = np.argsort(s, kind="stable")
        s, d = s[by], d[by]
        begin = np.searchsorted(s, np.arange(n + 1))
        found = [(np.repeat(np.arange(n), k)[near.ravel() >= 0], near.ravel()[near.ravel() >= 0], far.ravel()[near.ravel() >= 0])]
        for a in range(0, n, 1024):  # rows whose second neighbours are held at once
            rows = np.arange(a, min(a + 1024, n))
            back, step = _runs(begin[rows + 1] - begin[rows])
            mid, own = d[begin[rows][back] + step], rows[back]
            back, step = _runs(begin[mid + 1] - begin[mid])
            two, own = d[begin[mid][back] + step], own[back]
            pairs = np.unique(own * n + two)
            own, two = pairs // n, pairs % n
            other = own != two
            own, two = own[other], two[other]
            value = pair_distances(x[own], x[two], metric)
            better = value <= far[own, -1]
            found.append((own[better], two[better], value[better]))
        new, distance = best_of(*map(np.concatenate, zip(*found)), n, k)
        changed = (new[:, :, None] != near[:, None, :]).all(axis=2).sum()
        near, far = new, distance
        if changed <= CHANGED_LEAST * n * k:
            break
    return near, far


def neighbour_lists(x: np.ndarray, k: int, metric: str, by_descent: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, distances) of the k nearest other rows, exact in tiles or by descent."""
    if by_descent:
        return descend(x, k, metric, seed)
    cols, d = nearest(x, x, np.arange(len(x)), metric, k + 1, 6)
    row = np.repeat(np.arange(len(x)), cols.shape[1])
    other = (row != cols.ravel()) & ~np.isnan(d.ravel())
    return best_of(row[other], cols.ravel()[other], d.ravel()[other], len(x), k)


def prune_lists(x: np.ndarray, near: np.ndarray, far: np.ndarray, degree: int, metric: str, alpha: float) -> np.ndarray:
    """A mask of near: of each row's neighbours, nearest first, one is kept unless a kept one is nearer to it by the
    factor alpha; at most `degree`."""
    n, k = near.shape
    kept = np.zeros((n, k), bool)
    for a in range(0, n, 1024):
        rows = slice(a, min(a + 1024, n))
        ids, d = near[rows], far[rows]
        for i in range(k):
            ok = (ids[:, i] >= 0) & (kept[rows].sum(axis=1) < degree)
            at = np.flatnonzero(ok)
            for j in range(i):
                rivals = at[kept[rows][at, j]]
                between = pair_distances(x[ids[rivals, i]], x[ids[rivals, j]], metric)
                ok[rivals] &= alpha * between > d[rivals, i]
                at = np.flatnonzero(ok)
            kept[a : a + len(ids)][:, i] = ok
    return kept


def adjacency(sources: np.ndarray, targets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends of edges) of a graph in both directions, each edge once."""
    s, d = np.concatenate([sources, targets]), np.concatenate([targets, sources])
    pairs = np.unique(s.astype(np.int64) * n + d)
    return np.searchsorted(pairs // n, np.arange(n + 1)), pairs % n


def beam_search(q: np.ndarray, x: np.ndarray, begin: np.ndarray, targets: np.ndarray, starts: np.ndarray, width: int, metric: str, steps: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, distances, distances computed) of the `width` best rows each query reaches: all queries move along the edges
    of their beams' new rows at once, until no beam changes (or for so many steps). q and x have been given to prepare()."""
    n, m = len(x), len(q)
    seen = np.zeros((m, n), bool)
    row, col = np.repeat(np.arange(m), len(starts)), np.tile(starts, m)
    seen[row, col] = True
    beam, far = best_of(row, col, pair_distances(q[row], x[col], metric), m, width)
    computed = np.full(m, len(starts))
    fresh = beam >= 0
    while fresh.any() and (steps is None or steps > 0):
        steps = None if steps is None else steps - 1
        at, place = np.nonzero(fresh)
        node = beam[at, place]
        back, step = _runs(begin[node + 1] - begin[node])
        pairs = np.unique(at[back] * n + targets[begin[node][back] + step])
        row, col = pairs // n, pairs % n
        new = ~seen[row, col]
        row, col = row[new], col[new]
        seen[row, col] = True
        value = pair_distances(q[row], x[col], metric)
        computed += np.bincount(row, minlength=m)
        better = value < far[row, -1]
        own = np.nonzero(beam >= 0)
        before = beam
        beam, far = best_of(np.concatenate([own[0], row[better]]), np.concatenate([beam[own], col[better]]), np.concatenate([far[own], value[better]]), m, width)
        fresh = (beam >= 0) & (beam[:, :, None] != before[:, None, :]).all(axis=2)
    return beam, far, computed


