"""Bisecting k-means on unit vectors (plain numpy, one process).

A tree is fitted on a bounded sample that a caller draws (:func:`fit_leaves`);
the callers then assign *every* row to the leaves across the cluster.
:func:`compact_leaves` splits all rows of one node until every leaf is compact.
"""

from __future__ import annotations

import heapq

import numpy as np


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in float64, returned as float32; zero rows stay zero."""
    m = np.asarray(m, dtype=np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    n[n == 0] = 1.0
    return (m / n[:, None]).astype(np.float32)


def _centre(x: np.ndarray) -> np.ndarray:
    c = x.sum(axis=0, dtype=np.float64)
    n = np.sqrt(c @ c)
    return (c / n if n > 0 else x[0]).astype(np.float32)


def _two_means(x: np.ndarray, iterations: int) -> np.ndarray:
    """Boolean side of every row; the seeds are the row farthest from the centre and the row farthest from it."""
    a = x[np.argmin(x @ _centre(x))]
    b = x[np.argmin(x @ a)]
    side = x @ b > x @ a
    for _ in range(iterations):
        if side.all() or not side.any():
            break
        new = x @ _centre(x[side]) > x @ _centre(x[~side])
        if (new == side).all():
            break
        side = new
    return side


def fit_leaves(x: np.ndarray, max_leaves: int, leaf_rows: float, min_cosine: float = 1.0, iterations: int = 6) -> np.ndarray:
    """Centres (leaves x dims, unit length) of the bisecting tree over the unit rows ``x``, in the order of the tree.

    The node of the largest dispersion (sum of 1 - cosine to its centre) is
    split first.  A node is left alone once it has at most ``leaf_rows`` rows,
    or once every row lies within ``min_cosine`` of its centre, or when all
    its rows are equal.  An empty sample gives no centre.
    """
    if len(x) == 0:
        return np.zeros((0, x.shape[1] if x.ndim == 2 else 0), dtype=np.float32)
    leaves: list[tuple[str, np.ndarray]] = []
    heap: list[tuple[float, str, np.ndarray, np.ndarray]] = []

    def offer(path: str, rows: np.ndarray) -> None:
        part = x[rows]
        c = _centre(part)
        cos = part @ c
        if len(rows) <= leaf_rows or len(rows) < 2 or cos.min() >= min(min_cosine, 1 - 1e-6):
            leaves.append((path, c))
            return
        heapq.heappush(heap, (-float((1 - cos).sum()), path, rows, c))

    offer("", np.arange(len(x)))
    while heap and len(leaves) + len(heap) < max_leaves:
        _, path, rows, c = heapq.heappop(heap)
        side = _two_means(x[rows], iterations)
        if side.all() or not side.any():
            leaves.append((path, c))
            continue
        offer(path + "0", rows[side])
        offer(path + "1", rows[~side])
    leaves.extend((h[1], h[3]) for h in heap)
    return np.vstack([c for _, c in sorted(leaves, key=lambda leaf: leaf[0])])


def compact_leaves(x: np.ndarray, min_cosine: float, iterations: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(leaf of every row, centres): the unit rows ``x`` split until each lies within ``min_cosine`` of the centre of its leaf."""
    own = np.zeros(len(x), np.int64)
    centres: list[np.ndarray] = []
    todo = [np.arange(len(x))] if len(x) else []
    while todo:
        rows = todo.pop()
        part = x[rows]
        c = _centre(part)
        cos = part @ c
        if len(rows) < 2 or cos.min() >= min(min_cosine + 1e-6, 1 - 1e-6):
            own[rows] = len(centres)
            centres.append(c)
            continue
        side = _two_means(part, iterations)
        if side.all() or not side.any():
            side = np.arange(len(rows)) == cos.argmin()
        todo += [rows[~side], rows[side]]
    return own, np.array(centres, np.float32).reshape(-1, x.shape[1])
