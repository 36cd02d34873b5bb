"""Hierarchical clusters from a dependence matrix, in array code; one matrix is a unit of work."""

from __future__ import annotations

import numpy as np

LINKAGES = ("single", "complete", "average", "weighted", "centroid", "median", "ward")


def to_distance(corr: np.ndarray, kind: str = "linear") -> np.ndarray:
    r = np.clip(np.nan_to_num(corr), -1, 1)
    d = {"linear": lambda: 1 - r, "root": lambda: np.sqrt(2 * (1 - r)), "angle": lambda: np.arccos(r)}[kind]()
    np.fill_diagonal(d, 0.0)
    return d


def linkage(distance: np.ndarray, method: str = "ward") -> np.ndarray:
    """Merges (left, right, height, size) in order; ids from n on are merged clusters. Distances to a merged cluster follow the Lance-Williams formula."""
    if method not in LINKAGES:
        raise ValueError(f"unknown linkage {method!r}")
    n = len(distance)
    square = method in ("ward", "centroid", "median")
    d = distance.astype(float) ** 2 if square else distance.astype(float).copy()
    d = (d + d.T) / 2
    np.fill_diagonal(d, np.inf)
    ids, size, out = np.arange(n), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        a, b = size[i], size[j]
        left, right = sorted((int(ids[i]), int(ids[j])))
        out.append((left, right, np.sqrt(max(h, 0)) if square else h, a + b))
        x, y, c = d[i], d[j], size
        if method == "single":
            new = np.minimum(x, y)
        elif method == "complete":
            new = np.maximum(x, y)
        elif method == "average":
            new = (a * x + b * y) / (a + b)
        elif method == "weighted":
            new = (x + y) / 2
        elif method == "centroid":
            new = (a * x + b * y) / (a + b) - a * b * h / (a + b) ** 2
        elif method == "median":
            new = (x + y) / 2 - h / 4
        else:
            new = ((a + c) * x + (b + c) * y - c * h) / (a + b + c)
        alive[j] = False
        new = np.where(alive, new, np.inf)
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        ids[i], size[i] = n + step, a + b
    return np.array(out).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, height: float) -> np.ndarray:
    """Labels from 1 by first appearance: all members below a merge whose highest merge is at most `height`."""
    top = np.zeros(n + len(merges))
    for k, (a, b, h, _) in enumerate(merges):
        top[n + k] = max(h, top[int(a)], top[int(b)])
    root = list(range(n + len(merges)))
    for k, (a, b, _, _) in enumerate(merges):
        if top[n + k] <= height:
            root[int(a)] = root[int(b)] = n + k

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen: dict[int, int] = {}
    return np.array([seen.setdefault(find(i), len(seen) + 1) for i in range(n)])


def clusters(corr: np.ndarray, fraction: float = 0.5, method: str = "ward", kind: str = "linear", n_clusters: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, merges, height of the cut). By a fraction of the largest distance, or so many clusters at most."""
    n = len(corr)
    if n == 1:
        return np.array([1]), np.zeros((0, 4)), 0.0
    return cluster_distance(to_distance(corr, kind), fraction, method, n_clusters)


def cluster_distance(d: np.ndarray, fraction: float, method: str, n_clusters: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    n = len(d)
    merges = linkage(d, method)
    if n_clusters is None:
        at = fraction * float(d.max())
        return cut(merges, n, at), merges, at
    for h in sorted({0.0, *merges[:, 2]}):
        labels = cut(merges, n, h)
        if labels.max() <= min(n_clusters, n):
            return labels, merges, float(h)
    raise AssertionError("one cluster is always possible")


def remove_first_component(corr: np.ndarray) -> tuple[np.ndarray, dict]:
    """Without its first principal component, scaled back to a unit diagonal. Series of which nothing is left stand alone."""
    if not np.isfinite(corr).all() or np.abs(corr).max() > 1 + 1e-9:
        raise ValueError("a correlation matrix has values beyond [-1, 1] or none")
    r = (corr + corr.T) / 2
    values, vectors = np.linalg.eigh(r)
    left = r - values[-1] * np.outer(vectors[:, -1], vectors[:, -1])
    var = np.diag(left).copy()
    ok = var > 1e-12
    s = np.where(ok, 1 / np.sqrt(np.where(ok, var, 1)), 0.0)
    out = np.clip(left * np.outer(s, s), -1, 1)
    np.fill_diagonal(out, 1.0)
    return out, {"eigenvalue": float(values[-1]), "share": float(values[-1] / len(r)), "loadings": vectors[:, -1], "isolated": np.flatnonzero(~ok)}
