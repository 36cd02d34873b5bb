"""Convex programs of one unit (a response, or the responses of one cluster) from its weighted moments.

The loss is (1/T) * sum of w2 * (y - x b)^2, T being all rows. With G = sum w2 x x' / T and c = sum w2 x y / T it is b'Gb - 2c'b + const, so a solver sees M x M numbers a response and no rows. lo and hi are bounds of each coefficient, from signs.
"""

from __future__ import annotations

import numpy as np


#: How far a step of ADMM goes beyond the quadratic's solution; 1 is not at all.
RELAX = 1.6


def bounds(signs: np.ndarray | None, nonneg: bool, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """0 pins a coefficient, 1 and -1 keep its sign, NaN leaves it free. A sign matrix stands before nonneg."""
    if signs is None:
        return np.full(shape, 0.0 if nonneg else -np.inf), np.full(shape, np.inf)
    s = np.asarray(signs, float)
    return np.where((s == 0) | (s > 0), 0.0, -np.inf), np.where((s == 0) | (s < 0), 0.0, np.inf)


def soft(x, k):
    return np.sign(x) * np.maximum(np.abs(x) - k, 0.0)


def lasso_many(gs: np.ndarray, cs: np.ndarray, lam: float, lo: np.ndarray, hi: np.ndarray, prior: np.ndarray | None = None, penalty: np.ndarray | None = None, start: np.ndarray | None = None, tol: float = 1e-11, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent for K responses at once, gs K x M x M, the rest K x M: each minimizes b'Gb - 2c'b + lam * sum p |b - prior| with lo <= b <= hi. Returns the coefficients and which responses came to rest.

    A response leaves as soon as it rests, so its result doesn't depend on those beside it.
    """
    k, m = cs.shape
    lo, hi = np.broadcast_to(lo, (k, m)), np.broadcast_to(hi, (k, m))
    prior = np.zeros((k, m)) if prior is None else np.broadcast_to(prior, (k, m))
    p = np.full((k, m), lam) if penalty is None else lam * np.broadcast_to(penalty, (k, m))
    d = np.einsum("kjj->kj", gs)
    flat = d <= 1e-15  # a factor without variance: its coefficient stays as near the prior as the bounds let it
    safe = np.where(flat, 1.0, d)
    root = np.sqrt(np.maximum(d, 1e-15))
    out, at = np.clip(prior if start is None else start, lo, hi).astype(float), np.arange(k)
    rests = np.zeros(k, bool)
    b = out.copy()
    gb = np.einsum("kij,kj->ki", gs, b)
    held = [gs, cs / safe, safe, p / (2 * safe), prior, lo, hi, flat, root]
    for _ in range(most):
        g, target, scale, cut, near, low, high, still, size = held
        moved = np.zeros(len(at))
        for j in range(m):
            new = target[:, j] - gb[:, j] / scale[:, j] + b[:, j] - near[:, j]
            new = near[:, j] + np.where(still[:, j], 0.0, soft(new, cut[:, j]))
            step = np.minimum(np.maximum(new, low[:, j]), high[:, j]) - b[:, j]
            gb += g[:, :, j] * step[:, None]
            b[:, j] += step
            np.maximum(moved, np.abs(step) * size[:, j], out=moved)
        done = moved < tol
        if done.any():
            out[at[done]] = b[done]
            rests[at[done]] = True
            go = ~done
            at, b, gb, held = at[go], b[go], gb[go], [x[go] for x in held]
            if not len(at):
                break
    out[at] = b
    return out, rests


def lasso(g: np.ndarray, c: np.ndarray, lam: float, lo: np.ndarray, hi: np.ndarray, prior: np.ndarray | None = None, penalty: np.ndarray | None = None, start: np.ndarray | None = None, tol: float = 1e-11, most: int = 20_000) -> np.ndarray:
    """The coefficients of one response."""
    one = lambda x: None if x is None else np.asarray(x, float)[None]
    return lasso_many(g[None], c[None], lam, one(lo), one(hi), one(prior), one(penalty), one(start), tol, most)[0][0]


def shrink(v: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Each row of v towards 0 by k in length."""
    n = np.sqrt((v * v).sum(-1, keepdims=True))
    return v * np.maximum(0.0, 1 - np.asarray(k)[..., None] / np.maximum(n, 1e-300))


def row_prox(k):
    return lambda v: shrink(v, k)


def block_prox(k):
    """Blocks are columns of v: one factor over the responses of a cluster."""
    return lambda v: shrink(v.T, k).T


def cooperative_prox(k):
    """Positive and negative parts of a block shrink apart."""
    return lambda v: shrink(np.maximum(v, 0).T, k).T - shrink(np.maximum(-v, 0).T, k).T


def admm(gs: np.ndarray, cs: np.ndarray, group_prox, lam1: np.ndarray | float, lo: np.ndarray, hi: np.ndarray, prior: np.ndarray, start: np.ndarray | None = None, tol: float = 1e-9, most: int = 20_000) -> tuple[np.ndarray, bool]:
    """min sum_i b_i'G_i b_i - 2c_i'b_i + group(b - prior) + lam1 * |b - prior| with bounds, for K responses: gs K x M x M, cs K x M.

    Returns the coefficients and whether the steps came to rest. Three copies: the quadratic, the group penalty, and l1 with bounds. group_prox(scale) gives the operator for a penalty times scale. The step is changed while the two residuals are far apart.
    """
    k, m = cs.shape
    b = prior.copy() if start is None else start.copy()
    rho = max(1e-6, float(np.trace(gs.sum(0))) / (k * m))
    zs = [b - prior, b - prior]
    us = [np.zeros_like(b), np.zeros_like(b)]

    def factor(r):
        return np.linalg.inv(2 * gs + 2 * r * np.eye(m))

    inverse, rests = factor(rho), False
    for n in range(most):
        rhs = 2 * cs + rho * sum(z - u + prior for z, u in zip(zs, us, strict=True))
        b = np.einsum("kij,kj->ki", inverse, rhs)
        v = b - prior
        old = zs
        over = [RELAX * v + (1 - RELAX) * z for z in old]
        zs = [group_prox(1 / rho)(over[0] + us[0]), np.clip(soft(over[1] + us[1], lam1 / rho), lo - prior, hi - prior)]
        for z, u, x in zip(zs, us, over, strict=True):
            u += x - z
        primal = max(np.abs(v - z).max() for z in zs)
        dual = rho * max(np.abs(z - o).max() for z, o in zip(zs, old, strict=True))
        size = max(1e-3, np.abs(v).max())
        if primal < tol * size and dual < tol * max(1e-3, np.abs(cs).max()):
            rests = True
            break
        if n % 25 == 24:
            scale = 2.0 if primal > 10 * dual else 0.5 if dual > 10 * primal else 1.0
            if scale != 1:
                rho *= scale
                us = [u / scale for u in us]
                inverse = factor(rho)
    # the copy with exact zeros and bounds, zero where the group penalty says so
    z = np.where(zs[0] == 0, np.clip(0.0, lo - prior, hi - prior), zs[1])
    return z + prior, rests


def group_lasso(gs, cs, lam, weight, lo, hi, prior, alpha=0.0, mode="row", row_weights=None, col_weights=None, penalty=None, start=None):
    """Sparse group programs of one cluster: coefficients, and whether the solver came to rest. alpha: share of the l1 penalty; weight: the cluster's; row_weights of responses, col_weights of factors."""
    k, m = cs.shape
    lam1 = lam * alpha * (np.ones((k, m)) if penalty is None else penalty)
    base = lam * (1 - alpha) * weight
    if mode == "row":
        scale = base * (np.ones(k) if row_weights is None else row_weights)
        prox = lambda s: row_prox(scale * s)
    else:
        scale = base * (np.ones(m) if col_weights is None else col_weights)
        prox = (lambda s: block_prox(scale * s)) if mode == "block" else (lambda s: cooperative_prox(scale * s))
    return admm(gs, cs, prox, lam1, lo, hi, prior, start)


def unilasso(x: np.ndarray, y: np.ndarray, lam: float, loo: bool = True, nonneg: bool = True) -> np.ndarray:
    """One response: slopes on single factors, then a lasso on their (leave-one-out) predictions, with non-negative coefficients. Rows without y are left out; fewer than 5 give zeros."""
    ok = np.isfinite(y)
    if ok.sum() < 5:
        return np.zeros(x.shape[1])
    x, y = np.nan_to_num(x[ok]), y[ok]
    xx, xy = (x * x).sum(0), x.T @ y
    slope = np.divide(xy, xx, out=np.zeros_like(xy), where=xx > 0)
    if loo:
        rest = xx - x * x
        eta = x * np.divide(xy - x * y[:, None], rest, out=np.zeros_like(x), where=rest > 0)
    else:
        eta = x * slope
    t = len(y)
    lo = np.zeros(x.shape[1]) if nonneg else np.full(x.shape[1], -np.inf)
    theta = lasso(eta.T @ eta / t, eta.T @ y / t, lam, lo, np.full(x.shape[1], np.inf))
    return theta * slope
