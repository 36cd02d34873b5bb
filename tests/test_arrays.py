"""Array code of the panel engine, against definitions, closed forms and brute force."""

import itertools

import numpy as np
import pytest

from panelforge.config import Gap, Init, span_decay
from panelforge.operators import cluster as C
from panelforge.operators import solvers as S
from panelforge.operators.diagnostics import gamma_q, null_threshold
from panelforge.operators.ewm import ewm, ewm_covariance, initial, normalise
from panelforge.operators.lineage import match
from panelforge.operators.selection import splits
from panelforge.operators.stability import partition_bonus, smooth_similarity

FREE = np.full(4, np.inf)


def quad(g, c, b):
    return b @ g @ b - 2 * c @ b


def problem(seed, k=3, m=4, t=90):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((t, m))
    y = x @ rng.standard_normal((m, k)) * 0.5 + rng.standard_normal((t, k))
    w = 0.97 ** np.arange(t)[::-1]
    g = (x * w[:, None]).T @ x / t
    return np.stack([g] * k), ((x * w[:, None]).T @ y / t).T, rng


def test_lasso_meets_its_optimality_conditions():
    gs, cs, _ = problem(0)
    for lam in (1e-3, 0.1, 0.4):
        for c in cs:
            b = S.lasso(gs[0], c, lam, -FREE, FREE)
            slope = 2 * (gs[0] @ b - c)
            assert np.all(np.where(b != 0, np.abs(slope + lam * np.sign(b)) < 1e-8, np.abs(slope) <= lam + 1e-8))


def test_many_lassos_are_the_lassos_one_by_one():
    gs, cs, rng = problem(5, k=40)
    gs = gs * rng.uniform(0.5, 2, (40, 1, 1))
    gs[3, :, 1] = gs[3, 1, :] = 0.0  # a factor without variance
    lo, hi = S.bounds(rng.choice([0, 1, -1, np.nan], cs.shape), False, cs.shape)
    prior, weight = rng.standard_normal(cs.shape) * 0.1, rng.uniform(0.5, 2, cs.shape)
    b, rests = S.lasso_many(gs, cs, 0.05, lo, hi, prior, weight)
    assert rests.all() and b[3, 1] == np.clip(prior[3, 1], lo[3, 1], hi[3, 1])
    for i in range(40):
        assert (b[i] == S.lasso(gs[i], cs[i], 0.05, lo[i], hi[i], prior[i], weight[i])).all()
    short, rests = S.lasso_many(gs, cs, 0.05, lo, hi, prior, weight, most=1)
    assert not rests.all() and np.isfinite(short).all()


def test_lasso_without_penalty_is_least_squares_and_bounds_hold():
    gs, cs, _ = problem(1)
    assert np.allclose(S.lasso(gs[0], cs[0], 0.0, -FREE, FREE), np.linalg.solve(gs[0], cs[0]))
    lo, hi = S.bounds(np.array([0, 1, -1, np.nan]), False, (4,))
    b = S.lasso(gs[0], cs[0], 0.01, lo, hi)
    assert b[0] == 0 and b[1] >= 0 and b[2] <= 0
    prior = np.array([0.3, -0.2, 0.1, 0.0])
    assert np.allclose(S.lasso(gs[0], cs[0], 1e3, -FREE, FREE, prior), prior)


@pytest.mark.parametrize("mode", ["row", "block", "cooperative"])
@pytest.mark.parametrize("alpha", [0.0, 0.3])
def test_group_solutions_can_not_be_improved(mode, alpha):
    gs, cs, rng = problem(2)
    free = np.full(cs.shape, np.inf)
    zero = np.zeros(cs.shape)

    def value(b, lam):
        groups = {"row": lambda: np.sqrt((b * b).sum(1)).sum(), "block": lambda: np.sqrt((b * b).sum(0)).sum(), "cooperative": lambda: sum(np.sqrt((np.maximum(s * b, 0) ** 2).sum(0)).sum() for s in (1, -1))}[mode]()
        return sum(quad(g, c, x) for g, c, x in zip(gs, cs, b, strict=True)) + lam * ((1 - alpha) * groups + alpha * np.abs(b).sum())

    for lam in (1e-3, 0.1, 0.3):
        b, _ = S.group_lasso(gs, cs, lam, 1.0, -free, free, zero, alpha, mode)
        at = value(b, lam)
        for _ in range(2000):
            assert value(b + rng.standard_normal(b.shape) * 10.0 ** rng.uniform(-6, 0), lam) >= at - 1e-9


def test_group_program_of_one_response_is_the_lasso_when_all_is_l1():
    gs, cs, _ = problem(3, k=1)
    free = np.full(cs.shape, np.inf)
    assert np.allclose(S.group_lasso(gs, cs, 0.2, 1.0, -free, free, 0 * cs, 1.0, "row")[0][0], S.lasso(gs[0], cs[0], 0.2, -FREE, FREE), atol=1e-6)


def test_unilasso_keeps_the_signs_of_single_slopes():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 4))
    y = x @ np.array([1.0, -1.0, 0, 0]) + rng.standard_normal(80)
    y[:20] = np.nan
    b = S.unilasso(x, y, 0.01)
    assert np.all(b * (x[20:].T @ y[20:]) >= 0) and b[0] > 0 > b[1]
    assert np.all(S.unilasso(x, np.where(np.arange(80) < 4, 1.0, np.nan), 0.01) == 0)


def test_recursion_and_its_gap_rules():
    lam, v = span_decay(3), np.array([1.0, np.nan, 3.0, np.inf])
    assert lam == 0.5
    assert ewm(v, lam, 1.0).tolist() == [1, 1, 2, 2]
    assert ewm(v, lam, 1.0, Gap.DEFLATED).tolist() == [1, 0.5, 1.75, 0.875]
    assert ewm(v, lam, 1.0, Gap.ZERO).tolist() == [1, 0, 1.5, 0]
    assert np.isnan(ewm(v, lam, 1.0, Gap.NULL)).tolist() == [False, True, False, True]
    late = np.array([np.nan, np.nan, 4.0, 2.0])
    assert initial(late, Init.FIRST) == 0 and ewm(late, lam, 0.0)[2] == 2.0  # begins at 0 and jumps
    assert ewm(late, lam, 0.0, from_first=True)[2:].tolist() == [4, 3]
    assert initial(np.array([1.0, 3.0]), Init.VAR) == 1 and initial(np.array([1.0, 3.0]), Init.MEAN) == 2


def test_covariance_recursion_equals_its_weighted_sum():
    a = np.random.default_rng(5).standard_normal((50, 3))
    last = ewm_covariance(a, 0.9)[-1]
    w = 0.9 ** np.arange(50)[::-1] * 0.1
    assert np.allclose(last, (a * w[:, None]).T @ a)
    assert np.allclose(np.diag(normalise(last)), 1) and np.array_equal(normalise(np.zeros((2, 2))), np.eye(2))


def brute_linkage(d, method):
    """Agglomeration from the definitions of the distances between groups."""
    groups, out = {i: [i] for i in range(len(d))}, []
    far = {"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[method]
    while len(groups) > 1:
        (a, b), h = min((((a, b), far([d[i, j] for i in groups[a] for j in groups[b]])) for a, b in itertools.combinations(groups, 2)), key=lambda x: x[1])
        groups[len(d) + len(out)] = groups.pop(a) + groups.pop(b)
        out.append(h)
    return out


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_linkage_equals_its_definition(method):
    p = np.random.default_rng(6).random((9, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    assert np.allclose(C.linkage(d, method)[:, 2], brute_linkage(d, method))


def test_ward_heights_are_the_growth_of_variance():
    p = np.array([[0.0], [1.0], [5.0], [7.0]])
    d = np.abs(p - p.T)
    m = C.linkage(d, "ward")
    assert np.allclose(m[:2, 2], [1, 2]) and m[2, 3] == 4
    assert np.isclose(m[2, 2], np.sqrt(2 * 2 * 2 / 4) * 5.5)  # between the means of two pairs


def test_cuts_and_components():
    r = np.full((6, 6), 0.1)
    r[:3, :3] = r[3:, 3:] = 0.9
    np.fill_diagonal(r, 1)
    assert C.clusters(r)[0].tolist() == [1, 1, 1, 2, 2, 2]
    assert C.clusters(r, n_clusters=1)[0].max() == 1 and C.clusters(r, n_clusters=99)[0].max() == 6
    left, audit = C.remove_first_component(r)
    assert np.allclose(np.diag(left), 1) and audit["eigenvalue"] > 2
    with pytest.raises(ValueError):
        C.remove_first_component(r * 2)


def test_matching_equals_brute_force():
    rng = np.random.default_rng(20)
    for _ in range(120):
        n, m = rng.integers(1, 6, 2)
        edges = [(a, b, float(rng.integers(1, 9999))) for a in range(n) for b in range(m) if rng.random() < 0.55]
        weight = {(a, b): w for a, b, w in edges}
        best = 0.0
        for chosen in itertools.product(range(-1, m), repeat=int(n)):
            used = [b for b in chosen if b >= 0]
            if len(set(used)) == len(used) and all(b < 0 or (a, b) in weight for a, b in enumerate(chosen)):
                best = max(best, sum(weight[a, b] for a, b in enumerate(chosen) if b >= 0))
        got = match(int(n), int(m), edges)
        assert np.isclose(sum(weight[a, b] for a, b in got.items()), best)
    assert match(2, 2, [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)]) == {0: 1, 1: 0}
    with pytest.raises(ValueError):
        match(1, 1, [(0, 1, 1.0)])


def test_chi_squared_quantiles():
    assert abs(null_threshold(1) - 3.841458820694124) < 1e-9
    assert abs(null_threshold(10, 0.01) - 23.209251158954356) < 1e-8
    assert abs(gamma_q(1.0, 2.0) - np.exp(-2.0)) < 1e-14


def test_splits_leave_the_rest_at_the_end():
    assert splits(23, 4) == [(4, 4, 8), (8, 8, 12), (12, 12, 16), (16, 16, 20)]
    with pytest.raises(ValueError):
        splits(3, 4)


def test_smoothers():
    c, before = np.array([[1, 0.2], [0.2, 1]]), np.array([[1, 0.8], [np.nan, 1]])
    assert np.allclose(smooth_similarity(c, before, 0.5), [[1, 0.5], [0.2, 1]])
    d = np.array([[0, 0.3, 0.9], [0.3, 0, 0.5], [0.9, 0.5, 0]])
    assert partition_bonus(d, [1, 1, None], 0.4).tolist() == [[0, 0, 0.9], [0, 0, 0.5], [0.9, 0.5, 0]]


def test_span_checks():
    for bad in (0.5, float("nan"), None, "x"):
        with pytest.raises(ValueError):
            span_decay(bad)
