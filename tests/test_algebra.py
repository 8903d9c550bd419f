"""Golden values and defining properties of the driver-side algebra."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eigenloom.operators import erasers as E
from eigenloom.operators import geometry as G
from eigenloom.operators import metrics as M
from eigenloom.operators import moments as Mo
from eigenloom.plans import grid

RNG = np.random.default_rng(0)
RAW = dict(affine=False, shrink_a=False, ridge=0.0)


def moments_with(cov, n=10):
    """Moments of mean zero whose second moment and (n large) covariance are as given."""
    return Mo.Moments(n, np.zeros(len(cov)), np.asarray(cov, float) * n)


def sample(n=200, d=6, shift=0.0):
    return Mo.Moments.of(RNG.standard_normal((n, d)) @ RNG.standard_normal((d, d)) + shift)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=6), st.integers(0, 1000))
def test_merging_does_not_depend_on_parts(sizes, seed):
    x = np.random.default_rng(seed).standard_normal((sum(sizes), 3)) * 5 + 100
    whole, parts, at = Mo.Moments.of(x), Mo.Moments.empty(3), 0
    for n in sizes:
        parts, at = parts.merge(Mo.Moments.of(x[at : at + n])), at + n
    assert parts.n == whole.n and np.allclose(parts.mean, whole.mean) and np.allclose(parts.m2, whole.m2)


def test_shrinkage_golden():
    s = np.diag([4.0, 1.0])
    assert np.isclose(Mo.shrinkage_weight(s, 10), 4 / 9)
    assert np.allclose(Mo.shrinkage(s, 10), np.diag([19 / 6, 11 / 6]))


def test_moment_denominators():
    m = Mo.Moments.of(np.array([[0, -2], [-2, 0], [2, 2]], float))
    assert np.allclose(m.covariance(), [[4, 2], [2, 4]])
    assert np.allclose(m.second_moment(), [[8 / 3, 4 / 3], [4 / 3, 8 / 3]])
    with pytest.raises(ValueError):
        Mo.Moments.of(np.ones((1, 2))).covariance()


def test_soft_golden():
    a, b = Mo.Moments(2, np.zeros(2), np.diag([4.0, 1.0])), {"default": moments_with(np.diag([1.0, 0.0]))}
    assert np.allclose(E.soft_eraser(a, b, 4.0, **RAW).dense(), np.diag([0.5, 1]))
    assert np.allclose(E.soft_eraser(a, b, 4.0, joint="match_x_trace", **RAW).dense(), np.diag([1 / 6, 1]))
    assert np.allclose(E.soft_eraser(a, b, 0.0, **RAW).dense(), np.eye(2))


def test_families_and_limits():
    x, s = sample(), {"default": sample(50, 6, 1.0)}
    member, values = E.soft_family(x, s)
    for lam in (0.1, 3.0, 50.0):
        one, many = E.soft_eraser(x, s, lam).dense(), member(lam).dense()
        assert np.allclose(one, many, atol=1e-7)
    assert values[0] == values.max()
    few = {"default": Mo.Moments.of(np.outer(RNG.standard_normal(20), RNG.standard_normal(6)))}
    hard, soft = E.hard_eraser(x, few).dense(), E.soft_eraser(x, few, 1e9).dense()
    assert np.allclose(hard, soft, atol=1e-3)
    low = E.soft_eraser(x, s, 3.0, rank=6)
    assert np.allclose(low.dense(), E.soft_eraser(x, s, 3.0).dense(), atol=1e-6)


def test_projections():
    x, s = sample(), {"default": sample(50, 6, 1.0)}
    for m in (E.pca_eraser(x, s, 2), E.pca_eraser(x, s, 2, whiten=True), E.hard_eraser(x, s, 3)):
        p = m.dense()
        assert np.allclose(p @ p, p) and m.rank == m.left.shape[1]
    p = E.pca_eraser(x, s, 2).dense()
    assert np.trace(p @ x.covariance() @ p.T) <= np.trace(x.covariance())
    line = {"default": Mo.Moments.of(np.outer([1.0, -2.0, 3.0], [1, 0, 2, 0, 0, 1]))}
    gone = E.pca_eraser(x, line, 1, affine=False)(np.array([[1, 0, 2, 0, 0, 1.0]]))
    assert np.allclose(gone, 0)


def test_leace_golden_and_means():
    x = np.array([[1, 1], [1, -1], [-1, 1], [-1, -1]], float)
    m = Mo.Moments.of(x)
    cross = np.array([[-2 / 3, 2 / 3], [0, 0]])
    got = E.leace_eraser(Mo.CrossMoments(m, ["0", "1"], cross), shrink=False)
    assert np.allclose(got.dense(), np.diag([0, 1])) and np.allclose(got(x)[:, 0], 0)
    rows, labels = RNG.standard_normal((300, 5)) @ RNG.standard_normal((5, 5)), RNG.integers(0, 3, 300)
    rows[:, :3] += np.eye(3)[labels] * 2
    whole = Mo.Moments.of(rows)
    cross = np.stack([(labels == k).sum() * (rows[labels == k].mean(0) - rows.mean(0)) / 299 for k in range(3)], 1)
    for options in ({}, {"whiten": False}, {"constrain_trace": False}):
        m = E.leace_eraser(Mo.CrossMoments(whole, list("012"), cross), shrink=False, tol=1e-6, **options)
        means = [m(rows)[labels == k].mean(0) for k in range(3)]
        assert np.allclose(means[0], means[1]) and np.allclose(means[0], means[2])
        if options != {"constrain_trace": False}:
            assert np.trace(np.cov(m(rows).T)) <= np.trace(np.cov(rows.T)) * (1 + 1e-6)


def test_capped_simplex_and_fantope():
    assert np.allclose(E.capped_simplex(np.array([0.2, 0.9, 1.5]), 1), [0, 0.2, 0.8])
    f = np.linalg.eigvalsh(E.fantope(RNG.standard_normal((5, 5)), 2))
    assert np.isclose(f.sum(), 2) and f.min() > -1e-9 and f.max() < 1 + 1e-9


def test_chains_and_push_through():
    x, s = sample(300, 6, 2.0), {"default": sample(60, 6, 1.0)}
    chain = [E.soft_eraser(x, s, 2.0), E.pca_eraser(x, s, 1)]
    rows = RNG.standard_normal((40, 6)) + 3
    one = chain[1](chain[0](rows))
    assert np.allclose(E.compose(chain)(rows), one)
    m = Mo.Moments.of(rows)
    pushed = chain[1].of_moments(chain[0].of_moments(m))
    assert np.allclose(pushed.mean, one.mean(0)) and np.allclose(pushed.m2, Mo.Moments.of(one).m2)


def test_joint_moments_are_checked():
    s = {"a": sample(), "b": sample()}
    both = Mo.joint_moment(s, [Mo.SourceSpec("a", 1.0), Mo.SourceSpec("b", 3.0)])
    assert np.allclose(both, s["a"].second_moment() / 4 + 3 * s["b"].second_moment() / 4)
    assert np.allclose(Mo.joint_moment(s, [Mo.SourceSpec("a", 2.0), Mo.SourceSpec("none", 0.0)]), s["a"].second_moment())
    for bad in ([Mo.SourceSpec("a"), Mo.SourceSpec("a")], [Mo.SourceSpec("a", -1.0)], [Mo.SourceSpec("a", 0.0)]):
        with pytest.raises(ValueError):
            Mo.joint_moment(s, bad)
    assert np.isclose(np.trace(Mo.normalised(both, "trace")), 1) and np.isclose(np.linalg.norm(Mo.normalised(both, "frobenius")), 1)
    with pytest.raises(RuntimeError):
        Mo.normalised(np.zeros((2, 2)), "trace")


def test_geometry():
    e = np.eye(3)
    assert np.allclose(np.sort(G.principal_cosines(e[:2], e[1:])), [0, 1])
    assert G.subspace_overlap(e[:2], e[1:]) == {"mean_squared_cosine": 0.5, "max_cosine": 1.0}
    assert G.principal_cosines(np.zeros((0, 3)), e) is None
    assert G.orthonormal_rows(np.array([[1, 0, 0], [2, 0, 0], [0, 3.0, 0]])).shape == (2, 3)
    points = RNG.standard_normal((7, 2))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    y = G.classical_mds(d)
    assert np.allclose(np.linalg.norm(y[:, None] - y[None], axis=2), d)
    names = list("abcdefg")
    chosen = G.exemplars(names, d, 3, {"a"})
    assert len(set(chosen)) == 3 and "a" not in chosen
    assert G.numerical_rank(Mo.Moments.of(np.outer(np.arange(5.0), [1, 2, 3]))) == 1


def test_metrics():
    s = M.spectrum(np.array([3.0, 1.0]))
    assert (s["trace"], s["top1_fraction"], s["participation_rank"], s["rank50"], s["rank80"]) == (4, 0.75, 1.6, 1, 2)
    assert np.isclose(s["entropy_rank"], 1.7547653506)
    assert M.attenuation(np.array([0.0, 1.0]), 1.0)["mean"] == 0.75
    m = E.LinearMap(left=np.eye(2)[:, 1:], right=np.eye(2)[1:])
    assert np.isclose(M.residual_from_moments(Mo.Moments.of(np.array([[3.0, 4], [0, 5]])), m)["residual_ratio"], 9 / 50)
    assert M.eraser_diagnostics(m)["rank_1e-5"] == 1


def test_stage_expansion():
    stages = grid.expand_stage({"method": "soft", "lambdas": [1.0, 10.0], "ranks": [4, None, 2, 4]})
    assert [(s.options["lam"], s.options["rank"]) for s in stages] == [(1.0, None), (1.0, 2), (1.0, 4), (10.0, None), (10.0, 2), (10.0, 4)]
    assert stages[0].name == "soft_lam1_rankfull"
    with pytest.raises(ValueError):
        grid.expand_stage({"method": "magic"})


def test_maps_are_checked():
    for bad in ({}, {"matrix": np.ones((2, 3))}, {"left": np.ones((3, 1)), "right": np.ones((2, 3))}, {"matrix": np.eye(2), "bias": np.ones(3)}):
        with pytest.raises(ValueError):
            E.LinearMap(**bad)
