"""The grid over kinds of moments against the single erasers and a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenloom import queries as Q
from eigenloom.operators import deltas as D
from eigenloom.operators import erasers as E
from eigenloom.operators.moments import Moments, SourceSpec, collect_moments
from eigenloom.operators.splits import with_folds
from eigenloom.plans import variants as G
from eigenloom.plans.experiments import run_experiment
from eigenloom.roles import Roles

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(3)


def test_a_pair_gives_the_single_erasers():
    x = Moments.of(RNG.standard_normal((200, 6)) @ RNG.standard_normal((6, 6)) + 1)
    d = Moments.of(RNG.standard_normal((80, 6)) * [3, 2, 1, 0.5, 0, 0] + [0.3, 0, 0, 0, 0, 0])
    axes = {"moment": ["second_moment", "covariance"], "shrink_a": [True, False], "shrink_b": [True, False], "normalization": ["none", "trace"], "joint": ["none", "match_x_trace"], "affine": [True, False]}
    every = G.expand_variants(["d"], [{"method": "pca", "ranks": [None, 1, 3], "whiten": [True, False], **axes}, {"method": "soft", "lambdas": [0.1, 10.0], "ranks": [None, 2], **axes}])
    assert len(every) == 64 * (6 + 4) == len(set(every))
    pairs = {}
    for v in every:
        pair = pairs.setdefault(v.pair, G.Pair(x, d, v))
        options = {"specs": [SourceSpec("d", 1.0, v.moment, v.normalization, v.shrink_b)], "joint": v.joint, "shrink_a": v.shrink_a, "ridge": v.ridge, "tol": v.tol, "affine": v.affine}
        got = pair.eraser(v)
        want = E.soft_eraser(x, {"d": d}, v.lam, v.rank, **options) if v.method == "soft" else E.pca_eraser(x, {"d": d}, v.rank, whiten=v.whiten, **options)
        assert np.allclose(got.dense(), want.dense(), atol=1e-7)
        assert (got.bias is None) == (want.bias is None) == (not v.affine)
    assert len(pairs) == 32


def test_variants_are_checked():
    assert [v.lam for v in G.expand_variants(["a"], [{"method": "soft", "lambdas": [2.0, 2.0, 1.0]}])] == [2.0, 1.0]
    assert G.expand_variants(["a"], [{"method": "pca"}])[0].whiten is True
    for bad in ([], [{"method": "magic"}], [{"ranks": [1]}], [{"method": "pca", "lambdas": [1.0]}], [{"method": "soft"}], [{"method": "soft", "lambdas": [1.0], "whiten": True}], [{"method": "pca", "rnk": 1}]):
        with pytest.raises(ValueError):
            G.expand_variants(["a"], bad)


def test_grid_against_a_loop(spark, monkeypatch):
    f = Q.concept_features(spark, SF)
    monkeypatch.setattr(G, "STACK_BYTES", 3 * 8 * 12 * 12)  # three maps at a time
    sources = {"mean": {"mode": "group_to_mean"}, "by_label": {"mode": "group_to_mean", "group": "label"}, "capped": {"mode": "group_pairwise", "max_deltas": 20, "max_test_deltas": 7}}
    erasers = [{"method": "pca", "ranks": [2], "whiten": [True, False]}, {"method": "soft", "lambdas": [5.0], "shrink_b": [True]}]
    made = run_experiment("paired_delta_grid", f, Q.ROLES, {"sources": sources, "erasers": erasers, "n_splits": 2, "probe": None})
    got = {(r.fold, r.source, r.method, r.whiten): r for r in made["scores"].collect()}
    assert len(got) == 2 * 3 * 3
    rows = with_folds(f, "grp", 2).cache()
    for fold in range(2):
        train, test = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        x = collect_moments(train, "x")["default"]
        points = np.array([r.x for r in test.collect()])
        for name, roles, most in (("mean", Roles(), (None, None)), ("by_label", Roles(group="label"), (None, None)), ("capped", Roles(), (20, 7))):
            mode = "group_pairwise" if name == "capped" else "group_to_mean"
            tables = [D.domain_deltas(part, roles, mode, max_deltas=n, seed=at + fold) for part, n, at in ((train, most[0], 0), (test, most[1], 10_000))]
            fit, left = (np.array([r.delta for r in t.collect()]) for t in tables)
            for (method, whiten), m in {
                ("pca", True): E.hard_eraser(x, {"default": Moments.of(fit)}, 2),
                ("pca", False): E.pca_eraser(x, {"default": Moments.of(fit)}, 2),
                ("soft", None): E.soft_eraser(x, {"default": Moments.of(fit)}, 5.0, specs=[SourceSpec(shrink=True)]),
            }.items():
                r = got[fold, name, method, whiten]
                assert (r.n_train, r.n_test, r.n_delta_fit, r.n_delta_test) == (x.n, len(points), len(fit), len(left))
                after = m(left, affine=False)
                assert np.isclose(r.residual_ratio, (after**2).sum() / (left**2).sum(), atol=1e-8)
                assert np.isclose(r.mean_l2_change, np.linalg.norm(m(points) - points, axis=1).mean(), atol=1e-8)
                assert np.isclose(r.map_trace, np.trace(m.dense())) and r.projected_score is None
    summary = {(r.source, r.method, r.whiten): r for r in made["summary"].collect()}
    one = [got[k, "mean", "pca", True].residual_ratio for k in range(2)]
    assert len(summary) == 9 and np.isclose(summary["mean", "pca", True].residual_ratio_mean, np.mean(one)) and summary["mean", "pca", True].n_fold == 2
    rows.unpersist()


def test_probed_erasers_and_empty_sources(spark):
    f = Q.concept_features(spark, SF)
    sources = {"mean": {"mode": "group_to_mean"}, "none": {"mode": "group_to_mean", "group": "lonely"}}
    table = f.withColumn("lonely", F.col("vec_id"))  # groups of one domain give no deltas
    made = G.run_paired_grid(table, Q.ROLES, sources, [{"method": "pca", "ranks": [None, 1], "whiten": False}], n_splits=2, folds=[1])
    got = {r["rank"]: r for r in made["scores"].collect()}
    assert set(got) == {None, 1} and {r.source for r in got.values()} == {"mean"} and {r.fold for r in got.values()} == {1}
    assert all(0 <= r.projected_score <= 1 and r.raw_score > r.chance for r in got.values())
    assert got[None].projected_score < got[None].raw_score
