"""Grids over two concepts and the stacked probes against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eigenloom import queries as Q
from eigenloom.operators import probe as P
from eigenloom.operators import sgd
from eigenloom.operators.erasers import compose, fantope, minimax_sums, rlace_eraser
from eigenloom.operators.metrics import residual_from_moments
from eigenloom.operators.moments import collect_moments, label_moments
from eigenloom.operators.splits import test_rows as rows_inside
from eigenloom.operators.splits import train_rows, with_folds
from eigenloom.operators.stain import delta_sources
from eigenloom.plans import concepts
from eigenloom.plans.experiments import run_experiment
from eigenloom.plans.grid import expand_stage, fit_stage, fold_state

SF = "/root/testdata/sf0.001"
ROLES = Q.ROLES


def slow_epochs(x, y, n_classes, weights, by_class, rate, alpha, epochs):
    """Row by row and class by class, steps of 32 rows."""
    w = [[*map(float, r)] for r in weights]
    for _ in range(epochs):
        for at in range(0, len(x), 32):
            rows = list(zip(x[at : at + 32], y[at : at + 32], strict=True))
            steps = []
            for c in range(n_classes):
                step = np.zeros(x.shape[1] + 1)
                for row, own in rows:
                    p = 1 / (1 + np.exp(-(np.dot(row, w[c][:-1]) + w[c][-1])))
                    step += by_class[own] * (p - (own == c)) * np.append(row, 1) / len(rows)
                step[:-1] += alpha * np.array(w[c][:-1])
                steps.append(step)
            w = [np.array(w[c]) - rate * steps[c] for c in range(n_classes)]
    return np.array(w)


def labelled(spark, n, d, seed=0, folds=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.standard_normal((n, d)) + 1.5 * np.eye(3, d)[y]
    rows = [(k, k % folds, int(c), v.tolist()) for k, (c, v) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "key long, fold int, y int, x array<double>"), x, y


def test_one_shard_against_a_loop(spark):
    df, x, y = labelled(spark, 150, 4)
    blocks = sgd.pack(df.withColumn("split", F.lit(None).cast("string")), ["key"])
    at = {}
    for r in blocks.collect():
        at[r.fold] = (np.frombuffer(bytes(r.x)).reshape(-1, 4), np.frombuffer(bytes(r.y), np.int32))
    assert sorted(at) == [0, 1, 2] and sum(len(b[1]) for b in at.values()) == 150
    view = sgd.View(0, np.eye(4) * 0.5, np.arange(4) / 10)
    by_class = 100 / (3 * np.bincount(y[np.arange(150) % 3 != 0]))
    got, loss = sgd._round(blocks, [view], np.zeros((1, 3, 5)), by_class[None], 0.3, 1e-3, 1)
    want = [slow_epochs(at[f][0] * 0.5 + np.arange(4) / 10, at[f][1], 3, np.zeros((3, 5)), by_class, 0.3, 1e-3, sgd.EPOCHS) for f in (1, 2)]
    assert np.allclose(got[0], (len(at[1][1]) * want[0] + len(at[2][1]) * want[1]) / (len(at[1][1]) + len(at[2][1])))
    assert loss.shape == (1,) and loss[0] > 0


def test_a_stack_gives_what_each_probe_gives_alone(spark, monkeypatch):
    df, x, y = labelled(spark, 240, 5, 1)
    blocks = sgd.pack(df.withColumn("split", F.lit(None).cast("string")).repartition(4), ["key"])
    rng = np.random.default_rng(2)
    views = [sgd.View(f, m, rng.standard_normal(5)) for f in (0, 1, 2, None) for m in (np.eye(5), np.diag([1.0, 0, 0, 0, 1]))]
    together = sgd.fit_probes(blocks, views, 3, max_epochs=60)
    alone = np.concatenate([sgd.fit_probes(blocks, [v], 3, max_epochs=60) for v in views])
    assert np.allclose(together, alone)
    monkeypatch.setattr(sgd, "STACK_BYTES", 8 * 25 * 3)
    assert np.allclose(sgd.fit_probes(blocks, views, 3, max_epochs=60), together)
    scores = sgd.score_probes(blocks, views, together)
    for view, w, s in zip(views[:6], together, scores, strict=False):
        own = np.arange(240) % 3 == view.fold
        said = ((x[own] @ view.matrix.T + view.offset) @ w[:, :-1].T + w[:, -1]).argmax(axis=1)
        assert s["accuracy"] == pytest.approx((said == y[own]).mean()) and s["n_test"] == own.sum() and s["n_train"] == (~own).sum()
        assert s["balanced_accuracy"] == pytest.approx(np.mean([(said == c)[y[own] == c].mean() for c in range(3)]))
    assert scores[0]["balanced_accuracy"] > 0.6 > scores[1]["balanced_accuracy"]


def test_probes_by_name_and_of_ones_own(spark):
    df, x, y = labelled(spark, 200, 4, 3)
    for kind in ("sgd", "sgd_safe"):
        score = P.evaluate_probe(train_rows(df, 0), rows_inside(df, 0), "x", "y", kind)
        assert score["balanced_accuracy"] > 0.6 and score["chance"] == pytest.approx(1 / 3)
    unseen = df.withColumn("y", F.when((F.col("fold") == 0) & (F.col("key") < 9), 7).otherwise(F.col("y")))
    with pytest.raises(ValueError, match="lacks"):
        P.probe_cv(unseen, "x", "y", "sgd")
    with pytest.raises(ValueError, match="lacks"):
        P.evaluate_probe(train_rows(unseen, 0), rows_inside(unseen, 0), "x", "y", "sgd")
    with pytest.raises(ValueError, match="two classes"):
        P.fit_probe(df.filter("y = 1"), "x", "y", "sgd")

    def always(train, vector, label):
        names = sorted(r[0] for r in train.select(F.col(label).cast("string")).distinct().collect())
        return (lambda t: t.withColumn("predicted", F.lit(names[0]))), names

    assert P.evaluate_probe(df, df, "x", "y", always)["balanced_accuracy"] == pytest.approx(1 / 3)
    P.register_probe("first_class", always)
    try:
        assert P.evaluate_probe(df, df, "x", "y", "first_class")["balanced_accuracy"] == pytest.approx(1 / 3)
        with pytest.raises(ValueError, match="known already"):
            P.register_probe("sgd", always)
    finally:
        del P.PROBES["first_class"]
    odd = df.unionByName(spark.createDataFrame([(900, 1, None, [0.0] * 4), (901, 1, 2, None)], df.schema))
    predict, _ = P.fit_probe(odd.filter("y IS NOT NULL"), "x", "y", "sgd")
    assert [r.predicted is None for r in predict(odd).filter("key >= 900").orderBy("key").collect()] == [False, True]


def concept_tables(spark):
    f = Q.concept_features(spark, SF)
    return f, Q.concept_stain(f)


STAGES = [{"method": "soft", "lambdas": [1.0, 50.0], "sources": {"scanner.mean": 1.0, "stain.target": 0.5}}, {"method": "leace", "concept": "domain", "tols": [0.01]}]


@pytest.mark.parametrize("cap", [None, 40])
def test_grid_against_one_fold_at_a_time(spark, cap):
    f, stain = concept_tables(spark)
    scanner = {"mean": {"mode": "group_to_mean", "max_deltas": cap}}
    options = {"target": {"mode": "original_to_target", "max_deltas": cap}}
    made = concepts.run_concept_grid(f, ROLES, STAGES, scanner=scanner, stain=stain, stain_options=options, concepts=["domain"], probe=None, folds=[1, 3])
    rows = with_folds(f, "grp", 5)
    chains = {(r.fold, r.path): r for r in made["chains"].collect()}
    deltas = {(r.fold, r.path, r.source): r for r in made["deltas"].collect()}
    assert sorted(chains) == [(fold, path) for fold in (1, 3) for path in ("0/0", "1/0")] and len(deltas) == 8
    for fold in (1, 3):
        tables = delta_sources(rows, ROLES, scanner, stain, options, fold)
        train, test = train_rows(rows, fold), rows_inside(rows, fold)
        state = fold_state(train, ROLES, {}, ["domain"], {name: d for (name, split), d in tables.items() if split == "train"})
        for k in range(2):
            first = fit_stage(expand_stage(STAGES[0])[k], state)
            second = fit_stage(expand_stage(STAGES[1])[0], state.after(first))
            whole = compose([first, second])
            x = np.stack(test.select("x").toPandas()["x"])
            row = chains[fold, f"{k}/0"]
            assert row.mean_l2_change == pytest.approx(np.linalg.norm(whole(x) - x, axis=1).mean())
            assert row.projected_trace == pytest.approx(np.trace(whole.of_moments(state.x).m2) / (state.x.n - 1))
            assert row.n_test == len(x) and row.n_train == state.x.n
            for name in ("scanner.mean", "stain.target"):
                m = collect_moments(tables[name, "test"], "delta")["default"]
                got = deltas[fold, f"{k}/0", name]
                assert got.n_delta == m.n and got.residual_ratio == pytest.approx(residual_from_moments(m, whole)["residual_ratio"])
    stages = made["stages"].collect()
    assert len(stages) == 8 and all(r.mean_l2_change is None for r in stages if r.stage_index == 0)
    assert {r.kind for r in made["moments"].collect()} >= {"A", "B", "source_raw", "A_after", "B_after"}


def test_class_means_give_the_cross_covariance(spark):
    f, _ = concept_tables(spark)
    rows = with_folds(f, "grp", 5)
    sums = concepts.class_sums(rows, "x", "domain")
    train = train_rows(rows, 2)
    want = label_moments(train, "x", "domain")
    got = concepts._cross(collect_moments(train, "x")["default"], sums, 2)
    assert got.classes == want.classes and np.allclose(got.cross, want.cross)


def test_probes_of_both_concepts(spark):
    f, stain = concept_tables(spark)
    tables = run_experiment("sequential_delta_grid", f, ROLES, {"stages": STAGES[1:], "scanner": {}, "stain": stain, "concepts": ["domain"], "n_splits": 3, "max_probe_examples": 200})
    rows = tables["chains"].collect()
    assert len(rows) == 3 and tables["deltas"].count() == 0 and tables["moments"].count() == 0
    for r in rows:
        assert r.raw_scanner_score > 0.7 > r.projected_scanner_score
        assert abs(r.raw_stain_score - r.projected_stain_score) < 0.25 and r.stain_chance == 0.25
        assert r.n_stain_train == 200 and r.n_stain_test <= 200 and r.n_scanner_test == r.n_test
    whole = concepts._stain_probe_table(stain, with_folds(f, "grp", 3), ROLES, [0], "target_id", None, True, 0)
    assert whole.filter("split IS NOT NULL").isEmpty() and whole.count() == stain.count()


def test_adversarial_rounds_against_one_task(spark):
    """The loop over shards gives what the same loop over one array gives, whatever the partitions."""
    df, x, y = labelled(spark, 300, 5, 4)
    centred = x - x.mean(0)
    centred /= x.std() if abs(x.mean()) < 1e-12 else np.sqrt((centred**2).mean())
    removal, weights = fantope(np.random.default_rng(0).standard_normal((5, 5)) * 0.01, 2), np.zeros((5, 3))
    for _ in range(40):
        a, b = minimax_sums(centred, y, weights, removal)
        weights, removal = weights - a / 300, fantope(removal - (b + b.T) / 600, 2)
    u = np.linalg.eigh(removal)[1][:, -2:]
    for parts in (1, 5):
        got = rlace_eraser(df.repartition(parts), "x", "y", rank=2, rounds=40, keep_every=40)
        assert np.allclose(got.left @ got.right, u @ u.T, atol=1e-6) and np.allclose(got.bias, x.mean(0))
    slow = np.zeros((5, 3))
    for row, own in zip(centred, y, strict=True):
        z = row - row @ removal
        p = np.exp(z @ weights) / np.exp(z @ weights).sum()
        slow += np.outer(z, p - np.eye(3)[own])
    assert np.allclose(minimax_sums(centred, y, weights, removal)[0], slow)
    with pytest.raises(ValueError, match="two classes"):
        rlace_eraser(df.filter("y = 1"), "x", "y")


def test_a_worker_is_handed_one_shard_at_a_time(spark):
    def most(batches):
        yield pd.DataFrame({"state": [np.array([max(map(len, batches))], float).tobytes()]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert sgd._summed(spark.range(6).coalesce(1).mapInPandas(most, "state binary"), 1, 1)[0] == 1
    assert spark.conf.get(key) == before


def test_rows_under_many_views_are_held_in_small_parts(monkeypatch):
    held, seen = [], sgd._seen
    monkeypatch.setattr(sgd, "_seen", lambda *a: held.append(seen(*a)) or held[-1])
    x, y = np.random.default_rng(0).standard_normal((4096, 64)), np.arange(4096) % 3
    sgd.local_epoch(x, y, np.stack([np.eye(64)] * 20), np.zeros((20, 64)), np.zeros((20, 3, 65)), np.ones((20, 3)), 0.01, 1e-4)
    assert sum(z.shape[1] for z in held) == 4096 and max(z.nbytes for z in held) <= 9 << 20


def test_an_epoch_whose_losses_do_not_count_makes_the_same_weights():
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((130, 4)), rng.integers(0, 3, 130).astype(np.int32)
    made = []
    for judged in (True, False):
        weights = np.zeros((2, 3, 5))
        loss = sgd.local_epoch(x, y, np.stack([np.eye(4), np.diag([1.0, 0, 2, 1])]), np.zeros((2, 4)), weights, np.ones((2, 3)), 0.3, 1e-3, judged)
        made.append((weights, loss))
    assert np.array_equal(made[0][0], made[1][0]) and (made[0][1] > 0).all() and not made[1][1].any()
