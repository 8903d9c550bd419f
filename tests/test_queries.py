import pytest

from eigenloom import queries

from .checks import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_class_recalls_cover_every_row(spark):
    from eigenloom.operators import probe, splits

    got = {r["class"]: r for r in queries.queries()["class_recalls"](spark, SF).collect()}
    rows = splits.with_folds(queries.features(spark, SF), "grp", 3).cache()
    seen = []
    for fold in range(3):
        predict, _ = probe.fit_probe(rows.filter(f"fold <> {fold}"), "x", "domain")
        seen += [(r.vec_id, r.domain, r.predicted) for r in predict(rows.filter(f"fold = {fold}")).collect()]
    assert len({k for k, _, _ in seen}) == len(seen) == rows.count() == sum(r.n for r in got.values())
    for c, r in got.items():
        hits = [p == c for _, d, p in seen if d == c]
        assert (r.n, r.n_predicted) == (len(hits), sum(p == c for *_, p in seen)) and abs(r.recall - sum(hits) / len(hits)) < 1e-9


def test_grids_and_stains_run_whole(spark, monkeypatch):
    import inspect

    def calls(owner, name, query):
        real, seen = getattr(owner, name), []
        monkeypatch.setattr(owner, name, lambda *a, **k: seen.append((a, k)) or spark.range(1).selectExpr("'d' AS domain", "id AS n", "array(array(0d, 0d, 0d), array(0d, 0d, 0d)) AS matrix"))
        queries.queries()[query](spark, SF)
        monkeypatch.undo()
        bound = inspect.signature(real).bind(*seen[0][0], **seen[0][1])
        bound.apply_defaults()
        return bound.arguments

    for owner, name, query in ((queries.grid, "run_grid", "sequential_delta_grid"), (queries.grid, "run_grid", "chained_leace_grid"), (queries.experiments, "delta_pca", "paired_delta_pca")):
        used = calls(owner, name, query)
        assert (used["n_splits"], used["folds"]) == (5, None)
    assert calls(queries.I, "sparse_stain_matrices", "sparse_stain_estimation")["rounds"] == 30
