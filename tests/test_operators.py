import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenloom.functions import names
from eigenloom.functions import vectors as V
from eigenloom.operators import augment
from eigenloom.operators import deltas as D
from eigenloom.operators import erasers as E
from eigenloom.operators import images as I
from eigenloom.operators import metrics as M
from eigenloom.operators import moments as Mo
from eigenloom.operators import probe as P
from eigenloom.operators import splits as K
from eigenloom.operators import stain as S
from eigenloom.operators import summary as A
from eigenloom.plans import experiments, grid
from eigenloom.roles import Roles, column_or_default, require_columns
from eigenloom.session import new_table_path
from eigenloom.sources import artifacts, config, tables
from eigenloom.streaming.moments import MomentStream

ROLES = Roles(domain="d", group="g", pair=None, key="id", vector="x")


@pytest.fixture(scope="module")
def small(spark):
    rows = [(0, "A", "g", [1.0, 0.0]), (1, "A", "g", [3.0, 0.0]), (2, "B", "g", [0.0, 2.0]), (3, "C", "g", [4.0, 4.0])]
    return spark.createDataFrame(rows, "id long, d string, g string, x array<float>")


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(1)
    rows = [(k, f"d{k % 3}", f"g{k // 12}", "ab"[k % 2], (rng.standard_normal(6) + 3 * np.eye(6)[k % 3] + 2 * np.eye(6)[3 + k % 2]).tolist()) for k in range(240)]
    return spark.createDataFrame(rows, "id long, d string, g string, c string, x array<double>").cache()


def test_golden_deltas(small):
    got = {r.domain_a: r.delta for r in D.domain_deltas(small, ROLES).collect()}
    assert got == {"A": [0, -2], "B": [-2, 0], "C": [2, 2]}
    got = {(r.domain_a, r.domain_b): r.delta for r in D.domain_deltas(small, ROLES, "group_pairwise").collect()}
    assert got == {("A", "B"): [-2, 2], ("A", "C"): [2, 4], ("B", "C"): [4, 2]}
    both = D.domain_deltas(small, ROLES, "group_pairwise", sign_mode="both")
    assert both.count() == 6 and np.allclose(Mo.collect_moments(both, "delta")["default"].mean, 0)


def test_delta_errors_and_caps(small):
    for options in ({"mode": "nothing"}, {"mode": "pair_col_to_mean"}, {"sign_mode": "none"}):
        with pytest.raises(ValueError):
            D.domain_deltas(small, ROLES, **options)
    with pytest.raises(ValueError):
        D.domain_deltas(small.filter("d = 'A'"), ROLES)
    with pytest.raises(ValueError):
        require_columns(small, ["nope"])
    assert D.domain_deltas(small, ROLES, max_deltas=2).count() == 2
    assert small.select(column_or_default(small, "nope", 7)).first()[0] == 7


def test_proxies_and_alignment(spark, small):
    proxies = spark.createDataFrame([(k, p, [float(k + j), float(j * k)]) for k in range(4) for j, p in enumerate("pqr")], "id long, proxy string, z array<double>")
    for mode in ("per_patch_centered", "first_target_reference"):
        table = D.proxy_deltas(proxies, "id", "proxy", "z", mode)
        assert table.count() == 12 and np.allclose(Mo.collect_moments(table, "delta")["default"].mean, 0)
    moved = small.withColumn("x", V.scale("x", 2.0))
    assert {r.id: r.delta for r in D.aligned_deltas(moved, small, "id", "x").collect()}[3] == [4, 4]


def test_augmentation_deltas(spark):
    df = spark.createDataFrame([(k, [10 * k + v for v in range(12)], 2, 2) for k in range(3)], "id long, pixels array<int>, height int, width int")
    encode = lambda batch: batch[:, :2] * 1.0
    brighter, darker = I.augmentation("brightness", by=5), I.augmentation("brightness", by=50)
    got = D.augmentation_deltas(df, encode, [brighter, darker], key="id").collect()
    assert {(r.draw, tuple(r.delta)) for r in got} == {(0, (5.0, 5.0)), (1, (50.0, 50.0))} and len(got) == 6
    got = D.augmentation_deltas(df, encode, [brighter, darker], key="id", mode="augmented_to_augmented").collect()
    assert {tuple(r.delta) for r in got} == {(45.0, 45.0)}


def test_moments_of_rows(many):
    x = np.array([r.x for r in many.collect()])
    for parts in (1, 7):
        m = Mo.collect_moments(many.repartition(parts), "x")["default"]
        assert m.n == len(x) and np.allclose(m.mean, x.mean(0)) and np.allclose(m.covariance(), np.cov(x.T))
    by = Mo.collect_moments(many, "x", "d")
    assert set(by) == {"d0", "d1", "d2"} and sum(m.n for m in by.values()) == len(x)
    with pytest.raises(ValueError):
        Mo.label_moments(many, "x", "d", ["d0", "d1"])


def test_maps_over_rows(many):
    m = E.LinearMap(matrix=np.random.default_rng(0).standard_normal((6, 6)), bias=np.arange(6.0))
    x = {r.id: np.array(r.x) for r in many.collect()}
    for df in (E.apply_map(many, "x", m), E.apply_map_native(many, "x", m)):
        assert all(np.allclose(r.x, m(x[r.id])) for r in df.collect())
    rows = E.apply_map(many.withColumn("x", F.when(F.col("id") > 0, F.col("x"))), "x", m, affine=False).orderBy("id").collect()
    assert rows[0].x is None and np.allclose(rows[1].x, m.dense() @ x[1])
    full = np.linalg.qr(np.random.default_rng(2).standard_normal((6, 6)))[0]
    assert len(E.head_projection(many, "x", full, 2, mode="reduced").first().x) == 4
    assert np.isclose(np.linalg.norm(E.head_projection(many, "x", full, 2, normalise=True).first().x), 1, atol=1e-6)
    r = E.rlace_eraser(many, "x", "c", rank=1, rounds=60, keep_every=20)
    p = r.dense()
    assert np.allclose(p @ p, p) and r.rank == 1
    scores = P.evaluate_probe(E.apply_map(many, "x", r), E.apply_map(many, "x", r), "x", "c")
    assert scores["accuracy"] < P.evaluate_probe(many, many, "x", "c")["accuracy"]


def test_folds_and_samples(many):
    folds = K.with_folds(many, "g", 4)
    assert folds.count() == 240
    assert folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert [r["count"] for r in folds.groupBy("fold").count().collect()] == [60] * 4
    with pytest.raises(ValueError):
        K.group_folds(many.filter("g = 'g0'"), "g")
    assert {r.d for r in K.train_rows(folds, 0, fit_without=("d", "d1")).collect()} == {"d0", "d2"}
    assert K.sample_rows(many.repartition(9), 7, ["id"], 1).collect() == K.sample_rows(many, 7, ["id"], 1).collect()
    assert K.balanced_sample(many, "c", 31, ["id"]).count() == 31
    assert K.select_domains(many, "d", None).count() == 240 and K.select_domains(many, "d", ["d0"]).count() == 80
    for bad in ([], ["d0", "d0"], ["zz"]):
        with pytest.raises(ValueError):
            K.select_domains(many, "d", bad)
    twice = many.select("id").limit(3).unionByName(many.select("id").limit(3))
    assert K.rows_by_index(many, "id", twice).count() == 6
    with pytest.raises(IndexError):
        K.rows_by_index(many, "id", many.select((F.col("id") + 1000).alias("id")))


def test_probe_and_recalls(many):
    folds = K.with_folds(many, "g", 4)
    for probe in P.PROBES:
        got = P.evaluate_probe(K.train_rows(folds, 0), K.test_rows(folds, 0), "x", "d", probe)
        assert got["balanced_accuracy"] > 0.8 and np.isclose(got["chance"], 1 / 3)
    predict, _ = P.fit_probe(many, "x", "d")
    assert sum(r.n for r in P.class_recalls(predict(many), "d").collect()) == 240
    with pytest.raises(ValueError):
        P.evaluate_probe(many.filter("d <> 'd0'"), many, "x", "d")


def test_stain_tables(spark, many):
    keys = S.stain_keys(many.select("id", "d", "g", "x"), ["t0", "t1", "t2"], key="id", slide="g", domain="d")
    assert keys.count() == 720
    matrices = spark.createDataFrame([(f"g{g}", f"d{d}", [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]) for g in range(20) for d in range(3)], "slide_id string, scanner_id string, matrix array<array<double>>")
    assert S.with_matrices(many, matrices, "g", "d").count() == 240
    with pytest.raises(KeyError):
        S.with_matrices(many, matrices.filter("slide_id <> 'g3'"), "g", "d")
    short = S.missing_matrices(matrices.filter("slide_id <> 'g3' OR scanner_id <> 'd1'"), matrices, matrices)
    assert [tuple(r) for r in short.collect()] == [("g3", "d1")]
    z = keys.withColumn("z", V.scale("source_x", 1 + F.col("target_index").cast("double")))
    capped = S.stain_deltas(z, None, "target_pairwise", max_deltas=10, n_targets=3)
    assert capped.count() == 10
    folds = K.with_folds(many, "g", 4)
    sources = S.delta_sources(folds, ROLES, {"a": {"mode": "group_to_mean"}}, z, {"b": {"mode": "target_to_mean"}}, fold=1)
    assert set(sources) == {("scanner.a", "train"), ("scanner.a", "test"), ("stain.b", "train"), ("stain.b", "test")}
    assert sources["stain.b", "test"].count() == 180
    assert S.stain_probe_rows(z, folds.filter("fold = 0"), "id", max_examples=20).count() == 20
    assert S.stain_probe_rows(z.filter("target_index = 0"), folds, "id") is None


def test_summaries(spark):
    scores = spark.createDataFrame([(f, r, 0.9, 0.5 + 0.1 * f) for f in range(3) for r in (1, 2)] + [(0, 4, 0.9, float("nan"))], "fold int, rank int, raw_score double, projected_score double")
    by = {r["rank"]: r for r in A.probe_by_rank(scores).collect()}
    assert np.isclose(by[1].projected_score_std, 0.1) and by[4].projected_score_mean is None and by[4].raw_score_std is None
    assert [r["rank"] for r in A.fold_gaps(scores, ["rank"]).collect()] == [4]
    assert A.within_budget(spark.createDataFrame([(0.3, 0.5, 0.45), (0.5, 0.5, 0.5)], "c double, s double, k double"), "c", "s", "k").count() == 1
    pairs = spark.createDataFrame([("t", 2.0, 1.0), ("t", 4.0, 1.0), ("u", 1.0, 1.0)], "target string, mae_raw double, mae_new double")
    assert A.image_pair_summary(pairs, "target", ["mae"]).first().mae_improvement == 2.0


def test_folds_against_dealing_one_by_one(spark):
    rng = np.random.default_rng(2)
    for sizes in ([7] * 23, [100, 3, 3, 3, 2, 2] + [1] * 40, rng.integers(1, 9, 60).tolist(), [5, 4]):
        loads, want = [0] * min(4, len(sizes)), []
        for size in sorted(sizes, reverse=True):
            want.append(loads.index(min(loads)))
            loads[want[-1]] += size
        got, now = [], np.zeros(min(4, len(sizes)), np.int64)
        for size in sorted(set(sizes), reverse=True):
            n = sizes.count(size)
            got += K.lightest_fold(np.arange(n), np.full(n, size), np.tile(now, (n, 1))).tolist()
            now = K.loads_after(n, size, now)
        assert got == want and now.tolist() == loads
    rows = [(f"g{k}", j) for k in range(40) for j in range(1 + k % 3)] + [(None, 0)]
    loads, want = [0] * 3, {}
    for k in sorted(range(40), key=lambda k: (1 + k % 3, f"g{k}"), reverse=True):
        want[f"g{k}"] = loads.index(min(loads))
        loads[want[f"g{k}"]] += 1 + k % 3
    folds = K.group_folds(spark.createDataFrame(rows, "g string, j int").repartition(5), "g", 3)
    assert {r.g: r.fold for r in folds.collect()} == want


def test_large_samples_are_those_first_by_hash(spark, monkeypatch):
    df = spark.range(3000)
    want = {r.id for r in K.sample_rows(df, 700, ["id"], 5).collect()}
    monkeypatch.setattr(K, "TOP_ROWS", 10)
    got = [r.id for r in K.sample_rows(df, 700, ["id"], 5).collect()]
    assert len(got) == 700 and set(got) == want
    assert K.sample_rows(df, 5000, ["id"], 5).count() == 3000


def test_augmentations(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (13, 21, 3)).astype(np.uint8)
    flat_grey, white = np.full((16, 16, 3), 100, np.uint8), np.full((8, 8, 3), 255, np.uint8)
    known = augment.specs()
    assert len(known) == 56 and known["blur_downup_lab_l_sigma_0.5_scale_0.9"].params == {"sigma": 0.5, "scale": 0.9}
    for name, spec in known.items():
        out = spec(p)
        assert out.shape == p.shape and out.dtype == np.uint8 and (out == spec(p)).all(), name
        if spec.family.startswith(("blur", "downup", "jpeg")):
            assert np.abs(spec(flat_grey).astype(int) - 100).max() <= 2, name
    for y, x in ((0, 0), (5, 7), (12, 20)):
        h, s, v = colorsys.rgb_to_hsv(*(p[y, x] / 255))
        want = colorsys.hsv_to_rgb((h + 8 / 180) % 1, min(1, s + 10 / 255), max(0, v - 5 / 255))
        assert np.abs(augment.shift_hsv(p, 8, 10, -5)[y, x] - 255 * np.array(want)).max() <= 0.51
    assert (augment.shift_hsv(p) == p).all() and np.abs(augment.jpeg(p, 100).astype(int) - p).max() <= 4
    assert [np.abs(known[f"jpeg_quality_{q}"](p).astype(int) - p).mean() for q in (95, 80, 60, 40)] == sorted(np.abs(known[f"jpeg_quality_{q}"](p).astype(int) - p).mean() for q in (95, 80, 60, 40))
    for preset in augment.PRESETS:
        one, other = (augment.build_augmentation("random", preset, seed=k) for k in (1, 2))
        assert (one(p) == one(p)).all() and any((one(q) != other(q)).any() for q in (p, p // 2, p // 3))
    jitter = augment.build_augmentation("stain", "stain")
    assert (augment.build_augmentation("stain", "stain", on_error="identity")(white) == white).all() and jitter(p // 2).shape == p.shape
    df = spark.createDataFrame([(1, p.ravel().tolist(), 13, 21), (2, white.ravel().tolist(), 8, 8), (3, None, 1, 1)], "id long, pixels array<int>, height int, width int")
    assert {r.id: r.result is None for r in I.map_pixels(df.filter("id < 3"), jitter).collect()} == {1: False, 2: True}
    made = {(r.id, r.augmentation): r.result for r in augment.augmented_images(df, ["gamma_85", "brightness_0.1"]).collect()}
    assert set(made) == {(i, n) for i in (1, 2) for n in ("gamma_85", "brightness_0.1")} and made[1, "gamma_85"] == known["gamma_85"](p).ravel().tolist()
    for backend, preset in (("random", "none"), ("nothing", "x"), ("deterministic", "blur")):
        with pytest.raises(ValueError):
            augment.build_augmentation(backend, preset)


def test_sparse_stains(spark):
    rng = np.random.default_rng(0)
    truth = np.array([[0.70, 0.65, 0.29], [0.30, 0.93, 0.21]])
    truth = truth / np.linalg.norm(truth, axis=1, keepdims=True)
    amounts = rng.gamma(1.0, 0.8, (2, 3000)) * (rng.random((2, 3000)) < 0.8)
    flat = I.compose_pixels(amounts, truth).ravel().tolist()
    df = spark.createDataFrame([("s", None, flat[:3000]), ("s", None, flat[3000:]), ("s", "b", [255] * 12)], "slide string, scanner string, pixels array<int>")
    got = I.sparse_stain_matrices(df, ["slide", "scanner"], rounds=12, penalty=0.05).collect()
    assert len(got) == 1 and got[0].scanner is None
    found = np.array(got[0].matrix)
    best = max(np.abs(np.sum(found * t, axis=1)).min() for t in (truth, truth[::-1]))
    assert np.allclose(np.linalg.norm(found, axis=1), 1) and best > 0.97


def test_images(spark):
    rng = np.random.default_rng(0)
    truth = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11]])
    truth = truth / np.linalg.norm(truth, axis=1, keepdims=True)
    amounts = rng.gamma(2.0, 0.5, (2, 4000)) + 0.2
    pixels = I.compose_pixels(amounts, truth).reshape(40, 100, 3)
    found = I.stain_matrix(pixels)
    assert np.abs(found - truth).max() < 0.12
    assert np.abs(I.restain(pixels, truth, truth).astype(int) - pixels.reshape(-1, 3)).mean() < 12
    assert I.normalise_stains(pixels, found, truth, np.array([1.97, 1.03])).shape == (4000, 3)
    colours = rng.integers(0, 256, (10, 10, 3)).astype(np.uint8)
    assert np.abs(I.from_lab(I.to_lab(colours)).astype(int) - colours.reshape(-1, 3)).max() <= 1
    lab = I.to_lab(I.reinhard(pixels, np.array([60.0, 5, 5]), np.array([8.0, 3, 3])))
    assert np.allclose(lab.mean(0), [60, 5, 5], atol=1.0)
    for name in I.AUGMENTATIONS:
        assert I.augmentation(name)(colours).shape == colours.shape
    flat = pixels.ravel().tolist()
    df = spark.createDataFrame([("s", "a", flat, 40, 100), ("s", "b", [255] * 12, 2, 2)], "slide string, scanner string, pixels array<int>, height int, width int")
    got = {r.scanner: r.result for r in I.map_pixels(df, I.stain_matrix).collect()}
    assert got["b"] is None and np.allclose(got["a"], found.ravel())
    pooled = I.pooled_stain_matrices(df, ["slide", "scanner"]).collect()
    assert len(pooled) == 1 and np.allclose(pooled[0].matrix, found, atol=1e-6)
    same = df.limit(1).withColumn("other", F.transform("pixels", lambda p: p + 3))
    assert M.image_error(same, "pixels", "other").first().mae == 3.0
    windows = I.sliding_windows(spark.createDataFrame([("i", 10, 7)], "image_id string, height int, width int"), 4, 3)
    assert {(r.top, r.left) for r in windows.collect()} == {(t, x) for t in (0, 3, 6) for x in (0, 3)}
    cells = windows.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    cells = cells.withColumn("value", (10 * (F.col("top") + F.col("dy")) + F.col("left") + F.col("dx")).cast("double"))
    for weighting in ("average", "hann"):
        out = I.stitch(cells, 4, weighting=weighting).collect()
        assert len(out) == 70 and all(np.isclose(r.value, 10 * r.y + r.x) for r in out)
    vectors = I.encode_images(df.limit(1), lambda batch: batch[:, :5] * 2.0)
    assert vectors.first().embedding == [2.0 * v for v in flat[:5]]


def test_names(spark):
    df = spark.createDataFrame([("a b//c__d_",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(names.safe_name("v")).collect()] == ["a_b_c_d", "unnamed", "unnamed"]
    assert names.selection_token(None) == "scanners-all" and names.selection_token(["b", "a"]).startswith("scanners-k2-")
    assert names.selection_token(["x"]) == "scanner-x"
    assert names.stage_name("soft", lam=10.0, rank=None) == "soft_lam10_rankfull"


def test_sources(spark, many, tmp_path):
    path = new_table_path(spark, "test-features")
    tables.write_features(many.withColumnRenamed("x", "embedding"), path)
    assert tables.read_features(spark, path).count() == 240
    np.savez(tmp_path / "f.npz", features=np.ones((3, 2), np.float32), tile=np.array([1, 2, 3]))
    npz = tables.import_npz(spark, str(tmp_path / "f.npz"))
    assert dict(npz.dtypes)["tile"] == "string" and npz.count() == 3
    (tmp_path / "m.csv").write_text("tile_id,scanner_id\nslide_1-sample_2-tile_0-S,7\n")
    meta = tables.read_metadata(spark, str(tmp_path / "m.csv")).first()
    assert (meta.scanner_id, meta.image_id, meta.slide_id) == ("7", "slide_1-sample_2", "slide_1")
    calls = []
    make = lambda: calls.append(1) or many.select("id")
    cache = new_table_path(spark, "test-cached")
    for _ in range(2):
        assert tables.cached(spark, cache, make, config={"a": [1, 2]}).count() == 240
    assert len(calls) == 1
    with pytest.raises(ValueError):
        tables.cached(spark, cache, make, config={"a": [2, 1]})
    for name in ("s1-p-t_0-GT450.jpg", "s1-p-t_1-AT2.jpg"):
        (tmp_path / name).write_bytes(b"x")
    images = tables.scan_images(spark, str(tmp_path))
    assert {(r.slide_id, r.scanner_id) for r in images.collect()} == {("s1", "GT450"), ("s1", "AT2")}
    assert tables.image_contents(images.drop("path"), images.drop("path"), str(tmp_path)).count() == 2
    chain = [E.LinearMap(matrix=np.diag([1.0, 2.0]), bias=np.ones(2)), E.LinearMap(left=np.eye(2)[:, :1], right=np.eye(2)[:1], method="pca")]
    artifacts.save_maps(spark, path, chain)
    loaded = artifacts.load_maps(spark, path)
    assert all(np.allclose(a.dense(), b.dense()) for a, b in zip(chain, loaded, strict=True)) and loaded[1].method == "pca"
    assert config.optional({"a": 1}, "a", float) == 1.0
    for error, bad in ((KeyError, "b"), (TypeError, "a")):
        with pytest.raises(error):
            config.required({"a": "x"}, bad, int)
    tables.write_results(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), path + "-csv")
    assert spark.read.csv(path + "-csv", header=True).first().b == "[1,2]"


def test_grids_and_chains(many):
    roles = Roles(domain="d", group="g", pair=None, key="id", vector="x")
    rows = grid.run_grid(many, roles, [{"method": "soft", "lambdas": [0.1, 1000.0]}], {"s": {}}, n_splits=2, folds=[0]).collect()
    weak, strong = sorted(rows, key=lambda r: len(r.combo))[0], sorted(rows, key=lambda r: len(r.combo))[-1]
    weak, strong = (r for r in sorted(rows, key=lambda r: -r.residual_ratio_s))
    assert strong.probe_excess_ratio < weak.probe_excess_ratio and strong.mean_relative_change > weak.mean_relative_change
    chain, report = grid.fit_chain(many, roles, [{"method": "pca", "rank": 2}, {"method": "leace", "concept": "c"}], {"s": {}}, concepts=["c"], diagnostics=True)
    assert [m.method for m in chain] == ["pca", "leace"] and report
    erased = E.apply_map(many, "x", chain)
    means = np.array([r.m for r in erased.groupBy("c").agg(V.mean_of("x").alias("m")).collect()])
    assert np.allclose(means[0], means[1], atol=0.05)
    assert grid.fit_eraser(many, roles, {"method": "pca", "rank": 2}, {}).rank == 2
    one = grid.fit_leace(many.withColumn("n", F.when(F.col("c") == "a", 0).otherwise(1)), "x", "n", index=True)
    assert np.allclose(one.dense(), grid.fit_leace(many, "x", "c").dense(), atol=1e-8)
    assert grid.fit_leace(many, "x", "c", center_by=["g"], leave_out=("d", "d1")).rank == 1
    with pytest.raises(ValueError):
        grid.fit_chain(many, roles, [{"method": "pca", "ranks": [1, 2]}], {"s": {}})
    out = experiments.crossfit_analysis(many, roles, experiments.leace_fit(roles), n_splits=2)
    score = out["scores"].agg(F.avg("raw_accuracy").alias("a"), F.avg("erased_accuracy").alias("b")).first()
    assert score.a > 0.8 and score.b < 0.6 and out["predictions"].count() == 240
    assert experiments.run_experiment("paired_delta_grid", many, roles, {}, dry_run=True) is None
    with pytest.raises(ValueError):
        experiments.run_experiment("nothing", many, roles, {})


def test_stream_of_vectors(spark, many, tmp_path):
    many.select("d", "x").repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("d string, x array<double>").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    keeper = MomentStream(spark, f"{tmp_path}/state", "x", "d")
    keeper.start(stream, f"{tmp_path}/checkpoint").awaitTermination(60)
    kept, want = keeper.moments(), Mo.collect_moments(many, "x", "d")
    assert set(kept) == set(want) and all(np.allclose(kept[k].m2, want[k].m2) for k in want)
    keeper.update(many.filter("id < 0"), 0)  # a batch that is run again replaces itself


def test_few_values_refuse_a_key(spark):
    from eigenloom.session import few_values

    assert sorted(few_values(spark.range(6).selectExpr("id % 3 AS d"), "d", 3)) == [0, 1, 2]
    with pytest.raises(ValueError, match="more than 3"):
        few_values(spark.range(6), "id", 3)
