"""The registered experiments, each a composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.operators import deltas as D
from eigenloom.operators.erasers import LinearMap, apply_map, leace_eraser
from eigenloom.operators.geometry import centroid_subspace, pca_of, subspace_overlap
from eigenloom.operators.moments import collect_moments, label_moments
from eigenloom.operators.probe import evaluate_probe, fit_probe
from eigenloom.operators.splits import test_rows, train_rows, with_folds
from eigenloom.operators.summary import displacement_summary
from eigenloom.operators.metrics import feature_change
from eigenloom.plans.concepts import run_concept_grid
from eigenloom.plans.grid import run_grid
from eigenloom.plans.variants import run_paired_grid
from eigenloom.roles import Roles
from eigenloom.session import few_values
from eigenloom.sources.artifacts import rows_frame


def delta_pca(features: DataFrame, roles: Roles, *, mode: str = "group_to_mean", ranks: list[int] = (1, 2, 4, 8), n_splits: int = 5, folds: list[int] | None = None, deltas: DataFrame | None = None, probe: str = "logistic") -> DataFrame:
    """Per fold and rank: probe before and after projecting the deltas' principal directions away, and their overlap with the domain centroids' span.

    ``deltas`` (key, delta) replaces domain deltas, for augmentations: those of training rows are used.
    """
    rows = with_folds(features, roles.group, n_splits).cache()
    out = []
    for fold in folds if folds is not None else range(n_splits):
        train, test = train_rows(rows, fold), test_rows(rows, fold)
        table = D.domain_deltas(train, roles, mode, validate=False) if deltas is None else deltas.join(train.select(roles.key), roles.key, "left_semi")
        space = pca_of(collect_moments(table, "delta")["default"], max(ranks))
        centroids = centroid_subspace(collect_moments(train, roles.vector, roles.domain))
        raw = evaluate_probe(train, test, roles.vector, roles.domain, probe)
        for rank in ranks:
            m = space.transform_map(rank)
            after = evaluate_probe(apply_map(train, roles.vector, m), apply_map(test, roles.vector, m), roles.vector, roles.domain, probe)
            change = feature_change(apply_map(test, roles.vector, m, "_mapped"), roles.vector, "_mapped").first()
            out.append({"fold": fold, "rank": rank, "raw_score": raw["balanced_accuracy"], "projected_score": after["balanced_accuracy"], "chance": raw["chance"], "explained": float(space.explained_variance_ratio[:rank].sum()), "mean_relative_change": change.mean_relative_change} | subspace_overlap(space.components[:rank], centroids))
    rows.unpersist()
    return rows_frame(features.sparkSession, out)


def crossfit(features: DataFrame, roles: Roles, fit, *, n_splits: int = 5, leave_out: str | None = None) -> DataFrame:
    """``features`` with ``fold`` and ``erased``: every row mapped by a map that ``fit(train)`` gave without its fold."""
    rows = with_folds(features, roles.group, n_splits)
    out = None
    for fold in range(n_splits):
        train = train_rows(rows, fold, fit_without=None if leave_out is None else (roles.domain, leave_out))
        part = apply_map(test_rows(rows, fold), roles.vector, fit(train), "erased")
        out = part if out is None else out.unionByName(part)
    return out


def leace_fit(roles: Roles, label: str | None = None, centre: list[str] | None = None, **options):
    """A ``fit`` for ``crossfit``: LEACE of a label, on rows centred by groups if asked."""

    def fit(train: DataFrame) -> LinearMap:
        rows = train if centre is None else D.centre_by(train, centre, roles.vector)
        return leace_eraser(label_moments(rows, roles.vector, label or roles.domain), **options)

    return fit


def proxy_pca_fit(proxies: DataFrame, roles: Roles, rank: int, *, proxy: str = "proxy", vector: str = "z", mode: str = "per_patch_centered"):
    """A ``fit`` for ``crossfit``: the principal directions of proxy deltas of training rows, around the mean of all proxies."""

    def fit(train: DataFrame) -> LinearMap:
        own = proxies.join(train.select(roles.key), roles.key, "left_semi")
        space = pca_of(collect_moments(D.proxy_deltas(own, roles.key, proxy, vector, mode), "delta")["default"], rank)
        return LinearMap(left=space.components.T, right=space.components, bias=collect_moments(own, vector)["default"].mean, method="proxy_pca")

    return fit


def crossfit_analysis(features: DataFrame, roles: Roles, fit, *, n_splits: int = 5, leave_out: str | None = None, probe: str = "logistic") -> dict[str, DataFrame]:
    """Out-of-fold erased rows, predictions, fold scores and displacement by domain pair."""
    erased = crossfit(features, roles, fit, n_splits=n_splits, leave_out=leave_out).cache()
    scores, predictions = [], None
    for fold in range(n_splits):
        own = {}
        for name, vector in (("raw", roles.vector), ("erased", "erased")):
            train, test = train_rows(erased, fold), test_rows(erased, fold)
            own |= {f"{name}_{k}": v for k, v in evaluate_probe(train, test, vector, roles.domain, probe).items()}
            predict, _ = fit_probe(train, vector, roles.domain, probe)
            part = predict(test).select(roles.key, F.col(roles.domain).alias("true"), F.col("predicted").alias(f"predicted_{name}"))
            joined = part if name == "raw" else joined.join(part.drop("true"), roles.key)
        predictions = joined if predictions is None else predictions.unionByName(joined)
        scores.append({"fold": fold} | own)
    raw = D.displacement_pairs(erased, roles)
    after = D.displacement_pairs(erased.withColumn(roles.vector, F.col("erased")), roles)
    return {"rows": erased, "predictions": predictions, "scores": rows_frame(features.sparkSession, scores), "displacement": displacement_summary(raw, after, [roles.group])}


def leave_one_domain_out(features: DataFrame, roles: Roles, fit, *, n_splits: int = 5, probe: str = "logistic") -> DataFrame:
    """``crossfit_analysis`` once for each domain left out of fitting: means and deviations of the scores."""
    domains = sorted(few_values(features.select(F.col(roles.domain).cast("string")), roles.domain))
    out = None
    for d in domains:
        scores = crossfit_analysis(features, roles, fit, n_splits=n_splits, leave_out=d, probe=probe)["scores"]
        row = scores.agg(F.avg("raw_balanced_accuracy").alias("raw_mean"), F.stddev_pop("raw_balanced_accuracy").alias("raw_std"), F.avg("erased_balanced_accuracy").alias("erased_mean"), F.stddev_pop("erased_balanced_accuracy").alias("erased_std"), F.max("raw_chance").alias("chance"))
        row = row.select(F.lit(f"loso_{d}").alias("run_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _grid(name):
    def run(features: DataFrame, roles: Roles, config: dict) -> DataFrame | dict[str, DataFrame]:
        if "erasers" in config:
            return run_paired_grid(features, roles, **config)
        if "scanner" in config or "stain" in config:
            return run_concept_grid(features, roles, **config)
        known = {"stages", "delta_options", "label", "n_splits", "folds", "probe", "concepts", "evaluate_intermediate", "fit_without"}
        if unknown := set(config) - known:
            raise ValueError(f"{name}: unknown keys {sorted(unknown)}")
        return run_grid(features, roles, **{"delta_options": {}} | config)

    return run


EXPERIMENTS = {
    "paired_scanner_delta_pca": lambda f, r, c: delta_pca(f, r, **c),
    "augmentation_delta_pca": lambda f, r, c: delta_pca(f, r, **c),
    "paired_delta_projection": _grid("paired_delta_projection"),
    "paired_delta_grid": _grid("paired_delta_grid"),
    "multi_delta_grid": _grid("multi_delta_grid"),
    "sequential_delta_grid": _grid("sequential_delta_grid"),
    "chained_leace_grid": _grid("chained_leace_grid"),
    "sequential_leace_grid": _grid("sequential_leace_grid"),
    "leace_scanner_erasure": lambda f, r, c: crossfit_analysis(f, r, leace_fit(r, **c))["scores"],
}


def run_experiment(kind: str, features: DataFrame, roles: Roles, config: dict, *, run_only_one_fold: bool = False, dry_run: bool = False) -> DataFrame | dict[str, DataFrame] | None:
    """Run a registered experiment on a feature table; a dry run only checks its name and configuration.

    A grid whose configuration names ``scanner`` or ``stain`` sources goes over both
    concepts and gives its four tables by name; one whose configuration names ``erasers``
    goes over the kinds of moments of single erasers and gives two.
    """
    if kind not in EXPERIMENTS:
        raise ValueError(f"experiment {kind!r}; one of {sorted(EXPERIMENTS)}")
    if dry_run:
        return None
    return EXPERIMENTS[kind](features, roles, config | ({"folds": [0]} if run_only_one_fold else {}))
