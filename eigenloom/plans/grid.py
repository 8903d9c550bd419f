"""Grids of eraser chains over folds.

Rows are read once a fold for the moments of features and of every delta
source. A stage changes them algebraically (mean' = b + P(mean - b), M2' =
P M2 P'), so a chain of any length is fitted without reading rows again, and
chains with a common beginning share it. A leaf composes its chain into one map,
which goes over the rows once for the probe.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.operators import deltas as D
from eigenloom.operators.erasers import LinearMap, apply_map, hard_eraser, leace_eraser, orth_eraser, pca_eraser, soft_eraser, soft_family
from eigenloom.operators.metrics import feature_change, joint_diagnostics, residual_from_moments
from eigenloom.operators.moments import CrossMoments, Moments, SourceSpec, collect_moments, label_moments
from eigenloom.operators.probe import evaluate_probe
from eigenloom.operators.splits import test_rows, train_rows, with_folds
from eigenloom.roles import Roles
from eigenloom.sources.artifacts import rows_frame

PAIRED = {"pca": pca_eraser, "hard": hard_eraser, "soft": soft_eraser}
CONCEPT = {"leace": leace_eraser, "orth": orth_eraser}
_PLURAL = {"ranks": "rank", "lambdas": "lam", "tols": "tol"}


@dataclass(frozen=True)
class Stage:
    """One eraser: its method, numbers, and the delta sources (with weights) or concept that it is fitted on."""

    method: str
    options: dict = field(default_factory=dict)
    sources: dict[str, float] | None = None
    concept: str | None = None

    @property
    def name(self) -> str:
        shown = "_".join(f"{k}{'full' if v is None else format(v, 'g') if isinstance(v, float) else v}" for k, v in sorted(self.options.items()))
        return f"{self.method}_{shown}" if shown else self.method


def expand_stage(config: dict) -> list[Stage]:
    """The product of a stage's lists of options; ranks once each, None first, then by size.

    ``{"method": "soft", "lambdas": [1, 10], "ranks": [None, 2], "sources": {"scanner": 1.0}}``
    """
    config = dict(config)
    method = config.pop("method")
    if method not in PAIRED | CONCEPT:
        raise ValueError(f"method {method!r}")
    sources, concept = config.pop("sources", None), config.pop("concept", None)
    axes = {}
    for key, value in config.items():
        values = value if isinstance(value, list) else [value]
        axes[_PLURAL.get(key, key)] = sorted(set(values), key=lambda v: (v is not None, v)) if key == "ranks" else list(dict.fromkeys(values))
    return [Stage(method, dict(zip(axes, chosen, strict=True)), sources, concept) for chosen in itertools.product(*axes.values())]


@dataclass
class State:
    """Moments of a fold after a prefix of stages."""

    x: Moments
    sources: dict[str, Moments]
    concepts: dict[str, CrossMoments]

    def after(self, m: LinearMap) -> State:
        p = m.dense()
        concepts = {k: CrossMoments(m.of_moments(c.x), c.classes, p @ c.cross) for k, c in self.concepts.items()}
        return State(m.of_moments(self.x), {k: m.of_moments(s, affine=False) for k, s in self.sources.items()}, concepts)


def specs_of(stage: Stage, state: State) -> list[SourceSpec]:
    return [SourceSpec(k, w) for k, w in (stage.sources or dict.fromkeys(sorted(state.sources), 1.0)).items()]


def fit_stage(stage: Stage, state: State, families: dict | None = None) -> LinearMap:
    """A stage's map from moments; full-rank soft stages of a prefix share one eigendecomposition."""
    if stage.method in CONCEPT:
        if stage.concept not in state.concepts:
            raise ValueError(f"concept {stage.concept!r} has no moments")
        return CONCEPT[stage.method](state.concepts[stage.concept], **stage.options)
    specs = specs_of(stage, state)
    options = dict(stage.options)
    if stage.method == "soft" and options.get("rank") is None and families is not None:
        lam = options.pop("lam")
        options.pop("rank", None)
        key = (tuple((s.name, s.weight) for s in specs), tuple(sorted(options.items())))
        if key not in families:
            families[key] = soft_family(state.x, state.sources, specs=specs, **options)[0]
        return families[key](lam)
    return PAIRED[stage.method](state.x, state.sources, specs=specs, **options)


def fold_state(train: DataFrame, roles: Roles, delta_options: dict[str, dict], concepts: list[str] = (), extra: dict[str, DataFrame] | None = None) -> State:
    """Moments of training rows, their delta sources and concepts: one pass each."""
    x = collect_moments(train, roles.vector)["default"]
    tables = {name: D.domain_deltas(train, roles, **options, validate=False) for name, options in delta_options.items()} | (extra or {})
    together = None
    for name, table in tables.items():
        named = table.select(F.lit(name).alias("source"), "delta")
        together = named if together is None else together.unionByName(named)
    return State(x, collect_moments(together, "delta", "source") if together is not None else {}, {c: label_moments(train, roles.vector, c) for c in concepts})


def apply_chain(df: DataFrame, vector: str, chain: list[LinearMap], output: str | None = None) -> DataFrame:
    return apply_map(df, vector, chain, output) if chain else df.withColumn(output or vector, F.col(vector))


def evaluate_leaf(train: DataFrame, test: DataFrame, roles: Roles, chain: list[LinearMap], raw: dict, test_state: State | None, label: str, probe: str = "logistic") -> dict:
    """Probe, change and residual columns of a chain on a fold."""
    mapped = apply_chain(test, roles.vector, chain, "_mapped")
    change = feature_change(mapped, roles.vector, "_mapped").first().asDict()
    after = evaluate_probe(apply_chain(train, roles.vector, chain), apply_chain(test, roles.vector, chain), roles.vector, label, probe)
    gap = raw["balanced_accuracy"] - raw["chance"]
    out = {
        "raw_score": raw["balanced_accuracy"],
        "projected_score": after["balanced_accuracy"],
        "chance": raw["chance"],
        "probe_excess_ratio": (after["balanced_accuracy"] - raw["chance"]) / gap if abs(gap) > 1e-12 else None,
        "mean_relative_change": change["mean_relative_change"],
        "ratio_of_mean_norms": change["ratio_of_mean_norms"],
    }
    if test_state is not None:
        whole = LinearMap(matrix=np.linalg.multi_dot([np.eye(len(test_state.x.mean)), *[m.dense() for m in reversed(chain)], np.eye(len(test_state.x.mean))])) if chain else LinearMap(matrix=np.eye(len(test_state.x.mean)))
        for name, m in test_state.sources.items():
            out |= {f"residual_ratio_{name}": residual_from_moments(m, whole)["residual_ratio"]}
    return out


def run_grid(features: DataFrame, roles: Roles, stages: list[dict], delta_options: dict[str, dict], *, label: str | None = None, n_splits: int = 5, folds: list[int] | None = None, probe: str = "logistic", concepts: list[str] = (), evaluate_intermediate: bool = False, fit_without: str | None = None) -> DataFrame:
    """A row for every fold and chain: one option of each stage, in order.

    One stage with many options is a plain grid of erasers; several are
    sequential chains. ``fit_without`` leaves a domain out of fitting, not of
    evaluation.
    """
    label = label or roles.domain
    rows_in = with_folds(features, roles.group, n_splits).cache()
    expanded = [expand_stage(s) for s in stages]
    out: list[dict] = []
    for fold in folds if folds is not None else range(n_splits):
        train, test = train_rows(rows_in, fold), test_rows(rows_in, fold)
        fit_on = train if fit_without is None else train_rows(rows_in, fold, fit_without=(roles.domain, fit_without))
        start = fold_state(fit_on, roles, delta_options, list(concepts))
        test_state = fold_state(test, roles, delta_options)
        raw = evaluate_probe(train, test, roles.vector, label, probe)

        def visit(depth: int, state: State, chain: list[LinearMap], names: list[str]) -> None:
            if depth == len(expanded) or (evaluate_intermediate and chain):
                out.append({"fold": fold, "combo": "|".join(names), "depth": depth, "methods": [m.method for m in chain], "ranks": [m.rank for m in chain]} | evaluate_leaf(train, test, roles, chain, raw, test_state, label, probe))
            if depth == len(expanded):
                return
            families: dict = {}
            for option in expanded[depth]:
                m = fit_stage(option, state, families)
                visit(depth + 1, state.after(m), [*chain, m], [*names, option.name])

        visit(0, start, [], [])
    rows_in.unpersist()
    return rows_frame(features.sparkSession, out)


def fit_eraser(features: DataFrame, roles: Roles, stage: dict, delta_options: dict) -> LinearMap:
    """One eraser on all rows and one delta configuration."""
    return fit_chain(features, roles, [stage], {"default": delta_options})[0][0]


def fit_leace(features: DataFrame, vector: str, concept: str, *, center_by: list[str] | None = None, leave_out: tuple[str, str] | None = None, index: bool = False, **options) -> LinearMap:
    """LEACE of a column on all rows, on rows centred by groups or without a value of a column if asked.

    ``index`` takes the concept as one number in place of one-hot classes.
    """
    rows = features if leave_out is None else features.filter(F.col(leave_out[0]) != leave_out[1])
    rows = rows if center_by is None else D.centre_by(rows, center_by, vector)
    if not index:
        return leace_eraser(label_moments(rows, vector, concept), **options)
    both = collect_moments(rows.withColumn("_both", F.concat(F.array(F.col(concept).cast("double")), F.col(vector).cast("array<double>"))), "_both")["default"]
    x = Moments(both.n, both.mean[1:], both.m2[1:, 1:])
    return leace_eraser(CrossMoments(x, ["index"], both.m2[1:, :1] / (both.n - 1)), **options)


def fit_chain(features: DataFrame, roles: Roles, stages: list[dict], delta_options: dict[str, dict], *, concepts: list[str] = (), extra: dict[str, DataFrame] | None = None, diagnostics: bool = False) -> tuple[list[LinearMap], list[dict]]:
    """A selected chain on all rows: its maps, and moment diagnostics of each stage.

    Lists of options are an error here: a chain has one value of each.
    """
    state = fold_state(features, roles, delta_options, list(concepts), extra)
    chain, report = [], []
    for k, config in enumerate(stages):
        options = expand_stage(config)
        if len(options) != 1 or any(key in config for key in _PLURAL):
            raise ValueError(f"stage {k} names several values; a chain takes one of each")
        m = fit_stage(options[0], state)
        if diagnostics and options[0].method in PAIRED:
            report += [{"stage": k} | row for row in joint_diagnostics(state.x, state.sources, specs_of(options[0], state), m)]
        chain.append(m)
        state = state.after(m)
    return chain, report
