"""Grids of single erasers over kinds of moments: whitening, moment, shrinkage and normalisation as axes.

Every delta source is gathered once, for all folds. What an eraser is fitted from is a
pair (A, B) of a fold: A the covariance of features, B the moment of a source's deltas,
each of a kind that the axes choose. All erasers of a pair share its decompositions: one
simultaneous diagonalisation of A and B serves whitened erasers of every rank and
full-rank soft erasers of every lambda, one eigendecomposition of B the others, and one
singular value decomposition of I - P every rank of a lambda.

Erasers are judged in stacks (``STACK_BYTES`` of maps), all folds together: one pass for
the changes of rows, one for the deltas, one a round for the probes. Sources that are
capped, or grouped by what is not a fold's group, are built for each fold and split.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields, replace
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.functions import vectors as V
from eigenloom.operators import deltas as D
from eigenloom.operators import sgd
from eigenloom.operators.erasers import LinearMap
from eigenloom.operators.moments import Moments, SourceSpec, collect_moments, joint_moment, matched, symmetric, top_components, whitening
from eigenloom.operators.splits import with_folds
from eigenloom.operators.summary import mean_std
from eigenloom.plans.concepts import MEDIAN_ACCURACY, Node, excess, merged, norms_by_node, source_moments
from eigenloom.plans.grid import State
from eigenloom.roles import Roles
from eigenloom.session import few_values, join_checked, materialise, release

#: Bytes of dense maps that are judged together.
STACK_BYTES = 256 << 20
METHODS = ("pca", "soft")
_AXES = {"ranks": "rank", "lambdas": "lam"}
_SCORES = ["raw_score", "projected_score", "excess_ratio", "mean_relative_change", "residual_ratio", "mean_norm_ratio"]


@dataclass(frozen=True)
class Variant:
    """One eraser: the pair that it is fitted from, and its own numbers. ``whiten`` is of ``pca`` alone, ``lam`` of ``soft`` alone."""

    source: str
    method: str
    moment: str = "second_moment"
    shrink_a: bool = True
    shrink_b: bool = False
    normalization: str = "none"
    joint: str = "none"
    ridge: float = 1e-4
    tol: float = 1e-7
    affine: bool = True
    whiten: bool | None = None
    lam: float | None = None
    rank: int | None = None

    @property
    def pair(self) -> tuple:
        """What variants that share A and B have in common."""
        return (self.source, self.moment, self.shrink_a, self.shrink_b, self.normalization, self.joint, self.ridge, self.tol)


def expand_variants(sources: list[str], erasers: list[dict]) -> list[Variant]:
    """The product of sources and of every eraser's lists of options; the same variant once.

    ``{"method": "soft", "lambdas": [1, 10], "ranks": [None, 2], "moment": ["covariance", "second_moment"]}``
    """
    known, out = {f.name for f in fields(Variant)} - {"source"}, {}
    for config in erasers:
        axes = {_AXES.get(k, k): v if isinstance(v, list) else [v] for k, v in config.items()}
        if unknown := set(axes) - known:
            raise ValueError(f"unknown options {sorted(unknown)}")
        (method,) = axes.get("method", [None])
        if method not in METHODS:
            raise ValueError(f"method {method!r}; one of {METHODS}")
        if method == "soft" and ("whiten" in axes or "lam" not in axes):
            raise ValueError("soft erasers take lambdas, and no whitening")
        if method == "pca" and "lam" in axes:
            raise ValueError("pca erasers take no lambdas")
        axes = ({"whiten": [True]} if method == "pca" else {}) | axes
        for source, *chosen in itertools.product(sources, *axes.values()):
            out[Variant(source, **dict(zip(axes, chosen, strict=True)))] = None
    if not out:
        raise ValueError("no eraser is configured")
    return list(out)


class Pair:
    """A and B of a fold, and the decompositions that their erasers share, each made when first asked for."""

    def __init__(self, x: Moments, deltas: Moments, v: Variant):
        spec = SourceSpec("source", moment=v.moment, normalization=v.normalization, shrink=v.shrink_b)
        self.mean, self.ridge, self.tol = x.mean, v.ridge, v.tol
        self.a = x.covariance(v.shrink_a)
        self.b = matched(joint_moment({"source": deltas}, [spec]), self.a, v.joint)
        self.gaps: dict[float, tuple] = {}

    @cached_property
    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        return np.linalg.eigh(symmetric(self.b))

    @cached_property
    def together(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues and vectors of B in the whitened metric, and A's root and inverse root."""
        root, inverse = whitening(self.a, self.ridge, self.tol)
        return *np.linalg.eigh(symmetric(inverse @ self.b @ inverse)), root, inverse

    def softened(self, lam: float) -> np.ndarray:
        """I - P of the full-rank soft eraser."""
        values, u, root, inverse = self.together
        values = np.maximum(values, 0)
        return (root @ u * (lam * values / (1 + lam * values))) @ u.T @ inverse

    def eraser(self, v: Variant) -> LinearMap:
        bias = self.mean if v.affine else None
        if v.method == "soft":
            if v.rank is None:
                return LinearMap(matrix=np.eye(len(self.mean)) - self.softened(v.lam), bias=bias, method="soft")
            if v.lam not in self.gaps:
                self.gaps[v.lam] = np.linalg.svd(self.softened(v.lam))
            left, s, right = self.gaps[v.lam]
            k = min(v.rank, int((s > v.tol).sum()))
            return LinearMap(left=left[:, :k] * s[:k], right=right[:k], bias=bias, method="soft", eigenvalues=s[:k])
        if not v.whiten:
            values, u = top_components(*self.plain, v.rank, v.tol)
            return LinearMap(left=u, right=u.T, bias=bias, method="pca", eigenvalues=values)
        *spectrum, root, inverse = self.together
        values, u = top_components(*spectrum, v.rank, v.tol)
        return LinearMap(left=root @ u, right=u.T @ inverse, bias=bias, method="pca_whitened", eigenvalues=values)


def variant_deltas(rows: DataFrame, roles: Roles, sources: dict[str, dict], n_splits: int, seed: int = 0) -> DataFrame:
    """(source, fold, split, delta): deltas of a fold's own rows (no split), or made for a split of a fold.

    A source's options are those of ``domain_deltas`` and its own ``group`` and ``pair``
    columns; ``max_deltas`` caps its training deltas of a fold, ``max_test_deltas`` those of
    test, by samples with seeds ``seed + fold`` and ``seed + 10000 + fold``.
    """
    folds, parts = rows.select(roles.group, "fold").distinct(), []
    for name, options in sources.items():
        options = dict(options)
        own = replace(roles, group=options.pop("group", roles.group), pair=options.pop("pair", roles.pair))
        most = {"train": options.pop("max_deltas", None), "test": options.pop("max_test_deltas", None)}
        named = [F.lit(name).alias("source"), "fold"]
        if own.group == roles.group and most == {"train": None, "test": None}:
            made = D.domain_deltas(rows, own, **options, validate=False)
            parts.append(join_checked(made, folds, roles.group).select(*named, F.lit(None).cast("string").alias("split"), "delta"))
            continue
        for fold, (split, kept, at) in itertools.product(range(n_splits), (("train", "fold <> {}", 0), ("test", "fold = {}", 10_000))):
            made = D.domain_deltas(rows.filter(kept.format(fold)), own, **options, max_deltas=most[split], seed=seed + at + fold, validate=False)
            parts.append(made.withColumn("fold", F.lit(fold)).select(*named, F.lit(split).alias("split"), "delta"))
    return reduce(DataFrame.unionByName, parts)


def _stacks(fitted: list[tuple[int, int]], variants: list[Variant], d: int) -> Iterator[list[tuple[int, int]]]:
    """(fold, number of variant) in stacks whose maps fit ``STACK_BYTES``; erasers of one pair are next to each other."""
    order = sorted(fitted, key=lambda p: (p[0], str(variants[p[1]].pair), p[1]))
    size = max(1, STACK_BYTES // (8 * d * d))
    for at in range(0, len(order), size):
        yield order[at : at + size]


def _change(rows: DataFrame, nodes: list[Node], vector: str) -> dict[int, dict]:
    norms = norms_by_node(rows, nodes, vector, [], True)
    median = F.percentile_approx("change", 0.5, MEDIAN_ACCURACY)
    found = norms.groupBy("node").agg(F.count("*").alias("n_test"), F.avg("change").alias("mean_l2_change"), median.alias("median_l2_change"), F.avg("before").alias("mean_raw_norm"), F.avg(F.col("change") / (F.col("before") + V.EPS)).alias("mean_relative_change"))
    return {r.node: r.asDict() for r in found.collect()}


def _left(deltas: DataFrame, nodes: list[Node], sources: list[str]) -> dict[int, dict]:
    """What each eraser leaves of its own source's test deltas; a source's deltas go under its own erasers only."""
    out = {}
    for source in sorted(set(sources)):
        at = [k for k, s in enumerate(sources) if s == source]
        found = _norms_left(norms_by_node(deltas.filter(F.col("source") == source), [nodes[k] for k in at], "delta", [], False))
        out |= {at[r.node]: r.asDict() for r in found.collect()}
    return out


def _norms_left(norms: DataFrame) -> DataFrame:
    a, b = F.avg(F.col("before") ** 2), F.avg(F.col("after") ** 2)
    ratio = F.col("after") / (F.col("before") + F.lit(1e-12))
    return norms.groupBy("node").agg(F.count("*").alias("n_delta_test"), F.avg("before").alias("mean_raw_delta_norm"), F.avg("after").alias("mean_projected_delta_norm"), V.guarded_ratio(b, a).alias("residual_ratio"), F.avg(ratio).alias("mean_norm_ratio"), F.percentile_approx(ratio, 0.5, MEDIAN_ACCURACY).alias("median_norm_ratio"))


def fold_moments(features: DataFrame, roles: Roles, sources: dict[str, dict], n_splits: int, folds: list[int], seed: int = 0, folds_by_size: bool = True) -> tuple[DataFrame, DataFrame, dict[int, Moments], dict[tuple[str, int, str], Moments]]:
    """Rows with folds and all deltas as written tables, moments of each fold's training features, and of its sources by split."""
    rows = materialise(with_folds(features, roles.group, n_splits, folds_by_size), "variant-rows")
    by_fold = {int(f): m for f, m in collect_moments(rows, roles.vector, "fold").items()}
    d = len(next(iter(by_fold.values())).mean)
    deltas = materialise(variant_deltas(rows, roles, sources, n_splits, seed), "variant-deltas")
    x = {fold: merged([m for f, m in sorted(by_fold.items()) if f != fold], d) for fold in folds}
    nothing = {key: Moments.empty(d) for key in itertools.product(sources, folds, ("train", "test"))}
    return rows, deltas, x, nothing | source_moments(deltas, folds, d)


def run_paired_grid(features: DataFrame, roles: Roles, sources: dict[str, dict], erasers: list[dict], *, label: str | None = None, n_splits: int = 5, folds: list[int] | None = None, probe: str | None = "sgd", folds_by_size: bool = True, seed: int = 0) -> dict[str, DataFrame]:
    """Every variant of every source over folds: tables ``scores`` (a row a fold and variant) and ``summary`` (over folds).

    ``sources`` are delta configurations by name, as ``variant_deltas`` takes them;
    ``erasers`` as ``expand_variants``. A source without training deltas in a fold has no
    rows there; without test deltas its columns of deltas are null. ``probe`` is ``sgd``,
    ``sgd_safe`` or None; ``folds_by_size`` is of ``group_folds``.
    """
    spark, label = features.sparkSession, label or roles.domain
    wanted = list(folds) if folds is not None else list(range(n_splits))
    variants = expand_variants(sorted(sources), erasers)
    rows, deltas, x, moments = fold_moments(features, roles, sources, n_splits, wanted, seed, folds_by_size)
    d = len(x[wanted[0]].mean)
    test_rows = rows.filter(F.col("fold").isin(wanted))
    tested = deltas.filter(F.col("fold").isin(wanted) & (F.col("split").isNull() | (F.col("split") == "test")))
    names = [] if probe is None else sorted(few_values(rows.select(F.col(label).cast("string").alias(label)).filter(F.col(label).isNotNull()), label))
    out, pairs = [], {}
    fitted = [p for p in itertools.product(wanted, range(len(variants))) if moments[variants[p[1]].source, p[0], "train"].n > 1]
    for stack in _stacks(fitted, variants, d):
        nodes, facts = [], []
        for fold, k in stack:
            v = variants[k]
            if (fold, v.pair) not in pairs:
                pairs = {(fold, v.pair): Pair(x[fold], moments[v.source, fold, "train"], v)}  # stacks go pair by pair
            pair = pairs[fold, v.pair]
            m = pair.eraser(v)
            nodes.append(Node(fold, (k,), [], [m], State(x[fold], {}, {}), True))
            facts.append({"map_trace": float(np.trace(m.dense())), "erased_rank": m.rank, "trace_a": float(np.trace(pair.a)), "trace_b": float(np.trace(pair.b)), "n_train": x[fold].n, "n_delta_fit": moments[v.source, fold, "train"].n})
        change, left = _change(test_rows, nodes, roles.vector), _left(tested, nodes, [variants[k].source for _, k in stack])
        scores = {}
        if len(names) > 1:
            chains = [(n.fold, str(n.path[0]), *n.affine()) for n in nodes]
            scores = sgd.probe_scores(rows.withColumn("split", F.lit(None).cast("string")), names, label, roles.vector, [roles.key], wanted, chains, probe)
        for at, ((fold, k), own) in enumerate(zip(stack, facts, strict=True)):
            raw, after = scores.get((fold, ""), {}), scores.get((fold, str(k)), {})
            judged = {"raw_score": raw.get("balanced_accuracy"), "projected_score": after.get("balanced_accuracy"), "raw_accuracy": raw.get("accuracy"), "projected_accuracy": after.get("accuracy"), "chance": raw.get("chance"), "excess_ratio": excess(raw, after) if scores else None}
            out.append({"fold": fold, **asdict(variants[k]), **own, **change.get(at, {}), "n_delta_test": 0, **left.get(at, {}), **judged})
    release(deltas)
    release(rows)
    columns = [f.split()[0] for f in _SCORED.split(", ")]
    table = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in out], _SCORED)
    summary = mean_std(table, [f.name for f in fields(Variant)], _SCORES, count_of="fold")
    return {"scores": table, "summary": summary}


_SCORED = (
    "fold long, source string, method string, moment string, shrink_a boolean, shrink_b boolean, normalization string, joint string, ridge double, tol double, affine boolean, whiten boolean, lam double, rank long, "
    "n_train long, n_test long, n_delta_fit long, n_delta_test long, map_trace double, erased_rank long, trace_a double, trace_b double, mean_l2_change double, median_l2_change double, mean_raw_norm double, mean_relative_change double, "
    "mean_raw_delta_norm double, mean_projected_delta_norm double, residual_ratio double, mean_norm_ratio double, median_norm_ratio double, "
    "raw_score double, projected_score double, raw_accuracy double, projected_accuracy double, chance double, excess_ratio double"
)
