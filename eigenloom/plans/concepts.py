"""Grids of eraser chains over two concepts: scanner domains and target stains.

What the search needs is gathered once, for all folds: moments of features by fold, of
every delta source by fold, and class means by fold. Those of a fold's training rows are
merged from the other folds', so rows are not read again by fold. The search then goes
through the tree of stages on the driver and carries a state of moments; chains with a
common beginning share it.

All nodes that are to be evaluated, of all folds, go over the rows together: one pass
for the changes of test rows, one for the deltas, and a pass a round for the probes of
each concept (``operators/sgd.py``), whatever the number of chains.

Delta sources that are capped, or grouped by what is not a fold's group, cannot be
merged from other folds: they are built for each fold and split by themselves.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.functions import vectors as V
from eigenloom.operators import deltas as D
from eigenloom.operators import sgd
from eigenloom.operators.erasers import LinearMap
from eigenloom.operators.metrics import joint_diagnostics
from eigenloom.operators.moments import CrossMoments, Moments, collect_moments
from eigenloom.operators.splits import balanced_sample, with_folds
from eigenloom.operators.stain import delta_sources, rows_of_fold, stain_deltas, without_identity
from eigenloom.plans.grid import PAIRED, Stage, State, expand_stage, fit_stage, specs_of
from eigenloom.roles import Roles
from eigenloom.session import few_values, join_checked, materialise, release
from eigenloom.sources.artifacts import rows_frame

#: Accuracy of the medians of change: an n-th of the rows at most.
MEDIAN_ACCURACY = 10_000


@dataclass
class Node:
    """A chain of a fold: its place in the tree, its maps, and the state that they lead to."""

    fold: int
    path: tuple[int, ...]
    stages: list[Stage]
    maps: list[LinearMap]
    state: State
    leaf: bool

    def affine(self) -> tuple[np.ndarray, np.ndarray]:
        """The chain as x -> P x + o."""
        d = len(self.state.x.mean)
        matrix, offset = np.eye(d), np.zeros(d)
        for m in self.maps:
            p, b = m.dense(), m.bias if m.bias is not None else np.zeros(d)
            matrix, offset = p @ matrix, p @ offset + b - p @ b
        return matrix, offset


def merged(parts: list[Moments], d: int) -> Moments:
    """Moments of all parts together; of none, empty ones."""
    return reduce(Moments.merge, parts, Moments.empty(d))


def class_sums(rows: DataFrame, vector: str, label: str) -> dict[tuple[int, str], tuple[int, np.ndarray]]:
    """(fold, class) to its number of rows and mean."""
    parts = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).groupBy("fold", F.col(label).cast("string").alias("class"))
    return {(r.fold, r["class"]): (r.n, np.array(r.m)) for r in parts.agg(F.count("*").alias("n"), V.mean_of(vector).alias("m")).collect()}


def _cross(x: Moments, sums: dict[tuple[int, str], tuple[int, np.ndarray]], fold: int) -> CrossMoments:
    """Covariance of x with one-hot classes over the rows outside a fold."""
    classes = sorted({c for f, c in sums if f != fold})
    columns = []
    for c in classes:
        own = [sums[k] for k in sums if k[0] != fold and k[1] == c]
        n = sum(m for m, _ in own)
        columns.append((sum(m * mean for m, mean in own) - n * x.mean) / (x.n - 1))
    return CrossMoments(x, classes, np.stack(columns, axis=1))


def grid_deltas(rows: DataFrame, roles: Roles, scanner: dict[str, dict], stain: DataFrame | None, stain_options: dict[str, dict], n_splits: int, seed: int) -> DataFrame:
    """(source, fold, split, delta) of all delta sources: of a fold's own rows (no split), or made for a split of a fold."""
    folds = rows.select(roles.group, "fold").distinct()
    parts, capped, capped_stain = [], {}, {}
    for name, options in scanner.items():
        if options.get("max_deltas") is not None:
            capped[name] = options
        else:
            made = D.domain_deltas(rows, roles, **options, validate=False)
            parts.append(join_checked(made, folds, roles.group).select(F.lit(f"scanner.{name}").alias("source"), "fold", F.lit(None).cast("string").alias("split"), "delta"))
    by_row = rows.select(F.col(roles.key).alias("source_row_index"), F.col(roles.vector).alias("x"), "fold")
    for name, options in stain_options.items():
        if options.get("max_deltas") is not None or options.get("group") not in (None, f"source_{roles.group}"):
            capped_stain[name] = options
        else:
            own = rows_of_fold(stain, rows, roles.key)
            made = stain_deltas(own, by_row, **options)
            parts.append(join_checked(made, by_row.select("source_row_index", "fold"), "source_row_index").select(F.lit(f"stain.{name}").alias("source"), "fold", F.lit(None).cast("string").alias("split"), "delta"))
    if capped or capped_stain:
        for fold in range(n_splits):
            for (name, split), made in delta_sources(rows, roles, capped, stain, capped_stain, fold, seed).items():
                parts.append(made.select(F.lit(name).alias("source"), F.lit(fold).alias("fold"), F.lit(split).alias("split"), "delta"))
    return reduce(DataFrame.unionByName, parts)


def source_moments(deltas: DataFrame, folds: list[int], d: int) -> dict[tuple[str, int, str], Moments]:
    """(source, fold, train or test) to moments, from one pass."""
    tagged = deltas.withColumn("tag", F.to_json(F.array("source", F.col("fold").cast("string"), F.coalesce("split", F.lit("")))))
    found = {tuple(json.loads(tag)): m for tag, m in collect_moments(tagged, "delta", "tag").items()}
    out = {}
    for name, fold in itertools.product(sorted({k[0] for k in found}), folds):
        own = {k[1]: m for k, m in found.items() if k[0] == name and k[2] == ""}
        if own:
            out[name, fold, "train"] = merged([m for f, m in sorted(own.items()) if f != str(fold)], d)
            out[name, fold, "test"] = own.get(str(fold), Moments.empty(d))
        else:
            for split in ("train", "test"):
                out[name, fold, split] = found.get((name, str(fold), split), Moments.empty(d))
    return out


def _search(folds: list[int], starts: dict[int, State], stages: list[list[Stage]], diagnostics: bool) -> tuple[list[Node], list[dict]]:
    """Every node of every fold's tree, and moment rows of the paired stages."""
    nodes, moments = [], []

    def visit(fold: int, at: Node) -> None:
        depth = len(at.path)
        if depth == len(stages):
            return
        families: dict = {}
        for k, option in enumerate(stages[depth]):
            m = fit_stage(option, at.state, families)
            node = Node(fold, (*at.path, k), [*at.stages, option], [*at.maps, m], at.state.after(m), depth + 1 == len(stages))
            if diagnostics and option.method in PAIRED:
                rows = joint_diagnostics(at.state.x, at.state.sources, specs_of(option, at.state), m, with_spectrum=False)
                moments.extend({"fold": fold, "path": _path(node), "stage_index": depth, "stage_name": option.name} | r for r in rows)
            nodes.append(node)
            visit(fold, node)

    for fold in folds:
        visit(fold, Node(fold, (), [], [], starts[fold], False))
    return nodes, moments


def _path(node: Node) -> str:
    return "/".join(map(str, node.path))


def norms_by_node(rows: DataFrame, nodes: list[Node], vector: str, keep: list[str], affine: bool) -> DataFrame:
    """(node, keep..., before, after, change): norms of every row under each node of its fold. ``rows`` has ``fold``."""
    maps = rows.sparkSession.sparkContext.broadcast([(k, n.fold, *n.affine()) for k, n in enumerate(nodes)])
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                before = np.linalg.norm(x, axis=1)
                for k, own, matrix, offset in maps.value:
                    if own == fold:
                        z = x @ matrix.T + (offset if affine else 0)
                        yield pd.DataFrame({"node": k, **{c: part[c].to_numpy() for c in keep}, "before": before, "after": np.linalg.norm(z, axis=1), "change": np.linalg.norm(z - x, axis=1)})

    fields = ", ".join(["node int", *(f"{c} {kinds[c]}" for c in keep), "before double", "after double", "change double"])
    return rows.filter(F.col(vector).isNotNull()).select("fold", *keep, V.vec(vector).alias("v")).mapInPandas(run, fields)


def _stain_probe_table(stain: DataFrame, rows: DataFrame, roles: Roles, folds: list[int], label: str, most: int | None, exclude_identity: bool, seed: int) -> DataFrame:
    """Stain rows with ``fold`` and ``split``: all of them, or balanced samples for each fold's training and test rows."""
    own = without_identity(stain) if exclude_identity else stain
    placed = join_checked(own.drop("fold"), rows.select(F.col(roles.key).alias("source_row_index"), "fold"), "source_row_index")
    if most is None:
        return placed.withColumn("split", F.lit(None).cast("string"))
    parts = []
    for fold, (split, keep, at) in itertools.product(folds, (("train", lambda f: F.col("fold") != f, 0), ("test", lambda f: F.col("fold") == f, 10_000))):
        sample = balanced_sample(placed.filter(keep(fold)), label, most, ["source_row_index", "target_index"], seed + at)
        parts.append(sample.withColumn("fold", F.lit(fold)).withColumn("split", F.lit(split)))
    return reduce(DataFrame.unionByName, parts)


def excess(raw: dict, after: dict) -> float | None:
    """Share of a probe's score over chance that is left; null where the raw score is chance."""
    gap = raw["balanced_accuracy"] - raw["chance"]
    return (after["balanced_accuracy"] - raw["chance"]) / gap if abs(gap) > 1e-12 else None


def run_concept_grid(features: DataFrame, roles: Roles, stages: list[dict], *, scanner: dict[str, dict] | None = None, stain: DataFrame | None = None, stain_options: dict[str, dict] | None = None, stain_vector: str = "z", stain_label: str = "target_id", label: str | None = None, concepts: list[str] = (), n_splits: int = 5, folds: list[int] | None = None, probe: str | None = "sgd", max_probe_examples: int | None = None, exclude_identity: bool = False, evaluate_intermediate: bool = False, diagnostics: bool = True, folds_by_size: bool = True, seed: int = 0) -> dict[str, DataFrame]:
    """Chains of all options of the stages over folds: tables ``chains``, ``deltas``, ``stages`` and ``moments``.

    ``scanner`` and ``stain_options`` name delta sources (``scanner.*``, ``stain.*``),
    which a stage refers to in ``sources``; ``stain`` (source_row_index, target_index,
    target_id, vector) is the stain table. ``probe`` is ``sgd``, ``sgd_safe`` or None;
    the stain's target is probed where there is a stain table with two targets.
    ``path`` names a chain by the numbers of its stages' options; ``folds_by_size`` is of ``group_folds``.

    chains: a row a fold and chain. deltas: a row a chain and source, over the fold's test
    deltas. stages: a row a prefix of a chain; its scores only with
    ``evaluate_intermediate``. moments: A, B and every source before a stage, and A and B
    after it.
    """
    spark, label = features.sparkSession, label or roles.domain
    scanner, stain_options = scanner or {}, (stain_options or {}) if stain is not None else {}
    rows = materialise(with_folds(features, roles.group, n_splits, folds_by_size), "grid-rows")
    wanted = list(folds) if folds is not None else list(range(n_splits))
    by_fold = {int(f): m for f, m in collect_moments(rows, roles.vector, "fold").items()}
    d = len(next(iter(by_fold.values())).mean)
    sums = {c: class_sums(rows, roles.vector, c) for c in concepts}
    if scanner or stain_options:
        deltas = materialise(grid_deltas(rows, roles, scanner, stain, stain_options, n_splits, seed), "grid-deltas")
        sources = source_moments(deltas, wanted, d)
    else:
        deltas, sources = None, {}
    starts = {}
    for fold in wanted:
        x = merged([m for f, m in sorted(by_fold.items()) if f != fold], d)
        starts[fold] = State(x, {n: m for (n, f, split), m in sources.items() if f == fold and split == "train"}, {c: _cross(x, sums[c], fold) for c in concepts})
    nodes, moments = _search(wanted, starts, [expand_stage(s) for s in stages], diagnostics)
    judged = [n for n in nodes if n.leaf or evaluate_intermediate]

    change = norms_by_node(rows.filter(F.col("fold").isin(wanted)), judged, roles.vector, [], True)
    median = lambda c: F.percentile_approx(c, 0.5, MEDIAN_ACCURACY)
    change = change.groupBy("node").agg(
        F.count("*").alias("n_test"),
        F.avg("change").alias("mean_l2_change"),
        median("change").alias("median_l2_change"),
        F.avg("before").alias("mean_raw_norm"),
        F.avg(F.col("change") / (F.col("before") + F.lit(1e-12))).alias("mean_relative_change"),
        F.avg(F.col("change") * F.col("change")).alias("mean_squared_change"),
    )
    changes = {r.node: r.asDict() for r in change.collect()}
    scanner_scores = stain_scores = None
    if probe is not None:
        names = sorted(few_values(rows.select(F.col(label).cast("string").alias(label)).filter(F.col(label).isNotNull()), label))
        chains = [(n.fold, _path(n), *n.affine()) for n in judged]
        scanner_scores = sgd.probe_scores(rows.withColumn("split", F.lit(None).cast("string")), names, label, roles.vector, [roles.key], wanted, chains, probe)
        if stain is not None:
            targets = sorted(few_values(stain.select(F.col(stain_label).cast("string").alias(stain_label)).filter(F.col(stain_label).isNotNull()), stain_label))
            if len(targets) > 1:
                table = _stain_probe_table(stain, rows, roles, wanted, stain_label, max_probe_examples, exclude_identity, seed)
                stain_scores = sgd.probe_scores(table, targets, stain_label, stain_vector, ["source_row_index", "target_index"], wanted, chains, probe)

    def score_columns(node: Node) -> dict:
        out = {}
        for name, scores in (("scanner", scanner_scores), ("stain", stain_scores)):
            raw, after = (scores[node.fold, ""], scores[node.fold, _path(node)]) if scores else ({}, {})
            out |= {f"raw_{name}_score": raw.get("balanced_accuracy"), f"projected_{name}_score": after.get("balanced_accuracy"), f"raw_{name}_accuracy": raw.get("accuracy"), f"projected_{name}_accuracy": after.get("accuracy")}
            out |= {f"{name}_chance": raw.get("chance"), f"{name}_excess_ratio": excess(raw, after) if scores else None, f"n_{name}_train": raw.get("n_train", 0), f"n_{name}_test": raw.get("n_test", 0)}
        return out

    def variance(node: Node) -> dict:
        start, test = starts[node.fold].x, by_fold.get(node.fold, Moments.empty(d))
        matrix, _ = node.affine()
        trace = lambda m: float(np.trace(m.m2) / (m.n - 1)) if m.n > 1 else None
        reference, left = trace(start), trace(node.state.x)
        after = test.mapped(matrix, None)
        return {"reference_trace": reference, "projected_trace": left, "trace_ratio": left / reference if reference else None, "test_trace": trace(test), "projected_test_trace": trace(after), "n_train": start.n}

    where = {id(n): k for k, n in enumerate(judged)}

    def row(node: Node) -> dict:
        out = {"fold": node.fold, "path": _path(node), "stage_index": len(node.path) - 1, "stage_names": [s.name for s in node.stages], "stage_methods": [s.method for s in node.stages], "stage_ranks": [m.rank for m in node.maps], "stage_lambdas": [float(s.options["lam"]) if s.options.get("lam") is not None else None for s in node.stages]}
        out |= variance(node)
        seen = id(node) in where
        measured = changes.get(where.get(id(node)), {})
        out |= {k: measured.get(k) for k in ("n_test", "mean_l2_change", "median_l2_change", "mean_raw_norm", "mean_relative_change", "mean_squared_change")}
        reference = out["reference_trace"]
        out["change_over_trace"] = out["mean_squared_change"] / reference if seen and reference and measured else None
        empty = dict.fromkeys(score_columns(judged[0])) if judged else {}
        return out | (score_columns(node) if seen else empty)

    tables = {"chains": _table(spark, [row(n) for n in nodes if n.leaf], _CHAIN), "stages": _table(spark, [row(n) for n in nodes], _CHAIN)}
    tables["moments"] = rows_frame(spark, moments) if moments else spark.createDataFrame([], "fold long, path string, stage_index long, stage_name string, kind string, source string, trace double, frobenius double")
    if deltas is None:
        tables["deltas"] = spark.createDataFrame([], _DELTA)
    else:
        tested = deltas.filter(F.col("fold").isin(wanted) & (F.col("split").isNull() | (F.col("split") == "test")))
        leaves = [n for n in judged if n.leaf]
        tables["deltas"] = _delta_scores(tested, leaves, {n.fold: starts[n.fold].x for n in leaves})
        release(deltas)
    release(rows)
    return tables


_SCORE = ", ".join(f"raw_{n}_score double, projected_{n}_score double, raw_{n}_accuracy double, projected_{n}_accuracy double, {n}_chance double, {n}_excess_ratio double, n_{n}_train long, n_{n}_test long" for n in ("scanner", "stain"))
_CHAIN = f"fold long, path string, stage_index long, stage_names array<string>, stage_methods array<string>, stage_ranks array<long>, stage_lambdas array<double>, reference_trace double, projected_trace double, trace_ratio double, test_trace double, projected_test_trace double, n_train long, n_test long, mean_l2_change double, median_l2_change double, mean_raw_norm double, mean_relative_change double, mean_squared_change double, change_over_trace double, {_SCORE}"
_DELTA = "fold long, path string, source string, kind string, n_delta long, mean_raw_norm double, mean_projected_norm double, residual_ratio double, removed_fraction double, mean_norm_ratio double, raw_over_trace double, projected_over_trace double"


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def _delta_scores(tested: DataFrame, leaves: list[Node], reference: dict[int, Moments]) -> DataFrame:
    """What chains leave of the test deltas of their folds, by source; one pass, a row a chain and source."""
    norms = norms_by_node(tested, leaves, "delta", ["source"], False)
    a, b = F.col("before") * F.col("before"), F.col("after") * F.col("after")
    sums = norms.groupBy("node", "source").agg(F.count("*").alias("n"), F.avg(a).alias("a"), F.avg(b).alias("b"), F.avg("before").alias("raw"), F.avg("after").alias("left"), F.avg(F.col("after") / (F.col("before") + F.lit(1e-12))).alias("ratio"))
    out = []
    for r in sums.collect():
        node = leaves[r.node]
        x = reference[node.fold]
        trace = float(np.trace(x.m2) / (x.n - 1)) if x.n > 1 else 0.0
        kept = r.b / r.a if r.a > 1e-12 else None
        over = lambda v: v / trace if trace > 1e-12 else None
        out.append({"fold": node.fold, "path": _path(node), "source": r.source, "kind": r.source.split(".")[0], "n_delta": r.n, "mean_raw_norm": r.raw, "mean_projected_norm": r.left, "residual_ratio": kept, "removed_fraction": None if kept is None else 1 - kept, "mean_norm_ratio": r.ratio, "raw_over_trace": over(r.a), "projected_over_trace": over(r.b)})
    return _table(tested.sparkSession, out, _DELTA)
