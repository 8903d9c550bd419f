"""Linear probes by averaged stochastic gradients, many at once.

Rows are packed into shards by hash, once, in an order that depends on the rows alone.
A round is one pass: every shard starts from the shared weights, goes ``EPOCHS`` times
through its rows in small batches, and hands back its weights; the mean by rows, folded
by a fixed number of mergers, is what the next round starts from. A pass serves a whole stack of
probes: each has its fold, an affine view of the rows (a chain of maps and the scaling)
and weights of its own, so a grid of maps over folds costs as many passes as one probe.

A probe is one against the rest with the logistic loss, balanced class weights and an
L2 penalty. It stops when its loss has not come ``tol`` under its best for ``PATIENCE``
rounds; its weights are the last ones, or the mean over the rounds (``average``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.functions import vectors as V
from eigenloom.operators.moments import Moments, collect_moments
from eigenloom.session import materialise, release, single_rows

#: Rows of a shard, about, and of a step of the gradient.
SHARD_ROWS, STEP_ROWS = 1 << 14, 32
#: Mergers that fold the weights of a round.
MERGERS = 16
#: Epochs of a shard in a round.
EPOCHS = 10
PATIENCE = 5
#: Numbers of rows under all views that a worker holds at once.
SEEN_NUMBERS = 1 << 20
#: Bytes of maps that one pass carries; larger stacks go in several.
STACK_BYTES = 256 << 20
#: Penalty, tolerance, most epochs and averaging by name.
KINDS = {"sgd": (1e-4, 1e-3, 500, False), "sgd_safe": (1e-4, 1e-4, 5000, True)}
_BLOCK = "fold int, split string, n int, y binary, x binary"


@dataclass(frozen=True)
class View:
    """A probe's rows and how it sees them: ``matrix @ x + offset``.

    Rows of no split train it if their fold is another than ``fold`` (any, if that is
    None) and test it if it is the same; rows of a split do what its name says in the
    fold that they name.
    """

    fold: int | None
    matrix: np.ndarray
    offset: np.ndarray

    def trains(self, fold: int, split: str | None) -> bool:
        return fold != self.fold if split is None else split == "train" and fold == self.fold

    def tests(self, fold: int, split: str | None) -> bool:
        return fold == self.fold and split in (None, "test")


def scaled(fold: int | None, matrix: np.ndarray, offset: np.ndarray, mean: np.ndarray, m2: np.ndarray, n: int) -> View:
    """The view through a map, scaled by the mapped training rows' means and population deviations (1 where nothing varies)."""
    centre = matrix @ mean + offset
    spread = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", matrix, m2, matrix) / max(n, 1), 0))
    spread = np.where(spread > 1e-9, spread, 1.0)
    return View(fold, matrix / spread[:, None], (offset - centre) / spread)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    rows = pd.concat(frames)
    for (fold, split), part in rows.groupby([rows["fold"], rows["split"].fillna("")], sort=True):
        x = np.stack(part["x"].to_numpy()).astype(np.float64)
        yield pd.DataFrame({"fold": [fold], "split": [split or None], "n": [len(part)], "y": [part["y"].to_numpy(np.int32).tobytes()], "x": [x.tobytes()]})


def pack(rows: DataFrame, key: list[str] = ()) -> DataFrame:
    """Shards of a table (fold, split, y, x, key...), ``y`` numbers of classes; written to the shared folder."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    place = F.xxhash64(*key, "x")
    dealt = rows.select("fold", "split", "y", "x", place.alias("place")).repartition(shards, "place").sortWithinPartitions("fold", "split", "place", "y")
    return materialise(dealt.select("fold", "split", "y", "x").mapInPandas(_pack, _BLOCK), "sgd-shards")


def _unpacked(row, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.x).reshape(-1, d), np.frombuffer(row.y, np.int32)


def _seen(x: np.ndarray, matrices: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows under each view, with a 1 at the end."""
    z = np.matmul(x, matrices.transpose(0, 2, 1)) + offsets[:, None, :]
    return np.concatenate([z, np.ones((*z.shape[:2], 1))], axis=2)


def local_epoch(x: np.ndarray, y: np.ndarray, matrices: np.ndarray, offsets: np.ndarray, weights: np.ndarray, by_class: np.ndarray, rate: float, alpha: float, judged: bool = True) -> np.ndarray:
    """Go through one shard in small steps, changing ``weights`` (probe, class, dimension + 1); losses by probe, zeros if not ``judged``."""
    loss = np.zeros(len(weights))
    hold = max(STEP_ROWS, SEEN_NUMBERS // (matrices.shape[0] * matrices.shape[1]) // STEP_ROWS * STEP_ROWS)
    for begin in range(0, len(x), hold):
        z, own = _seen(x[begin : begin + hold], matrices, offsets), y[begin : begin + hold]
        hits, shares = np.eye(weights.shape[1])[own], by_class[:, own][:, :, None]
        for at in range(0, z.shape[1], STEP_ROWS):
            rows, hit, share = z[:, at : at + STEP_ROWS], hits[at : at + STEP_ROWS], shares[:, at : at + STEP_ROWS]
            logits = np.matmul(rows, weights.transpose(0, 2, 1))
            if judged:
                loss += (share * (np.logaddexp(0, logits) - hit * logits)).sum(axis=(1, 2))
            gap = share * (0.5 * (1 + np.tanh(logits / 2)) - hit)
            step = np.matmul(gap.transpose(0, 2, 1), rows) / len(hit)
            step[:, :, :-1] += alpha * weights[:, :, :-1]
            weights -= rate * step
    return loss


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            state = np.frombuffer(row.state)
            total = state.copy() if total is None else total + state
    if total is not None:
        yield pd.DataFrame({"state": [total.tobytes()]})


def _summed(parts: DataFrame, size: int, n_parts: int) -> np.ndarray:
    if n_parts > MERGERS:
        parts = parts.repartition(MERGERS).mapInPandas(_add, "state binary")
    out = np.zeros(size)
    with single_rows(parts.sparkSession):
        states = parts.collect()
    for row in states:
        out += np.frombuffer(bytes(row.state))
    return out


def summed_over(blocks: DataFrame, function, shapes: list[tuple[int, ...]], n_parts: int) -> list[np.ndarray]:
    """Sums of the arrays (of the given shapes) that ``function(x, y)`` makes of every shard, added up in tasks and mergers first."""
    sizes = [int(np.prod(s)) for s in shapes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(sum(sizes))
        for batch in batches:
            for row in batch.itertuples(index=False):
                y = np.frombuffer(row.y, np.int32)
                total += np.concatenate([np.asarray(a).ravel() for a in function(np.frombuffer(row.x).reshape(len(y), -1), y)])
        yield pd.DataFrame({"state": [total.tobytes()]})

    state = _summed(blocks.mapInPandas(run, "state binary"), sum(sizes), n_parts)
    return [part.reshape(s) for part, s in zip(np.split(state, np.cumsum(sizes)[:-1]), shapes, strict=True)]


def _class_counts(blocks: DataFrame, n_classes: int) -> dict[tuple[int, str | None], np.ndarray]:
    """Rows of each class by fold and split: a few numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({"fold": row.fold, "split": row.split, "y": np.arange(n_classes), "n": np.bincount(np.frombuffer(row.y, np.int32), minlength=n_classes)})

    out: dict = {}
    with single_rows(blocks.sparkSession):
        found = blocks.select("fold", "split", "y").mapInPandas(count, "fold int, split string, y int, n long").groupBy("fold", "split", "y").agg(F.sum("n").alias("n")).collect()
    for r in found:
        out.setdefault((r.fold, r.split), np.zeros(n_classes, np.int64))[r.y] = r.n
    return out


def _chunks(views: list[View], d: int) -> Iterator[list[int]]:
    most = max(1, STACK_BYTES // (8 * d * d))
    for at in range(0, len(views), most):
        yield list(range(at, min(at + most, len(views))))


def fit_probes(blocks: DataFrame, views: list[View], n_classes: int, *, alpha: float = 1e-4, tol: float = 1e-3, max_epochs: int = 500, average: bool = False) -> np.ndarray:
    """Weights (probe, class, dimension + 1) of all views, from the shards of ``pack``."""
    d = len(views[0].offset)
    counts = _class_counts(blocks, n_classes)
    n_parts = blocks.select(F.spark_partition_id().alias("p")).distinct().count()
    out = np.zeros((len(views), n_classes, d + 1))
    for chunk in _chunks(views, d):
        out[chunk] = _fit_chunk(blocks, [views[k] for k in chunk], counts, n_classes, n_parts, alpha, tol, max_epochs, average)
    return out


def _fit_chunk(blocks, views, counts, n_classes, n_parts, alpha, tol, max_epochs, average) -> np.ndarray:
    d, m = len(views[0].offset), len(views)
    trained = np.array([sum((n for at, n in counts.items() if v.trains(*at)), np.zeros(n_classes, np.int64)) for v in views])
    for k, v in enumerate(views):
        tested = sum((n for at, n in counts.items() if v.tests(*at)), np.zeros(n_classes, np.int64))
        if (tested[trained[k] == 0] > 0).any():
            raise ValueError("test rows have a class that training lacks")
        if (trained[k] > 0).sum() < 2:
            raise ValueError("two classes are needed")
    total, present = trained.sum(axis=1), (trained > 0).sum(axis=1)
    by_class = np.where(trained > 0, total[:, None] / (present[:, None] * np.maximum(trained, 1)), 0.0)
    weights, mean = np.zeros((m, n_classes, d + 1)), np.zeros((m, n_classes, d + 1))
    best, stale, active = np.full(m, np.inf), np.zeros(m, int), np.arange(m)
    for step in range(max(1, max_epochs // EPOCHS)):
        rate = 4.0 / (d + 1) / (1 + step)
        merged, loss = _round(blocks, [views[k] for k in active], weights[active], by_class[active], rate, alpha, n_parts)
        weights[active] = merged
        mean[active] += (merged - mean[active]) / (step + 1)
        stale[active] = np.where(loss > best[active] - tol, stale[active] + 1, 0)
        best[active] = np.minimum(best[active], loss)
        active = active[stale[active] < PATIENCE]
        if not len(active):
            break
    return mean if average else weights


def _round(blocks: DataFrame, views: list[View], weights: np.ndarray, by_class: np.ndarray, rate: float, alpha: float, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean weights after one pass, and mean losses of the shards' last epochs."""
    m, d = len(views), len(views[0].offset)
    shared = blocks.sparkSession.sparkContext.broadcast((views, weights, by_class))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views, weights, by_class = shared.value
        matrices, offsets = np.stack([v.matrix for v in views]), np.stack([v.offset for v in views])
        rows, loss, total = np.zeros(m), np.zeros(m), np.zeros_like(weights)
        for batch in batches:
            for row in batch.itertuples(index=False):
                mine = [k for k, v in enumerate(views) if v.trains(row.fold, row.split)]
                if mine:
                    own = weights[mine].copy()
                    for epoch in range(EPOCHS):  # only the last one's losses count
                        last = local_epoch(*_unpacked(row, d), matrices[mine], offsets[mine], own, by_class[mine], rate, alpha, epoch + 1 == EPOCHS)
                    loss[mine] += last
                    total[mine] += row.n * own
                    rows[mine] += row.n
        yield pd.DataFrame({"state": [np.concatenate([rows, loss, total.ravel()]).tobytes()]})

    state = _summed(blocks.mapInPandas(run, "state binary"), 2 * m + weights.size, n_parts)
    shared.destroy()
    rows = np.maximum(state[:m], 1)
    return state[2 * m :].reshape(weights.shape) / rows[:, None, None], state[m : 2 * m] / rows


def score_probes(blocks: DataFrame, views: list[View], weights: np.ndarray) -> list[dict]:
    """Balanced accuracy, accuracy, chance and rows of each probe, in one pass for each chunk of the stack."""
    d, n_classes = len(views[0].offset), weights.shape[1]
    counts = _class_counts(blocks, n_classes)
    tables = np.zeros((len(views), n_classes, n_classes), np.int64)
    for chunk in _chunks(views, d):
        shared = blocks.sparkSession.sparkContext.broadcast([(k, views[k], weights[k]) for k in chunk])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    x, y = _unpacked(row, d)
                    for k, v, w in shared.value:
                        if v.tests(row.fold, row.split):
                            said = ((x @ v.matrix.T + v.offset) @ w[:, :-1].T + w[:, -1]).argmax(axis=1)
                            cell, n = np.unique(y.astype(np.int64) * n_classes + said, return_counts=True)
                            yield pd.DataFrame({"probe": k, "cell": cell, "n": n})

        with single_rows(blocks.sparkSession):
            found = blocks.mapInPandas(run, "probe int, cell long, n long").groupBy("probe", "cell").agg(F.sum("n").alias("n")).collect()
        for r in found:
            tables[r.probe, r.cell // n_classes, r.cell % n_classes] = r.n
    out = []
    for v, table in zip(views, tables, strict=True):
        trained = sum((n for at, n in counts.items() if v.trains(*at)), np.zeros(n_classes, np.int64))
        n, hits = table.sum(axis=1), np.diag(table)
        seen = n > 0
        out.append({
            "balanced_accuracy": float((hits[seen] / n[seen]).mean()) if seen.any() else None,
            "accuracy": float(hits.sum() / n.sum()) if seen.any() else None,
            "chance": 1 / int((trained > 0).sum()) if (trained > 0).any() else None,
            "n_train": int(trained.sum()),
            "n_test": int(n.sum()),
        })
    return out


def probe_scores(table: DataFrame, names: list[str], label: str, vector: str, key: list[str], folds: list[int], chains: list[tuple[int, str, np.ndarray, np.ndarray]] = (), kind: str = "sgd") -> dict[tuple[int, str], dict]:
    """Scores by (fold, name) of the raw rows (name ``""``) and of chains (fold, name, matrix, offset), all from the same passes.

    ``table`` has ``fold`` and ``split``, as ``View`` says; ``names`` are the classes in order.
    """
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label).cast("string"))
    known = table.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    blocks = pack(known.select("fold", "split", (number - 1).cast("int").alias("y"), V.vec(vector).alias("x"), *key), key)
    tagged = known.withColumn("tag", F.to_json(F.array(F.col("fold").cast("string"), F.coalesce("split", F.lit("")))))
    found = {tuple(json.loads(t)): m for t, m in collect_moments(tagged, vector, "tag").items()}
    d = len(next(iter(found.values())).mean)
    train = {f: reduce(Moments.merge, [m for (own, split), m in sorted(found.items()) if (split == "train" and own == str(f)) or (not split and own != str(f))], Moments.empty(d)) for f in folds}
    views, keys = [], []
    for fold, name, matrix, offset in [*((f, "", np.eye(d), np.zeros(d)) for f in folds), *chains]:
        views.append(scaled(fold, matrix, offset, train[fold].mean, train[fold].m2, train[fold].n))
        keys.append((fold, name))
    alpha, tol, epochs, average = KINDS[kind]
    weights = fit_probes(blocks, views, len(names), alpha=alpha, tol=tol, max_epochs=epochs, average=average)
    scores = dict(zip(keys, score_probes(blocks, views, weights), strict=True))
    release(blocks)
    return scores


def fit_sgd(train: DataFrame, vector: str, label: str, kind: str = "sgd"):
    """The probe of a kind on all rows, as ``fit_probe`` gives it: a function that adds ``predicted``, and the class names."""
    from eigenloom.operators.probe import class_table

    names, classes = class_table(train, label)
    if len(names) < 2:
        raise ValueError("two classes are needed")
    x = collect_moments(train, vector)["default"]
    view = scaled(None, np.eye(len(x.mean)), np.zeros(len(x.mean)), x.mean, x.m2, x.n)
    coded = train.filter(F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("class"), V.vec(vector).alias("x")).join(F.broadcast(classes), "class")
    blocks = pack(coded.select(F.lit(-1).alias("fold"), F.lit(None).cast("string").alias("split"), F.col("class_no").cast("int").alias("y"), "x"))
    alpha, tol, epochs, average = KINDS[kind]
    w = fit_probes(blocks, [view], len(names), alpha=alpha, tol=tol, max_epochs=epochs, average=average)[0]
    release(blocks)

    @F.pandas_udf("string")
    def said(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=str)
        z = np.stack(x.to_numpy()).astype(np.float64) @ view.matrix.T + view.offset
        return pd.Series(np.array(names)[(z @ w[:, :-1].T + w[:, -1]).argmax(axis=1)])

    return lambda df: df.withColumn("predicted", F.when(F.col(vector).isNotNull(), said(F.coalesce(V.vec(vector), F.array_repeat(F.lit(0.0), len(x.mean)))))), names
