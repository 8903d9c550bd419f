"""Mergeable first and second moments of vectors.

Every task reduces its rows to one (n, mean, M2) a source; a fixed number of
mergers fold those with the pairwise update, so the driver receives at most
``MERGERS`` small states a source, whatever the number of rows. After a linear
map moments are pushed through algebraically and rows are not read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.functions import vectors as V

MERGERS = 16
EPS = 1e-12
_STATE = "source string, n long, mean array<double>, m2 array<double>"


@dataclass(frozen=True)
class Moments:
    """Count, mean and centred sum of products of a set of vectors."""

    n: int
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Moments:
        return cls(0, np.zeros(d), np.zeros((d, d)))

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        x = np.asarray(x, np.float64)
        if not len(x):
            return cls.empty(x.shape[1])
        mean = x.mean(0)
        return cls(len(x), mean, (x - mean).T @ (x - mean))

    def merge(self, other: Moments) -> Moments:
        """Moments of both sets together, in any order up to rounding."""
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.m2 + other.m2 + np.outer(gap, gap) * (self.n * other.n / n))

    def covariance(self, shrink: bool = False, legacy_shrinkage: bool = False) -> np.ndarray:
        """M2 / (n - 1); shrunk, it is M2 / n (or the former, by the legacy option) drawn to its mean variance."""
        if self.n <= 1:
            raise ValueError(f"{self.n} vectors have no covariance")
        if not shrink:
            return symmetric(self.m2 / (self.n - 1))
        return shrinkage(symmetric(self.m2 / (self.n - 1 if legacy_shrinkage else self.n)), self.n)

    def second_moment(self, shrink: bool = False, legacy_shrinkage: bool = False) -> np.ndarray:
        """E[x x']; shrunk, the covariance part is (or the whole, by the legacy option)."""
        if not self.n:
            raise ValueError("no vectors")
        spread, outer = symmetric(self.m2 / self.n), np.outer(self.mean, self.mean)
        if self.n == 1:
            return outer
        if shrink and legacy_shrinkage:
            return shrinkage(spread + outer, self.n)
        return (shrinkage(spread, self.n) if shrink else spread) + outer

    def mapped(self, matrix: np.ndarray, bias: np.ndarray | None = None) -> Moments:
        """Moments after x -> bias + P (x - bias), or P x without a bias."""
        b = np.zeros(len(self.mean)) if bias is None else bias
        return Moments(self.n, b + matrix @ (self.mean - b), symmetric(matrix @ self.m2 @ matrix.T))


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def shrinkage_weight(s: np.ndarray, n: int, eps: float = EPS) -> float:
    """Share of the sample covariance in the optimal linear shrinkage; not clamped."""
    p, trace = len(s), np.trace(s)
    centre = trace**2 / p
    return 1 - (trace**2 * centre / n + eps) / (np.sum(s * s) * centre - centre**2 + eps)


def shrinkage(s: np.ndarray, n: int, eps: float = EPS) -> np.ndarray:
    """Optimal linear shrinkage towards the mean variance; the trace stays."""
    a = shrinkage_weight(s, n, eps)
    return a * s + (1 - a) * np.trace(s) / len(s) * np.eye(len(s))


def normalised(a: np.ndarray, how: str = "none", eps: float = EPS) -> np.ndarray:
    """A moment matrix over its trace or Frobenius norm."""
    if how == "none":
        return a
    size = abs(np.trace(a)) if how == "trace" else np.linalg.norm(a) if how == "frobenius" else None
    if size is None:
        raise ValueError(f"normalisation {how!r}")
    if size <= eps:
        raise RuntimeError("a moment too small to normalise")
    return a / size


def matched(b: np.ndarray, a: np.ndarray, how: str = "none", eps: float = EPS) -> np.ndarray:
    """``b`` scaled to the trace of ``a``."""
    if how == "none":
        return b
    if how != "match_x_trace":
        raise ValueError(f"joint normalisation {how!r}")
    if abs(np.trace(b)) <= eps:
        raise RuntimeError("a moment too small to match")
    return b * (np.trace(a) / np.trace(b))


@dataclass(frozen=True)
class SourceSpec:
    """How a delta source enters a joint moment."""

    name: str = "default"
    weight: float = 1.0
    moment: str = "second_moment"
    normalization: str = "none"
    shrink: bool = False

    def matrix(self, moments: dict[str, Moments]) -> np.ndarray:
        m = moments[self.name]
        return m.covariance(self.shrink) if self.moment == "covariance" else m.second_moment(self.shrink)


def joint_moment(moments: dict[str, Moments], specs: list[SourceSpec], normalize_weights: bool = True) -> np.ndarray:
    """Weighted sum of the sources' moments; a source of weight zero need not exist."""
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("a source is named twice")
    if any(s.weight < 0 for s in specs) or not any(s.weight > 0 for s in specs):
        raise ValueError("weights must not be negative, and one must be positive")
    used = [s for s in specs if s.weight > 0]
    whole = sum(s.weight for s in used) if normalize_weights else 1.0
    return sum(s.weight / whole * normalised(s.matrix(moments), s.normalization) for s in used)


def source_diagnostics(moments: dict[str, Moments], specs: list[SourceSpec]) -> list[dict]:
    """Size of each source's moment, raw and normalised."""
    rows = []
    for s in specs:
        raw = s.matrix(moments)
        small = normalised(raw, s.normalization)
        rows.append({"source": s.name, "weight": s.weight, "n_delta": moments[s.name].n, "trace": float(np.trace(raw)), "frobenius": float(np.linalg.norm(raw)), "normalised_trace": float(np.trace(small)), "normalised_frobenius": float(np.linalg.norm(small))})
    return rows


def whitening(a: np.ndarray, ridge: float = 0.0, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """A^(1/2) and A^(-1/2) of a + ridge; directions at or below tol * max(largest, 1) are zero in both."""
    values, vectors = np.linalg.eigh(symmetric(a) + ridge * np.eye(len(a)))
    keep = values > tol * max(values.max(), 1.0)
    root = np.sqrt(np.where(keep, values, 0.0))
    inverse = np.where(keep, 1 / np.where(keep, root, 1.0), 0.0)
    return (vectors * root) @ vectors.T, (vectors * inverse) @ vectors.T


def top_components(values: np.ndarray, vectors: np.ndarray, rank: int | None, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues above tol * max(largest, 1) with their vectors, at most ``rank``, signs fixed."""
    order = np.argsort(values)[::-1]
    values, vectors = values[order], fix_signs(vectors[:, order].T).T
    keep = values > tol * max(values[0], 1.0)
    k = int(keep.sum()) if rank is None else min(rank, int(keep.sum()))
    return values[:k], vectors[:, :k]


def fix_signs(rows: np.ndarray) -> np.ndarray:
    """Rows with their largest entry positive."""
    if not rows.size:
        return rows
    at = np.abs(rows).argmax(1)
    return rows * np.where(rows[np.arange(len(rows)), at] < 0, -1.0, 1.0)[:, None]


def _reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    states: dict[str, Moments] = {}
    for batch in batches:
        for source, rows in batch.groupby("source", dropna=False):
            x = np.stack(rows["x"].to_numpy())
            states[source] = states.get(source, Moments.empty(x.shape[1])).merge(Moments.of(x))
    yield _frame(states)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    states: dict[str, Moments] = {}
    for batch in batches:
        for source, part in _states(batch):
            states[source] = states[source].merge(part) if source in states else part
    yield _frame(states)


def _frame(states: dict[str, Moments]) -> pd.DataFrame:
    return pd.DataFrame([(s, m.n, m.mean, m.m2.ravel()) for s, m in states.items()], columns=["source", "n", "mean", "m2"])


def _states(frame: pd.DataFrame) -> Iterator[tuple[str, Moments]]:
    for row in frame.itertuples(index=False):
        mean = np.asarray(row.mean)
        yield row.source, Moments(int(row.n), mean, np.asarray(row.m2).reshape(len(mean), len(mean)))


def collect_moments(df: DataFrame, vector: str, source: str | None = None) -> dict[str, Moments]:
    """Moments of each source (default: one called ``default``); null vectors are skipped."""
    named = F.lit("default") if source is None else F.coalesce(F.col(source).cast("string"), F.lit("null"))
    rows = df.filter(F.col(vector).isNotNull()).select(named.alias("source"), V.vec(vector).alias("x"))
    parts = rows.mapInPandas(_reduce, _STATE).repartition(MERGERS).mapInPandas(_merge, _STATE)
    out: dict[str, Moments] = {}
    for name, state in _states(parts.toPandas()):
        out[name] = out[name].merge(state) if name in out else state
    return out


def second_moment_cells(df: DataFrame, vector: str, keys: list[str] = ()) -> DataFrame:
    """(keys, i, j, n, sum): sums of products in long form, for wide tables of narrow vectors and for checks."""
    one = df.select(*keys, F.posexplode(V.vec(vector)).alias("i", "a"), V.vec(vector).alias("_x"))
    both = one.select(*keys, "i", "a", F.posexplode("_x").alias("j", "b"))
    return both.groupBy(*keys, "i", "j").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("s"))


@dataclass(frozen=True)
class CrossMoments:
    """Moments of x, and of x with one-hot labels."""

    x: Moments
    classes: list[str]
    cross: np.ndarray

    @property
    def priors(self) -> int:
        return len(self.classes)


def label_moments(df: DataFrame, vector: str, label: str, classes: list[str] | None = None) -> CrossMoments:
    """Moments of x by class, folded to the whole and to its covariance with one-hot labels.

    Column k of the cross-covariance is n_k (mean_k - mean) / (n - 1).
    """
    parts = collect_moments(df.filter(F.col(label).isNotNull()), vector, label)
    known = sorted(parts) if classes is None else list(classes)
    if unknown := set(parts) - set(known):
        raise ValueError(f"unknown classes: {sorted(unknown)}")
    if len(known) < 2:
        raise ValueError("two classes are needed")
    whole = None
    for part in parts.values():
        whole = part if whole is None else whole.merge(part)
    columns = [parts[k].n * (parts[k].mean - whole.mean) / (whole.n - 1) if k in parts else np.zeros(len(whole.mean)) for k in known]
    return CrossMoments(whole, known, np.stack(columns, axis=1))


def one_hot(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """A 0/1 column for every class; an unknown or null label gives nulls."""
    known = F.col(label).cast("string").isin(classes)
    return df.select("*", *[F.when(known, (F.col(label).cast("string") == c).cast("int")).alias(f"is_{c}") for c in classes])
