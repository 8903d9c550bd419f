"""Linear erasure maps: fitted from moments on the driver, applied to rows in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from eigenloom.functions import vectors as V
from eigenloom.operators.moments import CrossMoments, Moments, SourceSpec, joint_moment, matched, shrinkage, symmetric, top_components, whitening


@dataclass(frozen=True)
class LinearMap:
    """x -> bias + P (x - bias), with P = I - left right where factors are given."""

    matrix: np.ndarray | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    bias: np.ndarray | None = None
    method: str = "linear"
    eigenvalues: np.ndarray | None = None
    config: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.matrix is None and (self.left is None or self.right is None):
            raise ValueError("a matrix or both factors are needed")
        if self.matrix is not None and self.matrix.shape[0] != self.matrix.shape[1]:
            raise ValueError("the matrix must be square")
        if self.matrix is None and self.left.shape != self.right.T.shape:
            raise ValueError("factors do not match")
        if self.bias is not None and len(self.bias) != self.dim:
            raise ValueError("the bias does not match")

    @property
    def dim(self) -> int:
        return len(self.matrix) if self.matrix is not None else len(self.left)

    @property
    def rank(self) -> int:
        """Numerical rank of what is taken away."""
        return int(np.linalg.matrix_rank(np.eye(self.dim) - self.dense(), tol=1e-5))

    def dense(self) -> np.ndarray:
        return self.matrix if self.matrix is not None else np.eye(self.dim) - self.left @ self.right

    def __call__(self, x: np.ndarray, affine: bool = True) -> np.ndarray:
        b = self.bias if affine and self.bias is not None else np.zeros(self.dim)
        centred = x - b
        if self.matrix is None and self.left.shape[1] < self.dim / 2:
            return b + centred - (centred @ self.right.T) @ self.left.T
        return b + centred @ self.dense().T

    def of_moments(self, m: Moments, affine: bool = True) -> Moments:
        return m.mapped(self.dense(), self.bias if affine else None)


def compose(maps: list[LinearMap]) -> LinearMap:
    """The maps one after the other as one: P and the offset are multiplied out on the driver."""
    if not maps:
        raise ValueError("an empty chain")
    if len({m.dim for m in maps}) > 1:
        raise ValueError("the maps' dimensions differ")
    d = maps[0].dim
    matrix, offset = np.eye(d), np.zeros(d)
    for m in maps:
        p, b = m.dense(), m.bias if m.bias is not None else np.zeros(d)
        matrix, offset = p @ matrix, p @ offset + b - p @ b
    # bias - P bias = offset, solved where it can be; else the affine part is kept by least squares
    bias, *_ = np.linalg.lstsq(np.eye(d) - matrix, offset, rcond=None)
    if not np.allclose((np.eye(d) - matrix) @ bias, offset, atol=1e-8):
        raise ValueError("the chain has no fixed point; apply its maps in turn")
    return LinearMap(matrix=matrix, bias=bias, method="chain", config={"stages": [m.method for m in maps]})


def apply_map(df: DataFrame, vector: str, linear_map: LinearMap | list[LinearMap], output: str | None = None, affine: bool = True) -> DataFrame:
    """``df`` with the mapped vector; a chain is one pass. ``affine=False`` for deltas: P only."""
    chain = df.sparkSession.sparkContext.broadcast(linear_map if isinstance(linear_map, list) else [linear_map])

    @F.pandas_udf(ArrayType(DoubleType()))
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if known.any():
                x = np.stack(batch[known].to_numpy()).astype(np.float64)
                for m in chain.value:
                    x = m(x, affine)
                out[known] = pd.Series(list(x), index=batch.index[known])
            yield out

    return df.withColumn(output or vector, mapped(V.vec(vector)))


def apply_map_native(df: DataFrame, vector: str, linear_map: LinearMap, output: str | None = None) -> DataFrame:
    """As ``apply_map`` without Python, for narrow vectors: rows of P are part of the plan."""
    d = linear_map.dim
    b = linear_map.bias if linear_map.bias is not None else np.zeros(d)
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    rows = F.array(*[array(r) for r in linear_map.dense()])
    moved = F.transform(rows, lambda r: V.dot(r, V.subtract(vector, array(b))))
    return df.withColumn(output or vector, V.add(array(b), moved))


def _joint(x: Moments, sources: dict[str, Moments], specs: list[SourceSpec] | None, normalize_weights: bool, joint: str, shrink_a: bool) -> tuple[np.ndarray, np.ndarray]:
    a = x.covariance(shrink_a)
    b = joint_moment(sources, specs or [SourceSpec(name) for name in sorted(sources)], normalize_weights)
    return a, matched(b, a, joint)


def pca_eraser(x: Moments, sources: dict[str, Moments], rank: int | None, *, specs=None, whiten: bool = False, affine: bool = True, joint: str = "none", shrink_a: bool = True, ridge: float = 1e-4, tol: float = 1e-7, normalize_weights: bool = True) -> LinearMap:
    """Takes away the leading directions of the delta moment, orthogonally or (whitened) obliquely."""
    b = joint_moment(sources, specs or [SourceSpec(name) for name in sorted(sources)], normalize_weights)
    bias = x.mean if affine else None
    if not whiten:
        values, u = top_components(*np.linalg.eigh(symmetric(b)), rank, tol)
        return LinearMap(left=u, right=u.T, bias=bias, method="pca", eigenvalues=values, config={"rank": rank})
    a, b = _joint(x, sources, specs, normalize_weights, joint, shrink_a)
    root, inverse = whitening(a, ridge, tol)
    values, u = top_components(*np.linalg.eigh(symmetric(inverse @ b @ inverse)), rank, tol)
    return LinearMap(left=root @ u, right=u.T @ inverse, bias=bias, method="pca_whitened" if rank is not None else "hard", eigenvalues=values, config={"rank": rank})


def hard_eraser(x: Moments, sources: dict[str, Moments], rank: int | None = None, **options) -> LinearMap:
    """The whitened eraser; without a rank, every direction that is not numerically zero."""
    return pca_eraser(x, sources, rank, whiten=True, **options)


def soft_eraser(x: Moments, sources: dict[str, Moments], lam: float, rank: int | None = None, *, specs=None, affine: bool = True, joint: str = "none", shrink_a: bool = True, ridge: float = 1e-4, tol: float = 1e-7, normalize_weights: bool = True) -> LinearMap:
    """P = A (A + lam B)^-1; with a rank, I - P is truncated to its largest singular values above ``tol``."""
    a, b = _joint(x, sources, specs, normalize_weights, joint, shrink_a)
    a = a + ridge * np.eye(len(a))
    p = np.linalg.solve((a + lam * b).T, a.T).T
    bias, config = x.mean if affine else None, {"lambda": lam, "rank": rank}
    if rank is None:
        return LinearMap(matrix=p, bias=bias, method="soft", config=config)
    u, s, vt = np.linalg.svd(np.eye(len(a)) - p)
    k = min(rank, int((s > tol).sum()))
    root = np.sqrt(s[:k])
    return LinearMap(left=u[:, :k] * root, right=root[:, None] * vt[:k], bias=bias, method="soft", config=config)


def soft_family(x: Moments, sources: dict[str, Moments], *, specs=None, affine: bool = True, joint: str = "none", shrink_a: bool = True, ridge: float = 1e-4, tol: float = 1e-7, normalize_weights: bool = True):
    """A function of lambda that gives full-rank soft erasers from one eigendecomposition, and the eigenvalues."""
    a, b = _joint(x, sources, specs, normalize_weights, joint, shrink_a)
    root, inverse = whitening(a, ridge, tol)
    values, u = np.linalg.eigh(symmetric(inverse @ b @ inverse))
    values = np.maximum(values, 0)
    left, right = root @ u, u.T @ inverse

    def member(lam: float) -> LinearMap:
        shares = lam * values / (1 + lam * values)
        return LinearMap(matrix=np.eye(len(a)) - (left * shares) @ right, bias=x.mean if affine else None, method="soft", eigenvalues=values, config={"lambda": lam, "rank": None})

    return member, values[::-1]


def leace_eraser(cross: CrossMoments, *, affine: bool = True, shrink: bool = True, tol: float = 0.01, constrain_trace: bool = True, whiten: bool = True) -> LinearMap:
    """Least-squares concept erasure: class means agree afterwards, with the least change under A's metric.

    ``whiten=False`` erases orthogonally. If the total variance would grow, the
    map is blended with the orthogonal one so that it stays.
    """
    x, d = cross.x, len(cross.x.mean)
    sigma = shrinkage(symmetric(x.m2 / x.n), x.n) if shrink else x.covariance()
    if whiten:
        values, vectors = np.linalg.eigh(symmetric(sigma))
        keep = values > values.max() * d * np.finfo(np.float64).eps
        root = np.sqrt(np.where(keep, values, 0.0))
        w = (vectors * np.where(keep, 1 / np.where(keep, root, 1.0), 0.0)) @ vectors.T
        back = (vectors * root) @ vectors.T
    else:
        w = back = np.eye(d)
    u, s, _ = np.linalg.svd(w @ cross.cross, full_matrices=False)
    u = u[:, s > tol]
    taken = back @ u @ u.T @ w
    if constrain_trace and whiten and u.size:
        p, q, whole = np.eye(d) - taken, np.eye(d) - u @ u.T, np.trace(sigma)
        pp, pq, qq = (np.trace(m @ sigma @ n.T) for m, n in ((p, p), (p, q), (q, q)))
        if pp > whole:
            a, b, c = pp - 2 * pq + qq, 2 * (pq - qq), qq - whole
            alpha = (-b + np.sqrt(max(b * b - 4 * a * c, 0.0))) / (2 * a)
            alpha = min(max(alpha, 0.0), 1.0)
            taken = alpha * taken + (1 - alpha) * (u @ u.T)
    left, values, right = np.linalg.svd(taken)
    k = int((values > 1e-9 * max(values[0], 1e-30)).sum()) if u.size else 0
    root = np.sqrt(values[:k])
    return LinearMap(left=left[:, :k] * root, right=root[:, None] * right[:k], bias=x.mean if affine else None, method="leace" if whiten else "orth", eigenvalues=s, config={"tol": tol, "shrink": shrink})


def orth_eraser(cross: CrossMoments, **options) -> LinearMap:
    """Orthogonal removal of the span of the class means; needs no covariance of x."""
    return leace_eraser(cross, whiten=False, **options)


def capped_simplex(values: np.ndarray, rank: float) -> np.ndarray:
    """The nearest numbers between 0 and 1 that sum to ``rank``: clip(values - t) for the right t."""
    low, high = values.min() - 1.0, values.max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(values - mid, 0, 1).sum() > rank else (low, mid)
    return np.clip(values - (low + high) / 2, 0, 1)


def fantope(matrix: np.ndarray, rank: int) -> np.ndarray:
    """The nearest matrix with eigenvalues in [0, 1] and trace ``rank``."""
    values, vectors = np.linalg.eigh(symmetric(matrix))
    return (vectors * capped_simplex(values, rank)) @ vectors.T


def minimax_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, removal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows of a softmax predictor's gradients: by its weights, and by the projection that it sees the rows through."""
    z = x - x @ removal
    logits = z @ weights
    e = np.exp(logits - logits.max(1, keepdims=True))
    gap = e / e.sum(1, keepdims=True) - np.eye(weights.shape[1])[y]
    return z.T @ gap, x.T @ (gap @ weights.T)


def rlace_eraser(df: DataFrame, vector: str, label: str, *, rank: int = 1, rounds: int = 400, step: float = 0.05, seed: int = 0, affine: bool = True, keep_every: int = 50) -> LinearMap:
    """Adversarial erasure over all rows with a vector and a label.

    A softmax predictor descends its loss on projected vectors while the removal
    ascends it, put back into the Fantope after each step. A round is one pass: tasks
    sum both gradients, the driver gets one d x (classes + d) state of each merger.
    Every ``keep_every`` rounds the removal's leading directions are a candidate. All
    candidates are probed together (``operators/sgd.py``); that whose probe is nearest
    to chance is the map, the earliest of equals.
    """
    from eigenloom.operators import sgd
    from eigenloom.operators.moments import collect_moments
    from eigenloom.operators.probe import class_table
    from eigenloom.session import release

    names, classes = class_table(df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()), label)
    if len(names) < 2:
        raise ValueError("two classes are needed")
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("class"), V.vec(vector).alias("x")).join(F.broadcast(classes), "class")
    blocks = sgd.pack(rows.select(F.lit(-1).alias("fold"), F.lit(None).cast("string").alias("split"), F.col("class_no").cast("int").alias("y"), "x"))
    m = collect_moments(rows, "x")["default"]
    d, k = len(m.mean), len(names)
    bias = m.mean if affine else np.zeros(d)
    gap = m.mean - bias
    scale = np.sqrt(max((np.trace(m.m2) / m.n + gap @ gap) / d - gap.mean() ** 2, 0)) or 1.0
    n_parts = blocks.select(F.spark_partition_id().alias("p")).distinct().count()
    removal, weights, candidates = fantope(np.random.default_rng(seed).standard_normal((d, d)) * 0.01, rank), np.zeros((d, k)), []
    for at in range(max(rounds, 1)):
        by_weights, by_removal = sgd.summed_over(blocks, lambda x, y, w=weights, p=removal: minimax_sums((x - bias) / scale, y, w, p), [(d, k), (d, d)], n_parts)
        weights = weights - 20 * step * by_weights / m.n
        removal = fantope(removal - 20 * step * symmetric(by_removal / m.n), rank)
        if (at + 1) % keep_every == 0 or at + 1 == max(rounds, 1):
            values, vectors = np.linalg.eigh(removal)
            candidates.append(vectors[:, np.argsort(values)[::-1][:rank]])
    views = [sgd.scaled(None, np.eye(d) - u @ u.T, np.zeros(d), m.mean, m.m2, m.n) for u in candidates]
    fitted = sgd.fit_probes(blocks, views, k)
    scores = sgd.score_probes(blocks, [sgd.View(-1, v.matrix, v.offset) for v in views], fitted)
    best = min(range(len(candidates)), key=lambda c: abs(scores[c]["balanced_accuracy"] - 1 / k))
    release(blocks)
    u = candidates[best]
    return LinearMap(left=u, right=u.T, bias=bias if affine else None, method="rlace", config={"rank": rank})


def head_projection(df: DataFrame, vector: str, components: np.ndarray, rank: int, *, mode: str = "same_dim", normalise: bool = False) -> DataFrame:
    """Inference-head projection: without the first ``rank`` components, or the coordinates on the others (needs all)."""
    if mode == "same_dim":
        u = components[:rank]
        out = apply_map(df, vector, LinearMap(left=u.T, right=u))
    elif mode == "reduced":
        if len(components) < components.shape[1]:
            raise ValueError("reduced needs a full basis")
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in components[rank:]])
        out = df.withColumn(vector, F.transform(rows, lambda r: V.dot(r, vector)))
    else:
        raise ValueError(f"mode {mode!r}")
    return out.withColumn(vector, V.normalise(vector)) if normalise else out
