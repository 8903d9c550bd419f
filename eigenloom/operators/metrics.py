"""What erasure changes: rows before and after, residual energy, spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenloom.functions import vectors as V
from eigenloom.operators.erasers import LinearMap
from eigenloom.operators.moments import Moments, SourceSpec, joint_moment, matched, normalised, symmetric, whitening


def feature_change(df: DataFrame, raw: str, projected: str, keys: list[str] = ()) -> DataFrame:
    """Norms of change; ``mean_relative_change`` is the mean of row ratios, ``ratio_of_mean_norms`` the ratio of means."""
    rows = df.select(*keys, V.norm(V.subtract(projected, raw)).alias("change"), V.norm(raw).alias("before"), V.norm(projected).alias("after"))
    median = lambda c: F.percentile(c, F.lit(0.5))
    return rows.groupBy(*keys).agg(
        F.avg("change").alias("mean_change"),
        median("change").alias("median_change"),
        F.avg("before").alias("mean_raw_norm"),
        median("before").alias("median_raw_norm"),
        F.avg("after").alias("mean_projected_norm"),
        median("after").alias("median_projected_norm"),
        F.avg(F.col("change") / (F.col("before") + V.EPS)).alias("mean_relative_change"),
        (F.avg("change") / (F.avg("before") + V.EPS)).alias("ratio_of_mean_norms"),
    )


def delta_change(df: DataFrame, raw: str, projected: str, keys: list[str] = ()) -> DataFrame:
    """Remaining energy (with a small constant) and residual ratio (null for nothing), and norm ratios."""
    rows = df.select(*keys, V.squared_norm(raw).alias("a"), V.squared_norm(projected).alias("b"))
    ratio = F.sqrt("b") / (F.sqrt("a") + F.lit(1e-12))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.avg("b") / (F.avg("a") + F.lit(1e-12))).alias("remaining_energy"),
        V.guarded_ratio(F.avg("b"), F.avg("a")).alias("residual_ratio"),
        (1 - V.guarded_ratio(F.avg("b"), F.avg("a"))).alias("removed_fraction"),
        F.avg(ratio).alias("mean_norm_ratio"),
        F.percentile(ratio, F.lit(0.5)).alias("median_norm_ratio"),
    )


def variance_by_dimension(df: DataFrame, vector: str) -> DataFrame:
    """(i, variance): sample variance of every dimension; their sum is the covariance's trace."""
    return df.agg(V.variance_of(vector).alias("v")).select(F.posexplode("v").alias("i", "variance"))


def feature_variance(df: DataFrame, raw: str, projected: str, reference_trace: float) -> DataFrame:
    """Mean squared change and traces after, against a reference trace."""
    one = df.agg(F.avg(V.squared_norm(V.subtract(projected, raw))).alias("mean_squared_change"), V.total(V.variance_of(projected)).alias("projected_trace"))
    ref = F.lit(float(reference_trace))
    return one.select("*", V.guarded_ratio(F.col("mean_squared_change"), ref).alias("change_over_trace"), V.guarded_ratio(F.col("projected_trace"), ref).alias("trace_ratio"))


def residual_from_moments(delta: Moments, linear: LinearMap, trace_a: float | None = None) -> dict[str, float | None]:
    """Residual energy of a delta source under a map, from its second moment: no rows are read."""
    before, after = np.trace(delta.second_moment()), np.trace(delta.mapped(linear.dense()).second_moment())
    ratio = lambda a, b: float(a / b) if b is not None and abs(b) > 1e-12 else None
    kept = ratio(after, before)
    return {"residual_ratio": kept, "removed_fraction": None if kept is None else 1 - kept, "raw_energy": float(before), "projected_energy": float(after), "raw_over_trace": ratio(before, trace_a), "projected_over_trace": ratio(after, trace_a)}


def probe_excess_ratio(raw: Column, projected: Column, chance: Column) -> Column:
    """(projected - chance) / (raw - chance), null where the raw probe is at chance."""
    return V.guarded_ratio(projected - chance, raw - chance)


def spectrum(values: np.ndarray, top_k: int = 0, tolerances=(1e-3, 1e-6)) -> dict:
    """Trace, largest, effective ranks and the ranks that explain given shares of a spectrum."""
    v = np.sort(np.maximum(np.asarray(values, float), 0))[::-1]
    total = v.sum()
    p = v / total if total > 0 else v
    cumulative = np.cumsum(p)
    positive = p[p > 0]
    out = {"trace": float(total), "max": float(v[0]), "top1_fraction": float(p[0]) if total > 0 else None}
    out |= {f"rank_at_1e{int(np.log10(t))}": int((v > t * v[0]).sum()) for t in tolerances}
    out |= {"entropy_rank": float(np.exp(-(positive * np.log(positive)).sum())) if total > 0 else None, "participation_rank": float(total**2 / (v**2).sum()) if total > 0 else None}
    out |= {f"rank{q}": int(np.searchsorted(cumulative, q / 100 - 1e-12) + 1) if total > 0 else None for q in (50, 80, 90, 95, 99)}
    return out | ({"top": v[:top_k].tolist()} if top_k else {})


def moment_row(matrix: np.ndarray, with_spectrum: bool = False, top_k: int = 32) -> dict:
    out = {"trace": float(np.trace(matrix)), "frobenius": float(np.linalg.norm(matrix))}
    return out | ({f"spectrum_{k}": v for k, v in spectrum(np.linalg.eigvalsh(symmetric(matrix)), top_k).items()} if with_spectrum else {})


def attenuation(values: np.ndarray, lam: float) -> dict:
    """Summary of 1 / (1 + lambda mu) over generalised eigenvalues mu."""
    a = 1 / (1 + lam * np.asarray(values, float))
    return {"min": float(a.min()), "median": float(np.median(a)), "mean": float(a.mean())} | {f"below_{int(100 * t)}": int((a < t).sum()) for t in (0.9, 0.5, 0.1)}


def joint_diagnostics(x: Moments, sources: dict[str, Moments], specs: list[SourceSpec], linear: LinearMap | None = None, *, joint: str = "none", shrink_a: bool = True, ridge: float = 1e-4, tol: float = 1e-7, with_spectrum: bool = True) -> list[dict]:
    """Rows (kind, source, ...) for A and B before and after a map, each source, and the generalised spectrum."""
    a = x.covariance(shrink_a)
    b = matched(joint_moment(sources, specs), a, joint)
    rows = [{"kind": "A", "source": None} | moment_row(a, with_spectrum), {"kind": "B", "source": None} | moment_row(b, with_spectrum)]
    for s in specs:
        raw = s.matrix(sources)
        rows += [{"kind": "source_raw", "source": s.name} | moment_row(raw, with_spectrum), {"kind": "source_normalised", "source": s.name} | moment_row(normalised(raw, s.normalization), with_spectrum)]
    _, inverse = whitening(a, ridge, tol)
    rows.append({"kind": "generalised", "source": None} | moment_row(inverse @ b @ inverse, with_spectrum))
    if linear is not None:
        p = linear.dense()
        rows += [{"kind": "A_after", "source": None} | moment_row(p @ a @ p.T, with_spectrum), {"kind": "B_after", "source": None} | moment_row(p @ b @ p.T, with_spectrum)]
    return rows


def eraser_diagnostics(linear: LinearMap) -> dict:
    """How far a map is from the identity, and the rank of what it takes."""
    taken = np.eye(linear.dim) - linear.dense()
    s = np.linalg.svd(taken, compute_uv=False)
    return {"relative_change": float(np.linalg.norm(taken) / np.sqrt(linear.dim)), "singular_values": s.tolist(), "rank_1e-4": int((s > 1e-4).sum()), "rank_1e-5": int((s > 1e-5).sum())}


def image_error(df: DataFrame, a: str, b: str, mask: str | None = None) -> DataFrame:
    """``df`` with ``mae`` and ``rmse`` of two flat pixel arrays, over all or over the pixels of a 0/1 mask (null if none)."""
    gaps = F.zip_with(V.vec(a), V.vec(b), lambda x, y: x - y)
    if mask:
        gaps = F.transform(F.filter(F.arrays_zip(gaps.alias("g"), F.col(mask).alias("m")), lambda p: p["m"] == 1), lambda p: p["g"])
    n = F.nullif(F.size(gaps), F.lit(0)).cast("double")
    return df.withColumn("mae", V.total(F.transform(gaps, lambda g: F.abs(g))) / n).withColumn("rmse", F.sqrt(V.squared_norm(gaps) / n))
