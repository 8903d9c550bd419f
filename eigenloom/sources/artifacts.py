"""Maps and subspaces as Parquet tables, one row a component."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from eigenloom.operators.erasers import LinearMap
from eigenloom.operators.geometry import Subspace

_MAP = "stage_index int, method string, matrix array<array<double>>, proj_left array<array<double>>, proj_right array<array<double>>, bias array<double>, eigenvalues array<double>, metadata string"
_SPACE = "components array<array<double>>, explained_variance_ratio array<double>, mean array<double>, metadata string"


def _list(a: np.ndarray | None):
    return None if a is None else np.asarray(a, float).tolist()


def save_maps(spark: SparkSession, path: str, maps: LinearMap | list[LinearMap], metadata: dict | None = None) -> None:
    """An eraser, or a chain in order; the matrix is stored only where there are no factors."""
    chain = maps if isinstance(maps, list) else [maps]
    rows = [
        (k, m.method, None if m.left is not None else _list(m.matrix), _list(m.left), _list(m.right), _list(m.bias), _list(m.eigenvalues), json.dumps((metadata or {}) | {"config": m.config, "dim": m.dim}, sort_keys=True))
        for k, m in enumerate(chain)
    ]
    spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("overwrite").parquet(path)


def load_maps(spark: SparkSession, path: str) -> list[LinearMap]:
    """The chain, checked: indices count from 0, shapes fit, dimensions agree; a stored matrix wins over factors."""
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.stage_index)
    if [r.stage_index for r in rows] != list(range(len(rows))):
        raise ValueError("components are not numbered from 0")
    array = lambda v: None if v is None else np.array(v, float)
    maps = []
    for r in rows:
        d = json.loads(r.metadata)["dim"]
        left, right = (array(v).reshape(shape) if v is not None else None for v, shape in ((r.proj_left, (d, -1)), (r.proj_right, (-1, d))) if True)
        matrix = array(r.matrix)
        maps.append(LinearMap(matrix=matrix, left=None if matrix is not None else left, right=None if matrix is not None else right, bias=array(r.bias), method=r.method, eigenvalues=array(r.eigenvalues), config=json.loads(r.metadata)["config"]))
    if len({m.dim for m in maps}) > 1:
        raise ValueError("the components' dimensions differ")
    return maps


def save_subspace(spark: SparkSession, path: str, space: Subspace, metadata: dict | None = None) -> None:
    row = (_list(space.components), _list(space.explained_variance_ratio), _list(space.mean), json.dumps(metadata or {}, sort_keys=True))
    spark.createDataFrame([row], _SPACE).coalesce(1).write.mode("overwrite").parquet(path)


def load_subspace(spark: SparkSession, path: str) -> tuple[Subspace, dict]:
    r = spark.read.parquet(path).first()
    return Subspace(np.array(r.components), np.array(r.explained_variance_ratio), np.array(r.mean)), json.loads(r.metadata)


def rows_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Result rows of the driver as a table; lists become JSON, missing fields null."""
    names = list(dict.fromkeys(k for r in rows for k in r))

    def kind(k: str) -> str:
        values = [r[k] for r in rows if r.get(k) is not None]
        if values and all(isinstance(v, bool) for v in values):
            return "boolean"
        if values and all(isinstance(v, int) for v in values):
            return "long"
        return "double" if values and all(isinstance(v, int | float) for v in values) else "string"

    kinds = {k: kind(k) for k in names}

    def cell(v, k):
        if v is None:
            return None
        if kinds[k] == "double":
            return float(v)
        return v if kinds[k] != "string" or isinstance(v, str) else json.dumps(v)

    return spark.createDataFrame([tuple(cell(r.get(k), k) for k in names) for r in rows], ", ".join(f"`{k}` {t}" for k, t in kinds.items()))
