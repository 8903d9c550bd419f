"""Operator 11: clustering around centroids by exponion search.

Vectors of integers stand in blocks, a row of the block table each, with their
centroid and two bounds: an upper one of the distance to it and a lower one of the
distance to any other. A round moves the bounds by how far centroids moved. A vector
whose upper bound is under its lower one, or under half the way from its centroid to
the next, keeps its centroid unseen. For the others the upper bound is made exact; who
still fails scans the centroids within a ball around its own, of twice its distance
plus the way to the next centroid: prefixes of lists of centroids by their distance
from each other. The ball holds the nearest two of a vector, and is closed, so ties are
seen; they go to the smaller number. Distances that decide are integers and exact;
bounds are widened by ``SLACK`` against rounding.

A round reads the block table, writes the next one with sums and counts of each
block's clusters beside the vectors, and adds these up; only the sums of each cluster
come to the driver, a bounded number. Every round's table is in the shared folder, so
a lost executor costs a task.

Defined results
    vectors that are null, of another length, or hold a null, NaN or infinity are left
    out; components beyond ``LARGEST`` in size are an error, for their distances pass
    64 bits; null ids are clustered, and hashed as an empty id; repeated ids each count,
    ties of their hash go by the vector; fewer vectors than centroids: as many
    centroids; equal centroids: the smaller number takes their vectors, the other
    stays; other columns are not read; empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StructField, StructType

from eigenloom.session import materialise, release, shuffles_dropped

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
#: A component is floor(SCALE * x).
SCALE = 1024
SEED = 3
#: Components may be this large; squared distances then fit 64 bits.
LARGEST = 1 << 28
#: Bounds are widened by this share.
SLACK = 1e-9


class _Search(NamedTuple):
    """Centroids, how far each moved, and lists of all by their distance from each."""

    centroids: np.ndarray
    moved: np.ndarray
    near: np.ndarray  # centroids by distance from each, itself first
    apart: np.ndarray  # those distances


def _search(centroids: np.ndarray, before: np.ndarray | None) -> _Search:
    moved = np.zeros(len(centroids)) if before is None else _root(_squares(centroids, before)) * (1 + SLACK)
    apart = np.stack([_root(_squares(centroids, c)) for c in centroids])
    near = np.argsort(apart + 0.0, axis=1, kind="stable")
    return _Search(centroids, moved, near, np.take_along_axis(apart, near, axis=1))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _assign(vectors: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, s: _Search) -> int:
    """Bring centroids and bounds up to date, in place; the number of distances computed.

    A negative ``own`` has no centroid yet.
    """
    k, seen = len(s.centroids), 0
    new = np.flatnonzero(own < 0)
    own[new], upper[new], lower[new] = 0, np.inf, 0
    upper += s.moved[own]
    if k > 1:
        farthest = np.argsort(-s.moved, kind="stable")[:2]
        lower -= np.where(own == farthest[0], s.moved[farthest[1]], s.moved[farthest[0]])  # of any centroid but its own
    gap = s.apart[:, 1] * (1 - SLACK) if k > 1 else np.full(k, np.inf)  # to the next centroid
    keep = lambda at: upper[at] < np.maximum(lower[at], gap[own[at]] / 2)
    todo = np.flatnonzero(~keep(slice(None)))
    exact = _squares(vectors[todo], s.centroids[own[todo]])
    upper[todo] = _root(exact) * (1 + SLACK)
    seen += len(todo)
    open_ = ~keep(todo)
    todo, exact = todo[open_], exact[open_]
    was = own[todo]
    for c in np.unique(was):
        at = np.flatnonzero(was == c)
        rows = todo[at]
        radius = (2 * upper[rows] + s.apart[c, min(1, k - 1)]) * (1 + SLACK)
        best, number = exact[at].copy(), np.full(len(at), c)
        second = np.full(len(at), np.inf)
        for j, apart in zip(s.near[c].tolist(), s.apart[c].tolist(), strict=True):
            if j == c:
                continue
            inside = np.flatnonzero(apart <= radius)
            if not len(inside):
                break
            seen += len(inside)
            d = _squares(vectors[rows[inside]], s.centroids[j])
            wins = (d < best[inside]) | ((d == best[inside]) & (j < number[inside]))
            second[inside] = np.minimum(second[inside], np.where(wins, best[inside], d))
            won = inside[wins]
            best[won], number[won] = d[wins], j
        own[rows] = number
        upper[rows] = _root(best) * (1 + SLACK)
        lower[rows] = np.sqrt(second) * (1 - SLACK)
    return seen


def _packed(vectors: np.ndarray) -> tuple[int, bytes]:
    """(bytes a component, components) in the narrowest integers."""
    most = int(np.abs(vectors).max()) if vectors.size else 0
    if most > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST}")
    kind = np.dtype("<i2") if most < 1 << 15 else np.dtype("<i4")
    return kind.itemsize, vectors.astype(kind).tobytes()


def _block_schema(id_type: DataType) -> StructType:
    sums = ArrayType(StructType([StructField("cluster", IntegerType()), StructField("n", LongType()), StructField("sums", ArrayType(LongType()))]))
    fields = [("ids", ArrayType(id_type)), ("width", IntegerType()), ("vectors", BinaryType()), ("own", BinaryType()), ("upper", BinaryType()), ("lower", BinaryType()), ("seen", LongType()), ("sums", sums)]
    return StructType([StructField(n, t) for n, t in fields])


def _sums(vectors: np.ndarray, own: np.ndarray) -> list[dict]:
    return [{"cluster": int(c), "n": int((own == c).sum()), "sums": vectors[own == c].sum(axis=0).tolist()} for c in np.unique(own)]


def _rounds(search: _Search, dimensions: int):
    """A round over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                vectors, own, upper, lower = _unpacked(one, dimensions)
                seen = _assign(vectors, own, upper, lower, search)
                yield _block(one.column("ids"), one.column("width")[0].as_py(), one.column("vectors")[0].as_py(), own, upper, lower, seen, _sums(vectors, own))

    return run


def _block(ids: pa.Array, width: int, vectors: bytes, own, upper, lower, seen: int, sums: list[dict]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
    columns = [pa.array([width], pa.int32()), *(pa.array([x], pa.binary()) for x in (vectors, own.tobytes(), upper.tobytes(), lower.tobytes())), pa.array([seen], pa.int64()), pa.array([sums], kind)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["ids", "width", "vectors", "own", "upper", "lower", "seen", "sums"])


def _unpacked(one: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, ...]:
    get = lambda c: one.column(c)[0].as_py()
    vectors = np.frombuffer(get("vectors"), f"<i{get('width')}").reshape(-1, dimensions).astype(np.int64)
    return vectors, np.frombuffer(get("own"), np.int32).copy(), np.frombuffer(get("upper")).copy(), np.frombuffer(get("lower")).copy()


def _blocks(dimensions: int):
    """Blocks of rows (id, vector), without centroids yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if n:
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("id"))
                vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, dimensions)
                width, packed = _packed(vectors)
                yield _block(ids, width, packed, np.full(n, -1, np.int32), np.zeros(n), np.zeros(n), 0, [])

    return run


def _members(centroids: np.ndarray, dimensions: int):
    """(id, cluster, distance) of every vector of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                vectors, own, _, _ = _unpacked(one, dimensions)
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), pa.array(own), pa.array(_squares(vectors, centroids[own]))], names=["id", "cluster", "distance"])

    return run


def clusters(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(members, centroids): (id, cluster, distance) of every kept vector, and (cluster, centroid, n, inertia).

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:id``.
    ``distance`` and ``inertia`` are of squares.
    """
    spark = table.sparkSession
    raw = F.col(f"`{vector_col}`")
    sound = raw.isNotNull() & (F.size(raw) == dimensions) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    ids = F.col(f"`{id_col}`").alias("id")
    vectors = table.filter(sound).select(ids, F.transform(raw, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = vectors.select("vector", digest.alias("digest")).orderBy("digest", "vector").limit(k).collect()
    id_type = vectors.schema["id"].dataType
    schema = _block_schema(id_type)
    used = []
    with shuffles_dropped(spark):
        blocks = materialise(vectors.mapInArrow(_blocks(dimensions), schema), "clusters-blocks")
        centroids = np.array([r.vector for r in start], np.int64).reshape(-1, dimensions)
        before = None
        for step in range(rounds + 1 if len(centroids) else 0):
            after = materialise(blocks.mapInArrow(_rounds(_search(centroids, before), dimensions), schema), "clusters-blocks")
            release(blocks)
            blocks, before = after, centroids
            if step < rounds:
                centroids = _means(blocks, centroids)
        members = materialise(blocks.mapInArrow(_members(centroids, dimensions), StructType([StructField("id", id_type), StructField("cluster", IntegerType()), StructField("distance", LongType())])), "clusters-members")
        used.append(blocks)
        sizes = {r.cluster: r for r in members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")).collect()}
    for t in used:
        release(t)
    rows = [(c, [int(x) for x in v], sizes[c].n if c in sizes else 0, sizes[c].inertia if c in sizes else 0) for c, v in enumerate(centroids)]
    return members, spark.createDataFrame(rows, "cluster int, centroid array<bigint>, n bigint, inertia bigint")


def _means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of every cluster; an empty one stays. A row a cluster comes to the driver."""
    parts = blocks.select(F.explode("sums").alias("x")).select("x.cluster", "x.n", F.posexplode("x.sums").alias("at", "v"))
    summed = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    by_cluster = summed.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "v"))).alias("sums"))
    out = centroids.copy()
    for r in by_cluster.collect():
        out[r.cluster] = [int(x.v) // r.n for x in r.sums]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    """Lower-case sha256 of a centroid's components, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
