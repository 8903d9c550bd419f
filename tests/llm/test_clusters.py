import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from eigenloom.llm import clusters


def slow_clusters(rows, k, rounds, dimensions):
    """Every distance of every round, in Python's integers."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=str), centroids


def result(table, **options):
    members, centroids = clusters.clusters(table, **options)
    return sorted(((r.id, r.cluster, r.distance) for r in members.collect()), key=str), [list(r.centroid) for r in centroids.orderBy("cluster").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def test_against_every_distance(spark):
    rng = random.Random(1)
    centres = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], 0) for k in range(300)]
    for k in (1, 2, 8):
        assert result(frame(spark, rows), k=k, rounds=6, dimensions=4) == slow_clusters([r[:2] for r in rows], k, 6, 4)


def test_ties_copies_and_odd_rows(spark):
    rng = random.Random(2)
    grid = [(k, [rng.randint(-2, 2) / 64 for _ in range(3)], 0) for k in range(200)]  # many ties, equal centroids
    odd = [(None, [0.0, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (5, [0.5, 0.5, 0.5], 0), (500, None, 0), (501, [1.0, None, 0.0], 0), (502, [1.0, float("nan"), 0.0], 0), (503, [float("inf"), 1.0, 0.0], 0), (504, [1.0], 0), (505, [], 0)]
    rows = grid + odd + [(600 + k, [0.25, 0.25, 0.25], 0) for k in range(90)]
    assert result(frame(spark, rows), k=8, rounds=7, dimensions=3) == slow_clusters([r[:2] for r in rows], 8, 7, 3)
    few = [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, [1.0, 0.0], 0)]
    assert result(frame(spark, few), k=8, rounds=3, dimensions=2) == slow_clusters([r[:2] for r in few], 8, 3, 2)
    assert result(frame(spark, []), k=8, rounds=3, dimensions=2) == ([], [])
    with pytest.raises(Exception, match="larger than"):
        result(frame(spark, [(1, [1e6, 0.0], 0)]), k=1, rounds=1, dimensions=2)


def test_bounds_spare_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (40, 8))
    vectors = centres[rng.integers(0, 40, 4000)] + rng.integers(-300, 300, (4000, 8))
    own, upper, lower = np.full(4000, -1, np.int32), np.zeros(4000), np.zeros(4000)
    centroids, before, seen = centres + rng.integers(-90, 90, centres.shape), None, []
    for _ in range(6):
        seen.append(clusters._assign(vectors, own, upper, lower, clusters._search(centroids, before)))
        gaps = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
        assert (own == gaps.argmin(axis=1)).all()
        assert (upper >= np.sqrt(gaps.min(axis=1))).all() and (lower <= np.sqrt(np.sort(gaps, axis=1)[:, 1])).all()
        before, centroids = centroids, np.stack([vectors[own == j].sum(axis=0) // max(1, (own == j).sum()) for j in range(40)])
    assert seen[0] < 4000 * 40 and max(seen[3:]) < 4000  # fewer than one distance a vector, of 40


def test_blocks_keep_narrow_integers():
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "vector": [[1, -2], [3, 40_000]]})
    (block,) = clusters._blocks(2)(iter([batch]))
    vectors, own, _, _ = clusters._unpacked(block, 2)
    assert vectors.tolist() == [[1, -2], [3, 40_000]] and own.tolist() == [-1, -1] and block.column("width")[0].as_py() == 4
