"""Image operators on arrays of pixels: per-image numpy inside Arrow batches, geometry and keys in Spark."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from eigenloom.functions import vectors as V
from eigenloom.session import join_checked, materialise

IO, BETA = 240.0, 0.15
#: sRGB to XYZ (D65) and its white point.
RGB_TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])


def optical_density(pixels: np.ndarray, io: float = IO) -> np.ndarray:
    return -np.log((pixels.reshape(-1, 3).astype(np.float64) + 1) / io)


def tissue_mask(pixels: np.ndarray, io: float = IO, beta: float = BETA) -> np.ndarray:
    """Pixels that are dense in every channel."""
    return (optical_density(pixels, io) >= beta).all(1)


def stain_matrix(pixels: np.ndarray, io: float = IO, alpha: float = 1.0, beta: float = BETA) -> np.ndarray:
    """Two stain rows (haematoxylin first) from the extreme angles in the plane of densest pixels."""
    od = optical_density(pixels, io)
    od = od[(od >= beta).all(1)]
    if len(od) < 2:
        raise ValueError("too little tissue")
    _, vectors = np.linalg.eigh(np.cov(od.T))
    plane = vectors[:, [2, 1]]
    plane = plane * np.where(plane[0] < 0, -1.0, 1.0)
    angles = np.arctan2(od @ plane[:, 1], od @ plane[:, 0])
    ends = [plane @ np.array([np.cos(a), np.sin(a)]) for a in np.percentile(angles, [alpha, 100 - alpha])]
    ends.sort(key=lambda v: -v[0])
    return np.stack([v / np.linalg.norm(v) for v in ends])


def concentrations(pixels: np.ndarray, stains: np.ndarray, io: float = IO) -> np.ndarray:
    """Least-squares amounts of both stains at every pixel, none negative."""
    od = np.maximum(optical_density(pixels, io), 0)
    return np.maximum(np.linalg.lstsq(stains.T, od.T, rcond=None)[0], 0)


def max_concentrations(pixels: np.ndarray, stains: np.ndarray, io: float = IO, beta: float = BETA) -> np.ndarray:
    """99th percentile of each stain over tissue."""
    return np.percentile(concentrations(pixels, stains, io)[:, tissue_mask(pixels, io, beta)], 99, axis=1)


def compose_pixels(amounts: np.ndarray, stains: np.ndarray, io: float = IO) -> np.ndarray:
    return np.clip(io * np.exp(-(stains.T @ amounts)).T, 0, 255).astype(np.uint8)


def normalise_stains(pixels: np.ndarray, stains: np.ndarray, reference: np.ndarray, reference_max: np.ndarray) -> np.ndarray:
    """Pixels with their stains' amounts scaled to a reference and shown in its colours."""
    amounts = concentrations(pixels, stains)
    scaled = amounts * (reference_max / np.maximum(max_concentrations(pixels, stains), 1e-6))[:, None]
    return compose_pixels(scaled, reference)


def restain(pixels: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Only the stain basis changes; amounts stay."""
    return compose_pixels(concentrations(pixels, source), target, 255.0)


def to_lab(pixels: np.ndarray) -> np.ndarray:
    c = pixels.reshape(-1, 3) / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ RGB_TO_XYZ.T / WHITE
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], 1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[:, 0] + 16) / 116
    f = np.stack([y + lab[:, 1] / 500, y, y - lab[:, 2] / 200], 1)
    xyz = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * WHITE
    linear = np.clip(xyz @ np.linalg.inv(RGB_TO_XYZ).T, 0, 1)
    return np.clip(np.rint(255 * np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)), 0, 255).astype(np.uint8)


def reinhard(pixels: np.ndarray, target_mean: np.ndarray, target_std: np.ndarray, mask: np.ndarray | None = None, eps: float = 1e-8) -> np.ndarray:
    """Mean and deviation of each Lab channel moved to a target's; statistics may be of a mask only."""
    lab = to_lab(pixels)
    seen = lab if mask is None or not mask.any() else lab[mask]
    return from_lab((lab - seen.mean(0)) / np.maximum(seen.std(0), eps) * target_std + target_mean)


AUGMENTATIONS: dict[str, Callable[..., np.ndarray]] = {
    "gamma": lambda p, g=1.2: np.rint(255 * (p / 255.0) ** g).astype(np.uint8),
    "brightness": lambda p, by=20: np.clip(p.astype(int) + by, 0, 255).astype(np.uint8),
    "contrast": lambda p, by=1.2: np.clip(np.rint((p - 127.5) * by + 127.5), 0, 255).astype(np.uint8),
    "saturation": lambda p, by=1.3: np.clip(np.rint(p.mean(-1, keepdims=True) + (p - p.mean(-1, keepdims=True)) * by), 0, 255).astype(np.uint8),
    "noise": lambda p, std=5.0, seed=0: np.clip(np.rint(p + np.random.default_rng(seed).normal(0, std, p.shape)), 0, 255).astype(np.uint8),
    "down_up": lambda p, by=2: np.repeat(np.repeat(p[::by, ::by], by, 0), by, 1)[: p.shape[0], : p.shape[1]],
    "blur": lambda p, radius=1: _box_blur(p, radius),
}


def _box_blur(p: np.ndarray, radius: int) -> np.ndarray:
    padded = np.pad(p.astype(np.float64), ((radius, radius), (radius, radius), (0, 0)), mode="edge")
    k = 2 * radius + 1
    return np.rint(sum(padded[i : i + p.shape[0], j : j + p.shape[1]] for i in range(k) for j in range(k)) / k**2).astype(np.uint8)


def augmentation(name: str, **options) -> Callable[[np.ndarray], np.ndarray]:
    """A registered image function with its options set."""
    if name not in AUGMENTATIONS:
        raise ValueError(f"augmentation {name!r}; one of {sorted(AUGMENTATIONS)}")
    return lambda p: AUGMENTATIONS[name](p, **options)


def map_pixels(df: DataFrame, function: Callable[[np.ndarray], np.ndarray], *, pixels: str = "pixels", height: str = "height", width: str = "width", output: str = "result") -> DataFrame:
    """``df`` with a function's values over its images (height x width x 3 in a flat array), flat; an image it fails on gives null."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def mapped(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for flat, h, w in batches:
            out = []
            for p, a, b in zip(flat, h, w, strict=True):
                try:
                    out.append(np.asarray(function(np.asarray(p, np.uint8).reshape(int(a), int(b), 3)), np.float64).ravel())
                except (ValueError, np.linalg.LinAlgError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return df.withColumn(output, mapped(pixels, height, width))


def dense_colours(df: DataFrame, keys: list[str]) -> DataFrame:
    """(at, k, m, x0, x1, x2): each colour dense in every channel, its pixels of a key counted, as optical densities.

    ``at`` is the key as text (nulls included), ``k`` as a struct. Counting comes
    first, so a key has 2 ** 24 rows at most, however many tiles it has.
    """
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size("pixels") / 3).cast("int") - 1), lambda i: F.slice("pixels", i * 3 + 1, F.lit(3)))
    k = F.struct(*keys)
    each = df.filter(F.size("pixels") >= 3).select(k.alias("k"), F.explode(triples).alias("p"))
    each = each.select(F.to_json("k", {"ignoreNullFields": "false"}).alias("at"), "k", *[F.get("p", F.lit(c)).alias(f"p{c}") for c in range(3)])
    counted = each.groupBy("at", "p0", "p1", "p2").agg(F.first("k").alias("k"), F.count("*").alias("m"))
    densities = [(-F.log((F.col(f"p{c}").cast("double") + 1) / F.lit(IO))).alias(f"x{c}") for c in range(3)]
    dense = counted.select("at", "k", "m", *densities).filter(" AND ".join(f"x{c} >= {BETA}" for c in range(3)))
    return materialise(dense, "dense-colours")


def _planes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The two main axes of each key's densities, from its sums."""
    for batch in batches:
        out = []
        for r in batch.to_dict("records"):
            mean = np.array([r[f"s{i}"] for i in range(3)]) / r["n"]
            second = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]) / r["n"]
            plane = np.linalg.eigh(second - np.outer(mean, mean))[1][:, [2, 1]]
            plane = plane * np.where(plane[0] < 0, -1.0, 1.0)
            out.append((r["at"], r["n"], *plane[:, 0], *plane[:, 1]))
        yield pd.DataFrame(out, columns=["at", "n", "u0", "u1", "u2", "v0", "v1", "v2"])


def pooled_stain_matrices(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, matrix): stain matrix of all tiles of a slide and scanner, from their pooled density moments and angles.

    Angles need the plane of all pixels first, so there are two passes over the
    counted colours: sums by key, then exact angle percentiles by key.
    """
    pixels = dense_colours(df, keys)
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = pixels.groupBy("at").agg(
        F.sum("m").alias("n"),
        *[F.sum(F.col("m") * F.col(f"x{i}")).alias(f"s{i}") for i in range(3)],
        *[F.sum(F.col("m") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in pairs],
    )
    axes = ", ".join(f"{a}{c} double" for a in "uv" for c in range(3))
    planes = materialise(sums.filter("n > 1").mapInPandas(_planes, f"at string, n long, {axes}"), "stain-planes")
    onto = lambda a: sum((F.col(f"{a}{c}") * F.col(f"x{c}") for c in range(3)), F.lit(0.0))
    angles = join_checked(pixels, planes, "at").withColumn("angle", F.atan2(onto("v"), onto("u")))
    plane = [f"{a}{c}" for a in "uv" for c in range(3)]
    ends = angles.groupBy("at", "n", *plane).agg(F.first("k").alias("k"), F.percentile("angle", F.array(F.lit(0.01), F.lit(0.99)), F.col("m")).alias("a"))

    def row(end: int):
        angle = F.get("a", F.lit(end))
        return V.normalise(F.array(*[F.col(f"u{c}") * F.cos(angle) + F.col(f"v{c}") * F.sin(angle) for c in range(3)]), 0.0)

    both = ends.select("k", "n", row(0).alias("r0"), row(1).alias("r1"))
    return both.select("k.*", "n", F.when(F.get("r0", F.lit(0)) >= F.get("r1", F.lit(0)), F.array("r0", "r1")).otherwise(F.array("r1", "r0")).alias("matrix"))


#: Usual absorbances of haematoxylin and eosin, where sparse estimates start.
USUAL_STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11))


def sparse_stain_matrices(df: DataFrame, keys: list[str], *, rounds: int = 30, penalty: float = 0.1) -> DataFrame:
    """(keys, n, matrix): stain rows of non-negative sparse factors (OD = amounts x stains) over all tiles of a slide and scanner.

    Every round is one pass over the counted colours: a colour's two amounts have a closed form (both, or
    the better one alone, or none), and the next stains need only sums of amounts
    times amounts and amounts times densities, so a key's pixels are never in one place.
    """
    pixels = dense_colours(df, keys)
    row = lambda v: [float(x) for x in np.array(v) / np.linalg.norm(v)]
    stains = pixels.groupBy("at").agg(F.first("k").alias("k"), F.sum("m").alias("n"))
    stains = stains.select("at", "k", "n", *[F.lit(x).alias(f"w{r}{c}") for r in range(2) for c, x in enumerate(row(USUAL_STAINS[r]))])
    sums = [(f"a{i}{j}", F.col(f"c{i}") * F.col(f"c{j}")) for i, j in ((0, 0), (0, 1), (1, 1))] + [(f"b{i}{c}", F.col(f"c{i}") * F.col(f"x{c}")) for i in range(2) for c in range(3)]
    for _ in range(rounds):
        stains = materialise(stains, "stain-matrices")
        fit = lambda r: sum((F.col(f"w{r}{c}") * F.col(f"x{c}") for c in range(3)), F.lit(0.0)) - penalty
        seen = join_checked(pixels.drop("k"), stains, "at").withColumns({"g": sum((F.col(f"w0{c}") * F.col(f"w1{c}") for c in range(3)), F.lit(0.0)), "f0": fit(0), "f1": fit(1)})
        rest = F.greatest(1 - F.col("g") * F.col("g"), F.lit(1e-9))
        both = [(F.col(f"f{i}") - F.col("g") * F.col(f"f{1 - i}")) / rest for i in range(2)]
        alone = [F.when(F.col(f"f{i}") >= F.col(f"f{1 - i}"), F.greatest(F.col(f"f{i}"), F.lit(0.0))).otherwise(0.0) for i in range(2)]
        amounts = {f"c{i}": F.when((both[0] >= 0) & (both[1] >= 0), both[i]).otherwise(alone[i]) for i in range(2)}
        stats = seen.withColumns(amounts).groupBy("at").agg(*[F.sum(F.col("m") * v).alias(name) for name, v in sums])
        moved = stains.join(stats, "at")
        for i in range(2):  # one row of stains after the other, the second with the first's new values
            own, cross = F.greatest(F.col(f"a{i}{i}"), F.lit(1e-9)), F.col("a01")
            moved = moved.withColumns({f"w{i}{c}": F.greatest(F.lit(0.0), (F.col(f"b{i}{c}") - cross * F.col(f"w{1 - i}{c}")) / own) for c in range(3)})
            length = F.sqrt(sum((F.col(f"w{i}{c}") ** 2 for c in range(3)), F.lit(0.0)))
            moved = moved.withColumns({f"w{i}{c}": F.when(length > 0, F.col(f"w{i}{c}") / length).otherwise(F.lit(row(USUAL_STAINS[i])[c])) for c in range(3)})
        stains = moved.select(*stains.columns)
    rows = [F.array(*[F.col(f"w{r}{c}") for c in range(3)]) for r in range(2)]
    matrix = F.when(F.col("w00") >= F.col("w10"), F.array(*rows)).otherwise(F.array(*rows[::-1]))
    return stains.select("k.*", "n", matrix.alias("matrix"))


def tile_grid(df: DataFrame, tile: int, *, height: str = "height", width: str = "width", keys: list[str] = ("image_id",)) -> DataFrame:
    """(keys, tile_row, tile_col, top, left): tiles of the centre crop to a multiple of the tile size."""
    rows, cols = F.floor(F.col(height) / tile).cast("int"), F.floor(F.col(width) / tile).cast("int")
    top, left = F.floor((F.col(height) - rows * tile) / 2).cast("int"), F.floor((F.col(width) - cols * tile) / 2).cast("int")
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    one = df.select(*keys, top.alias("top0"), left.alias("left0"), cols.alias("cols"), F.explode(up_to(rows)).alias("tile_row"))
    two = one.select(*keys, "top0", "left0", "tile_row", F.explode(up_to(F.col("cols"))).alias("tile_col"))
    return two.select(*keys, "tile_row", "tile_col", (F.col("top0") + F.col("tile_row") * tile).alias("top"), (F.col("left0") + F.col("tile_col") * tile).alias("left"))


def window_origins(size, tile: int, stride: int):
    """Starts of windows along one side; the last is moved back to end with the image."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(size - tile, F.lit(0)) / stride).cast("int")), lambda k: F.least(k * stride, F.greatest(size - tile, F.lit(0))))
    return F.array_distinct(steps)


def sliding_windows(df: DataFrame, tile: int, stride: int, *, height: str = "height", width: str = "width", keys: list[str] = ("image_id",)) -> DataFrame:
    """(keys, top, left) of overlapping windows."""
    one = df.select(*keys, F.col(width).alias("_w"), F.explode(window_origins(F.col(height), tile, stride)).alias("top"))
    return one.select(*keys, "top", F.explode(window_origins(F.col("_w"), tile, stride)).alias("left"))


def stitch(cells: DataFrame, tile: int, *, keys: list[str] = ("image_id",), weighting: str = "average") -> DataFrame:
    """(keys, y, x, value) from windows' cells (keys, top, left, dy, dx, value): average or Hann-weighted overlap."""
    hann = lambda c: F.sin((F.col(c) + 0.5) * F.lit(np.pi / tile)) ** 2
    weight = F.lit(1.0) if weighting == "average" else hann("dy") * hann("dx")
    placed = cells.select(*keys, (F.col("top") + F.col("dy")).alias("y"), (F.col("left") + F.col("dx")).alias("x"), "value", weight.alias("w"))
    return placed.groupBy(*keys, "y", "x").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))


def encode_images(df: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], *, pixels: str = "pixels", output: str = "embedding") -> DataFrame:
    """``df`` with vectors from a batch encoder (n x pixels to n x d); which encoder is the caller's choice."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(encoder(np.stack(batch.to_numpy())), np.float64)), dtype=object) if len(batch) else batch

    return df.withColumn(output, encoded(pixels))
