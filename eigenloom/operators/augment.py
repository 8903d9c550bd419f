"""Image augmentations by name: fixed ones, seeded random ones, stain jitter.

All are functions of an image (height x width x 3, bytes) for ``images.map_pixels``
and ``deltas.augmentation_deltas``. A random one draws from its seed and a digest
of the image, so it gives the same for any partitioning and any retry.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.operators import images as I

Image = np.ndarray
Augmentation = Callable[[Image], Image]


def as_bytes(x: np.ndarray) -> Image:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


# Filters


def _along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sum of shifted copies along one axis; borders are mirrored."""
    r = len(kernel) // 2
    padded = np.pad(x, [(r, r) if k == axis else (0, 0) for k in range(x.ndim)], mode="reflect")
    n = x.shape[axis]
    return sum(w * np.take(padded, range(k, k + n), axis) for k, w in enumerate(kernel))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    at = np.arange(-max(1, round(3 * sigma)), max(1, round(3 * sigma)) + 1)
    kernel = np.exp(-0.5 * (at / sigma) ** 2)
    kernel /= kernel.sum()
    return _along(_along(x.astype(np.float64), kernel, 0), kernel, 1)


def _area(n: int, m: int) -> np.ndarray:
    """m x n weights: what share of each of m wide cells the n narrow ones have."""
    edges = np.arange(m + 1) * n / m
    overlap = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
    return np.maximum(overlap, 0) * m / n


def _linear(n: int, m: int) -> np.ndarray:
    """m x n weights of linear interpolation between cell centres."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(n)))


def down_up(x: np.ndarray, scale: float) -> np.ndarray:
    """One channel shrunk by area and enlarged linearly."""
    (h, w), (a, b) = x.shape, (max(1, round(k * scale)) for k in x.shape)
    return _linear(a, h) @ _area(h, a) @ x @ _area(w, b).T @ _linear(b, w).T


def nearest_down_up(p: Image, scale: float) -> Image:
    def places(n: int) -> np.ndarray:
        m = max(1, int(n * scale))
        return (2 * ((2 * np.arange(n) + 1) * m // (2 * n)) + 1) * n // (2 * m)

    return p[places(p.shape[0])][:, places(p.shape[1])]


def on_lightness(p: Image, change: Callable[[np.ndarray], np.ndarray]) -> Image:
    """Change the L channel of Lab only."""
    lab = I.to_lab(p)
    lab[:, 0] = np.clip(change(lab[:, 0].reshape(p.shape[:2])), 0, 100).ravel()
    return I.from_lab(lab).reshape(p.shape)


# Colours


def shift_hsv(p: Image, hue: float = 0, saturation: float = 0, value: float = 0) -> Image:
    """Hue in half degrees (180 is a full turn), saturation and value in bytes."""
    x = p / 255.0
    top, low = x.max(-1), x.min(-1)
    spread = np.where(top > low, top - low, 1)
    r, g, b = np.moveaxis(x, -1, 0)
    sixth = np.select([top == low, top == r, top == g], [0 * r, (g - b) / spread, 2 + (b - r) / spread], 4 + (r - g) / spread)
    sixth = (sixth + hue / 30) % 6
    s = np.clip(np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0) + saturation / 255, 0, 1)
    v = np.clip(top + value / 255, 0, 1)
    away = (np.array([5.0, 3.0, 1.0]) + sixth[..., None]) % 6
    return as_bytes(255 * v[..., None] * (1 - s[..., None] * np.clip(np.minimum(away, 4 - away), 0, 1)))


def jitter_saturation(p: Image, by: float) -> Image:
    grey = (p @ np.array([0.299, 0.587, 0.114]))[..., None]
    return as_bytes(grey + (p - grey) * by)


# The usual quantisation tables of JPEG, and RGB to YCbCr.
LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]).reshape(8, 8)
CHROMA = np.full((8, 8), 99)
CHROMA[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
YCBCR = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def jpeg(p: Image, quality: int) -> Image:
    """What JPEG's quantisation does to an image (colours at full resolution; lossless steps left out)."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    h, w = p.shape[:2]
    x = np.pad(p.astype(np.float64), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") @ YCBCR.T - np.array([128.0, 0, 0])
    blocks = x.reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3)
    k = np.arange(8)
    dct = np.cos((2 * k + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
    tables = np.clip(np.floor((np.stack([LUMA, CHROMA, CHROMA]) * scale + 50) / 100), 1, 255)
    coded = np.rint(dct @ blocks @ dct.T / tables) * tables
    back = (dct.T @ coded @ dct).transpose(0, 3, 1, 4, 2).reshape(x.shape) + np.array([128.0, 0, 0])
    return as_bytes(back @ np.linalg.inv(YCBCR).T)[:h, :w]


# Fixed augmentations

#: Family: what it does to an image with its parameters.
FAMILIES: dict[str, Callable[..., Image]] = {
    "blur_rgb": lambda p, sigma: as_bytes(gaussian(p, sigma)),
    "blur_lab_l": lambda p, sigma: on_lightness(p, lambda x: gaussian(x, sigma)),
    "downup_rgb": lambda p, scale: nearest_down_up(p, scale),
    "downup_lab_l": lambda p, scale: on_lightness(p, lambda x: down_up(x, scale)),
    "blur_downup_lab_l": lambda p, sigma, scale: on_lightness(p, lambda x: down_up(gaussian(x, sigma), scale)),
    "gamma": lambda p, gamma: as_bytes(255 * (p / 255.0) ** (gamma / 100)),
    "brightness": lambda p, brightness: as_bytes(p + 255 * brightness),
    "contrast": lambda p, contrast: as_bytes(p * (1 + contrast)),
    "hue_shift": lambda p, hue_shift: shift_hsv(p, hue=hue_shift),
    "saturation_shift": lambda p, sat_shift: shift_hsv(p, saturation=sat_shift),
    "value_shift": lambda p, val_shift: shift_hsv(p, value=val_shift),
    "jpeg": lambda p, quality: jpeg(p, quality),
    "gaussian_noise": lambda p, std: as_bytes(p + image_rng(p, 0).normal(0, std, p.shape)),
}
#: The strengths at which each family is registered, by the name of its variants.
STRENGTHS: dict[tuple[str, str], tuple] = {
    ("blur_rgb", "blur_rgb_sigma_{sigma}"): (0.25, 0.5, 1.0, 1.5, 2.0),
    ("blur_lab_l", "blur_lab_l_sigma_{sigma}"): (0.25, 0.5, 1.0, 1.5, 2.0),
    ("downup_rgb", "downup_rgb_scale_{scale}"): (0.95, 0.9, 0.85, 0.8, 0.7),
    ("downup_lab_l", "downup_lab_l_scale_{scale}"): (0.95, 0.9, 0.85, 0.8, 0.7),
    ("blur_downup_lab_l", "blur_downup_lab_l_sigma_{sigma}_scale_{scale}"): ((0.5, 0.9), (0.5, 0.8), (1.0, 0.9), (1.0, 0.8)),
    ("gamma", "gamma_{gamma}"): (85, 90, 110, 120),
    ("brightness", "brightness_{brightness}"): (-0.1, -0.05, 0.05, 0.1),
    ("contrast", "contrast_{contrast}"): (-0.15, -0.1, 0.1, 0.15),
    ("hue_shift", "hue_shift_{hue_shift}"): (-8, -4, 4, 8),
    ("saturation_shift", "saturation_shift_{sat_shift}"): (-20, -10, 10, 20),
    ("value_shift", "value_shift_{val_shift}"): (-15, -8, 8, 15),
    ("jpeg", "jpeg_quality_{quality}"): (95, 80, 60, 40),
    ("gaussian_noise", "gaussian_noise_std_{std}"): (2.0, 5.0, 10.0, 20.0),
}


@dataclass(frozen=True)
class Spec:
    """A named augmentation: a family and its parameters."""

    name: str
    family: str
    params: dict[str, Any] = field(hash=False)

    def __call__(self, image: Image) -> Image:
        return FAMILIES[self.family](image, **self.params)


def specs() -> dict[str, Spec]:
    """All fixed augmentations by name."""
    out = {}
    for (family, form), strengths in STRENGTHS.items():
        fields = [part.split("}")[0] for part in form.split("{")[1:]]
        for values in strengths:
            params = dict(zip(fields, values if isinstance(values, tuple) else (values,), strict=True))
            out[form.format(**params)] = Spec(form.format(**params), family, params)
    return out


# Random augmentations


def image_rng(image: Image, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(np.ascontiguousarray(image).tobytes())])


def _colour_jitter(p: Image, rng) -> Image:
    p = as_bytes(p * rng.uniform(0.88, 1.12))
    p = as_bytes(p.mean() + (p - p.mean()) * rng.uniform(0.88, 1.12))
    return shift_hsv(jitter_saturation(p, rng.uniform(0.82, 1.18)), hue=180 * rng.uniform(-0.03, 0.03))


def _motion_blur(p: Image, rng) -> Image:
    n = int(rng.choice([3, 5, 7]))
    return as_bytes(_along(p.astype(np.float64), np.full(n, 1 / n), int(rng.integers(2))))


def _sharpen(p: Image, rng) -> Image:
    amount, light = rng.uniform(0.05, 0.3), rng.uniform(0.8, 1.2)
    around = _along(_along(p.astype(np.float64), np.ones(3), 0), np.ones(3), 1) - p
    return as_bytes((1 - amount) * p + amount * ((8 + light) * p - around))


def _iso_noise(p: Image, rng) -> Image:
    strength = rng.uniform(0.1, 0.4)
    shaded = as_bytes(p + rng.poisson(12 * strength, p.shape[:2])[..., None] - 12 * strength)
    return shift_hsv(shaded, hue=180 * rng.normal(0, rng.uniform(0.01, 0.04) * strength))


#: Preset steps: chance, and functions of (image, generator) of which one is drawn.
STAIN_COLOUR = (
    (0.6, (lambda p, r: shift_hsv(p, r.uniform(-8, 8), r.uniform(-18, 18), r.uniform(-12, 12)),)),
    (0.6, (_colour_jitter,)),
    (0.5, (lambda p, r: as_bytes(p * (1 + r.uniform(-0.15, 0.15)) + 255 * r.uniform(-0.12, 0.12)),)),
    (0.4, (lambda p, r: as_bytes(255 * (p / 255.0) ** r.uniform(0.85, 1.2)),)),
)
ACQUISITION = (
    (0.5, (lambda p, r: as_bytes(gaussian(p, 0.3 * ((r.choice([3, 5, 7]) - 1) * 0.5 - 1) + 0.8)), _motion_blur, _sharpen)),
    (0.3, (lambda p, r: as_bytes(p + r.normal(0, np.sqrt(r.uniform(5, 35)), p.shape)), _iso_noise)),
    (0.5, (lambda p, r: jpeg(p, int(r.integers(40, 96))),)),
    (0.3, (lambda p, r: nearest_down_up(p, r.uniform(0.75, 0.95)),)),
)
PRESETS = {"stain_color": STAIN_COLOUR, "acquisition": ACQUISITION, "histopathology_scanner_like": STAIN_COLOUR + ACQUISITION}


def random_augmentation(preset: str, seed: int = 0) -> Augmentation:
    """A preset's steps, each with its chance."""
    steps = _known(PRESETS, preset)

    def augment(image: Image) -> Image:
        rng = image_rng(image, seed)
        for chance, choices in steps:
            if rng.random() < chance:
                image = choices[int(rng.integers(len(choices)))](image, rng)
        return image

    return augment


def stain_jitter(sigma1: float = 0.4, sigma2: float = 0.2, augment_background: bool = False, on_error: str = "skip", seed: int = 0) -> Augmentation:
    """Each stain's amount scaled within ``sigma1`` of 1 and moved within ``sigma2``.

    An image without tissue stays as it is (``identity``) or fails, which
    ``map_pixels`` answers with null (``skip``).
    """
    if on_error not in ("skip", "identity"):
        raise ValueError(f"on_error {on_error!r}; skip or identity")

    def augment(image: Image) -> Image:
        try:
            stains = I.stain_matrix(image)
        except ValueError:
            if on_error == "identity":
                return image
            raise
        rng = image_rng(image, seed)
        amounts, seen = I.concentrations(image, stains), I.tissue_mask(image)
        moved = amounts * rng.uniform(1 - sigma1, 1 + sigma1, (2, 1)) + rng.uniform(-sigma2, sigma2, (2, 1))
        changed = np.ones_like(seen) if augment_background else seen
        return I.compose_pixels(np.where(changed, moved, amounts), stains).reshape(image.shape)

    return augment


def _known(options: dict, name: str):
    if name not in options:
        raise ValueError(f"{name!r}; one of {sorted(options)}")
    return options[name]


#: Backends: a preset's name and options to a function.
BACKENDS: dict[str, Callable[..., Augmentation]] = {
    "deterministic": lambda preset: _known(specs(), preset),
    "random": random_augmentation,
    "stain": lambda preset="stain", **options: _known({"stain": stain_jitter}, preset)(**options),
}
#: Names of imaging libraries under which configurations ask for the same.
BACKENDS |= {"albumentations": BACKENDS["random"], "tiatoolbox": BACKENDS["stain"]}


def build_augmentation(backend: str, preset: str, **options) -> Augmentation:
    """An augmentation from a configuration's backend, preset and options."""
    return _known(BACKENDS, backend)(preset, **options)


def augmented_images(df: DataFrame, names: list[str] | None = None, *, pixels: str = "pixels", height: str = "height", width: str = "width", output: str = "result") -> DataFrame:
    """A row an image and fixed augmentation: ``df`` with ``augmentation`` (its name) and its pixels in ``output``."""
    chosen = {name: _known(specs(), name) for name in (names or list(specs()))}

    @F.pandas_udf("array<int>")
    def changed(name: pd.Series, flat: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        images = (np.asarray(p, np.uint8).reshape(int(a), int(b), 3) for p, a, b in zip(flat, h, w, strict=True))
        return pd.Series([chosen[n](p).ravel().astype(np.int32) for n, p in zip(name, images, strict=True)], dtype=object)

    each = df.filter(F.col(pixels).isNotNull()).withColumn("augmentation", F.explode(F.array(*[F.lit(n) for n in chosen])))
    return each.withColumn(output, changed("augmentation", pixels, height, width))
