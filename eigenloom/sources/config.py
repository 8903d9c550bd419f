"""Run configurations: nested mappings with typed access."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


def load_config(source) -> dict:
    """A mapping as it is, or a YAML file's where PyYAML is installed."""
    if isinstance(source, Mapping):
        return dict(source)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("PyYAML is not installed; pass a mapping") from missing
    with open(source, encoding="utf-8") as f:
        loaded = yaml.safe_load(f)
    if not isinstance(loaded, Mapping):
        raise TypeError("the root must be a mapping")
    return dict(loaded)


def required(config: Mapping, key: str, kind: type):
    """A value that must be there (KeyError) and of its type (TypeError)."""
    if key not in config:
        raise KeyError(key)
    return _typed(config[key], key, kind)


def optional(config: Mapping, key: str, kind: type, default=None):
    return default if config.get(key) is None else _typed(config[key], key, kind)


def _typed(value, key: str, kind: type):
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise TypeError(f"{key}: {type(value).__name__}, not {kind.__name__}")
    return value


@dataclass(frozen=True)
class Diagnostics:
    """What to report of moments."""

    enabled: bool = True
    top_k: int = 32
    tolerances: tuple[float, ...] = (1e-3, 1e-6)

    @classmethod
    def of(cls, config) -> Diagnostics:
        """None, a switch or a mapping."""
        if config is None or isinstance(config, bool):
            return cls(enabled=bool(config))
        return cls(enabled=config.get("enabled", True), top_k=config.get("top_k", 32), tolerances=tuple(config.get("rank_tolerances", (1e-3, 1e-6))))


def compute_dtype(name: str):
    """numpy type of fits: float32 or float64."""
    import numpy as np

    if name not in ("float32", "float64"):
        raise ValueError(f"dtype {name!r}")
    return np.dtype(name)
