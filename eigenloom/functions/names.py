"""Identifiers and formatted fields as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from eigenloom.functions.vectors import col


def pair_key(columns: list[str]) -> Column:
    """``a::b::...`` of stringified values; a null reads ``nan``."""
    return F.concat_ws("::", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def slide_id(tile_id: str | Column) -> Column:
    """The part of a tile id before the first dash."""
    return F.substring_index(col(tile_id), "-", 1)


def image_id(tile_id: str | Column) -> Column:
    """The parts of a tile id before its ``tile_*`` part; without one, or with it first, the first two parts or all."""
    parts = F.split(col(tile_id), "-")
    at = F.array_position(F.transform(parts, lambda p: p.startswith("tile_")), F.lit(True)).cast("int")
    keep = F.when(at > 1, at - 1).when(F.size(parts) >= 2, F.lit(2)).otherwise(F.size(parts))
    return F.array_join(F.slice(parts, F.lit(1), keep), "-")


def file_fields(filename: str | Column) -> Column:
    """Struct of slide, sample, tile and scanner from ``slide-sample-tile-scanner.ext``."""
    parts = F.split(F.regexp_replace(F.substring_index(col(filename), "/", -1), r"\.[^.]*$", ""), "-")
    return F.struct(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("slide_id", "sample_id", "tile", "scanner_id"))])


def safe_name(value: str | Column) -> Column:
    """Letters, digits, dot, dash and underscore stay, runs of the rest become one underscore; never empty."""
    cleaned = F.regexp_replace(F.regexp_replace(col(value), r"[^A-Za-z0-9._-]+", "_"), r"_+", "_")
    cleaned = F.regexp_replace(cleaned, r"^_+|_+$", "")
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit("unnamed")).otherwise(cleaned)


def short_digest(values: Column, length: int = 8) -> Column:
    """The first hex digits of SHA-1 over newline-joined values."""
    return F.substring(F.sha1(F.concat_ws("\n", values)), 1, length)


def selection_token(selected: list[str] | None, kind: str = "scanners") -> str:
    """Path token of a selection: all, one name, or number and digest of the sorted names."""
    if selected is None:
        return f"{kind}-all"
    if len(selected) == 1:
        return f"{kind.rstrip('s')}-{selected[0]}"
    digest = hashlib.sha1("\n".join(sorted(selected)).encode()).hexdigest()[:8]
    return f"{kind}-k{len(selected)}-{digest}"


def stage_name(method: str, **options) -> str:
    """A deterministic label of a stage: method and its options in order, numbers as %g."""
    shown = lambda v: f"{v:g}" if isinstance(v, float) else "full" if v is None else str(v)
    return "_".join([method, *(f"{k}{shown(v)}" for k, v in sorted(options.items()))])


def literal_list(text: str | Column) -> Column:
    """``[a, b]`` as an array of doubles."""
    return F.from_json(col(text), "array<double>")


def mean_or_median(text: str | Column, which: str = "median") -> Column:
    """A number from ``mean (std) ; median (...)``."""
    part = F.trim(F.get(F.split(col(text), ";"), F.lit(1 if which == "median" else 0)))
    return F.get(F.split(part, r"\s+"), F.lit(0)).try_cast("double")
