"""Column roles of a feature table, and checks made before any action where a plan allows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """Which columns are the nuisance domain, the group, the pair, the row key and the vector."""

    domain: str = "domain"
    group: str = "grp"
    pair: str | None = "pair"
    key: str = "vec_id"
    vector: str = "x"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or an error that lists missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def column_or_default(df: DataFrame, column: str, default) -> F.col:
    return F.col(column) if column in df.columns else F.lit(default)


DELTA_MODES = ("group_to_mean", "group_pairwise", "pair_col_to_mean", "pair_col_pairwise")


def validate_delta_inputs(df: DataFrame, roles: Roles, mode: str) -> None:
    """Two domains and a group at least; pair modes need a pair column. One small aggregate."""
    if mode not in DELTA_MODES:
        raise ValueError(f"mode {mode!r}; one of {DELTA_MODES}")
    if mode.startswith("pair_col") and not roles.pair:
        raise ValueError(f"mode {mode} needs a pair column")
    require_columns(df, [roles.domain, roles.group, roles.vector, *([roles.pair] if mode.startswith("pair_col") else [])])
    seen = df.agg(F.countDistinct(roles.domain).alias("domains"), F.countDistinct(roles.group).alias("groups")).first()
    if seen.domains < 2 or seen.groups < 1:
        raise ValueError(f"{seen.domains} domains in {seen.groups} groups; two and one are needed")
