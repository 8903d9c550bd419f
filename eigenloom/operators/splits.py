"""Folds, deterministic samples, ranks.

Seeded samples rank rows by an MD5 of key and seed, so they are the same for
any partitioning (they are not a pseudo-random generator's draws). A cap of k
rows is a top-k by that hash, which every task cuts before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenloom.session import few_values, join_checked, materialise

#: Samples up to this size are one top-k.
TOP_ROWS = 10_000


def sample_key(keys: list[str], seed: int = 0) -> Column:
    """A row's place in seeded samples."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def sample_rows(df: DataFrame, max_rows: int | None, keys: list[str], seed: int = 0) -> DataFrame:
    """At most ``max_rows`` rows, without replacement: those first by ``sample_key``.

    Few rows are a top-k. For many, counts by the hash's first digits tell which
    rows are in whatever their order, so that only the rows of one prefix are
    ranked and no task gets the whole sample from every other.
    """
    if max_rows is None:
        return df
    place = sample_key(keys, seed)
    if max_rows <= TOP_ROWS:
        return df.orderBy(place, *keys).limit(max_rows)
    prefix = F.substring(place, 1, 4)
    left = max_rows
    for row in df.groupBy(prefix.alias("prefix")).count().orderBy("prefix").collect():  # at most 16 ** 4
        if row["count"] > left:
            return df.filter(prefix < row["prefix"]).unionByName(df.filter(prefix == row["prefix"]).orderBy(place, *keys).limit(left))
        left -= row["count"]
    return df


def _terms_below(level: np.ndarray, size: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """By fold, how many groups of ``size`` it takes while its load is below ``level``."""
    return np.maximum(0, -(-(level[:, None] - loads) // size[:, None]))


def _level(place: np.ndarray, size: np.ndarray, loads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Load of the fold that takes the group at ``place``; which folds have that load then, and how many of them are served before."""
    low, high = loads.min(1), loads.max(1) + (place + 1) * size
    while (high - low > 1).any():
        middle = (low + high) // 2
        fits = _terms_below(middle, size, loads).sum(1) <= place
        low, high = np.where(fits, middle, low), np.where(fits, high, middle)
    equal = (loads <= low[:, None]) & ((low[:, None] - loads) % size[:, None] == 0)
    return low, equal, place - _terms_below(low, size, loads).sum(1)


def lightest_fold(place: np.ndarray, size: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """Folds of the groups at ``place`` (from 0) of a run of equal ``size``, each dealt to the lightest fold, the lowest of equals.

    A fold's loads in such a run are load, load + size, ...; the group at a place
    takes the fold of the number at that place among all of these in order.
    """
    _, equal, before = _level(place, size, loads)
    return (np.cumsum(equal, axis=1) == before[:, None] + 1).argmax(1)


def loads_after(count: int, size: int, loads: np.ndarray) -> np.ndarray:
    """Loads of the folds after a run of ``count`` groups of ``size``."""
    n, s, all_loads = np.array([count]), np.array([size]), loads[None, :]
    level, equal, left = _level(n, s, all_loads)
    taken = _terms_below(level, s, all_loads) + (equal & (np.cumsum(equal, axis=1) <= left[:, None]))
    return loads + taken[0] * size


def group_folds(df: DataFrame, group: str, n_splits: int = 5, by_size: bool = True) -> DataFrame:
    """(group, fold): groups by size, then name, descending, each to the lightest fold, the lowest of equals.

    Without ``by_size`` every group counts as one: groups are dealt in turn by name, descending.

    Only the number of groups of each size comes to the driver (their sizes
    differ, so they number at most the root of twice the rows). A group's place
    among those of its size comes from ranges by size and name and prefix sums
    of these, its fold from its place.
    """
    sizes = df.dropna(subset=[group]).groupBy(group).agg((F.count("*") if by_size else F.max(F.lit(1)).cast("long")).alias("n"))
    order = [F.col("n").desc(), F.col(group).cast("string").desc()]
    ranged = sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "fold-groups")
    runs = ranged.groupBy("n").count().orderBy(F.desc("n")).collect()
    total = sum(r["count"] for r in runs)
    if total < 2:
        raise ValueError(f"{total} groups; two are needed")
    loads, starts = np.zeros(min(n_splits, total), np.int64), []
    for row in runs:
        starts.append((row["n"], loads.tolist()))
        loads = loads_after(row["count"], row["n"], loads)
    runs_table = df.sparkSession.createDataFrame(starts, "n long, _loads array<long>")
    earlier = Window.partitionBy("n").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("n", "_part").agg(F.count("*").alias("_size")).select("n", "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("n", "_part").orderBy(F.col(group).cast("string").desc())
    placed = ranged.withColumn("_row", F.row_number().over(inside) - 1).join(before, ["n", "_part"])
    placed = join_checked(placed, runs_table, "n")

    @F.pandas_udf("int")
    def fold(place: pd.Series, size: pd.Series, loads: pd.Series) -> pd.Series:
        return pd.Series(lightest_fold(place.to_numpy(), size.to_numpy(), np.stack(loads.to_numpy())) if len(place) else [], dtype="int32")

    return materialise(placed.select(group, fold(F.col("_row") + F.col("_before"), "n", "_loads").alias("fold")), "folds")


def with_folds(df: DataFrame, group: str, n_splits: int = 5, by_size: bool = True) -> DataFrame:
    """``df`` with ``fold``."""
    return join_checked(df, group_folds(df, group, n_splits, by_size), group)


def train_rows(df: DataFrame, fold: int, *, fit_without: tuple[str, str] | None = None) -> DataFrame:
    """Rows of the other folds; ``fit_without`` (column, value) leaves a domain out of fitting only."""
    rows = df.filter(F.col("fold") != fold)
    return rows if fit_without is None else rows.filter(F.col(fit_without[0]) != fit_without[1])


def test_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.filter(F.col("fold") == fold)


def sample_sources(df: DataFrame, key: str, n_targets: int, max_deltas: int | None, per_source: int | None = None, seed: int = 0) -> DataFrame:
    """Distinct sources that a budget of deltas needs, ``per_source`` deltas each."""
    sources = df.select(key).distinct()
    return sources if max_deltas is None else sample_rows(sources, -(-max_deltas // (per_source or n_targets)), [key], seed)


def sample_per_group(df: DataFrame, groups: list[str], cap: int, keys: list[str], seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of every group.

    The rank is cut in a filter on the window, so tasks drop what cannot be in it before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(sample_key(keys, seed), *keys))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_rank")


def balanced_sample(df: DataFrame, label: str, max_rows: int, keys: list[str], seed: int = 0) -> DataFrame:
    """At most ``max_rows`` rows, each class up to its equal share, topped up from the rest.

    No row beyond ``max_rows`` of its class can be taken; the filter on the rank drops those in tasks, before the shuffle.
    """
    classes = max(1, df.select(label).distinct().count())
    share = max(1, max_rows // classes)
    place = sample_key(keys, seed)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy(place, *keys))).filter(F.col("_rank") <= max_rows)
    extra = (F.col("_rank") > share).cast("int")
    return ranked.orderBy(extra, place, *keys).limit(max_rows).drop("_rank")


def first_of_group(df: DataFrame, groups: list[str], order: list) -> DataFrame:
    """The first row of each group in an order (whole rows, not the first non-null of each column)."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def top(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the least of equals."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)


def rows_by_index(df: DataFrame, key: str, indices: DataFrame) -> DataFrame:
    """``df`` rows for a table of indices (key), duplicates kept; an unknown index is an error."""
    missing = indices.join(df.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise IndexError("an index is out of range")
    return indices.select(key).join(df, key).withColumn("feature_index", F.col(key))


def complete_pairs(df: DataFrame, domain: str, pair: str, expected: int | None = None) -> DataFrame:
    """Rows whose pair has all the expected number of distinct domains (default: as many as there are)."""
    seen = df.groupBy(pair).agg(F.countDistinct(domain).alias("n"))
    if expected is None:
        every = df.agg(F.countDistinct(domain).alias("all"))
        full = seen.join(F.broadcast(every), F.col("n") == F.col("all"))
    else:
        full = seen.filter(F.col("n") == expected)
    return df.join(full.select(pair), pair, "left_semi")


def select_domains(df: DataFrame, domain: str, selected: list[str] | None) -> DataFrame:
    """Rows of the selected domains; None is all, unknown, repeated or no names are errors."""
    if selected is None:
        return df
    known = {str(v) for v in few_values(df, domain)}
    if not selected or len(set(selected)) < len(selected) or not set(selected) <= known:
        raise ValueError(f"selection {selected} of {sorted(known)}")
    return df.filter(F.col(domain).cast("string").isin(selected))
