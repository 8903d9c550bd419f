"""Grouped summaries of feature tables and of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenloom.functions import vectors as V
from eigenloom.operators.splits import first_of_group


def metadata_summary(df: DataFrame, domain: str, group: str, pair: str) -> DataFrame:
    """One row: rows and distinct domains, groups and pairs."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(domain).alias("n_domains"), F.countDistinct(group).alias("n_groups"), F.countDistinct(pair).alias("n_pairs"))


def domain_counts(df: DataFrame, domain: str) -> DataFrame:
    return df.groupBy(domain).agg(F.count("*").alias("n")).orderBy(domain)


def domain_count_histogram(df: DataFrame, domain: str, pair: str) -> DataFrame:
    """(n_domains, n): how many pairs have so many distinct domains."""
    return df.groupBy(pair).agg(F.countDistinct(domain).alias("n_domains")).groupBy("n_domains").agg(F.count("*").alias("n"))


def mean_std(df: DataFrame, keys: list[str], values: list[str], *, with_max: bool = False, count_of: str | None = None) -> DataFrame:
    """Mean and sample deviation of each value by key; null keys are groups, NaN is null."""
    clean = df.select(*keys, *[F.nanvl(F.col(v).cast("double"), F.lit(None)).alias(v) for v in values], *([count_of] if count_of else []))
    parts: list[Column] = []
    for v in values:
        parts += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), *([F.max(v).alias(f"{v}_max")] if with_max else [])]
    if count_of:
        parts.append(F.countDistinct(count_of).alias(f"n_{count_of}"))
    return clean.groupBy(*keys).agg(*parts)


def probe_by_rank(scores: DataFrame, raw: str = "raw_score", projected: str = "projected_score") -> DataFrame:
    """Raw, projected and difference by rank."""
    rows = scores.withColumn("score_delta", F.col(projected) - F.col(raw))
    return mean_std(rows, ["rank"], [raw, projected, "score_delta"])


def fold_gaps(scores: DataFrame, combo: list[str], fold: str = "fold") -> DataFrame:
    """Combinations that lack folds or have one twice."""
    folds = scores.agg(F.countDistinct(fold).alias("all"))
    seen = scores.groupBy(*combo).agg(F.count("*").alias("rows"), F.countDistinct(fold).alias("folds"))
    return seen.join(F.broadcast(folds)).filter((F.col("folds") != F.col("all")) | (F.col("rows") != F.col("folds"))).drop("all")


def paper_table(scores: DataFrame, keys: list[str], values: list[str], digits: int = 3) -> DataFrame:
    """``mean ± deviation`` strings."""
    stats = mean_std(scores, keys, values)
    return stats.select(*keys, *[F.format_string(f"%.{digits}f ± %.{digits}f", f"{v}_mean", F.coalesce(f"{v}_std", F.lit(0.0))).alias(v) for v in values])


def pooled_moments(df: DataFrame, key: str, n: str, mean: str, var: str, floor: float = 1e-6) -> DataFrame:
    """Mean and variance over all pixels from those of images."""
    sums = df.groupBy(key).agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.col(mean)).alias("s"), F.sum(F.col(n) * (F.col(var) + F.col(mean) ** 2)).alias("q"))
    pooled = F.col("s") / F.col("n")
    return sums.select(key, "n", pooled.alias("mean"), F.greatest(F.col("q") / F.col("n") - pooled**2, F.lit(floor)).alias("var"))


def median_reference(df: DataFrame, mean: str, std: str, fraction: str | None = None, min_fraction: float = 0.05) -> DataFrame:
    """Exact medians of image means and deviations; images with little tissue are left out."""
    rows = df if fraction is None else df.filter(F.col(fraction) >= min_fraction)
    return rows.agg(F.percentile(mean, F.lit(0.5)).alias("mean"), F.percentile(std, F.lit(0.5)).alias("std"), F.count("*").alias("n"))


def leave_one_out_dispersion(matrices: DataFrame, item: str, domain: str, matrix: str = "matrix") -> DataFrame:
    """(item, mean, max, std, flagged): distance of each domain's matrix to the normalised mean of the item's others.

    Flagged from the 90th percentile of means on. An item has one small matrix a domain;
    an item's only matrix has no others to be apart from, its distance is 0.
    """
    from eigenloom.operators.geometry import matrix_distance

    flat = matrices.withColumn("flat", V.vec(F.flatten(F.col(matrix))))
    whole = Window.partitionBy(item)
    d = 6
    n = F.count("*").over(whole)
    others = flat.withColumn("n", n).withColumn("others", F.array(*[(F.sum(F.get("flat", F.lit(k))).over(whole) - F.get("flat", F.lit(k))) / F.greatest(n - 1, F.lit(1)) for k in range(d)]))
    rows = lambda c: F.array(F.slice(c, 1, 3), F.slice(c, 4, 3))
    distances = others.withColumn("distance", F.when(F.col("n") > 1, matrix_distance(rows("flat"), rows("others"))).otherwise(0.0))
    stats = distances.groupBy(item).agg(F.avg("distance").alias("mean"), F.max("distance").alias("max"), F.stddev_pop("distance").alias("std"))
    limit = stats.agg(F.percentile("mean", F.lit(0.9)).alias("limit"))
    return stats.join(F.broadcast(limit)).select(item, "mean", "max", "std", (F.col("mean") >= F.col("limit")).alias("flagged"))


def norm_summary(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, dim, mean, median, std): norms of deltas by transform; population deviation."""
    rows = df.select(key, V.norm(vector).alias("norm"), F.size(vector).alias("dim"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.avg("norm").alias("mean"), F.percentile("norm", F.lit(0.5)).alias("median"), F.stddev_pop("norm").alias("std"))


def displacement_summary(raw: DataFrame, erased: DataFrame, keys: list[str]) -> DataFrame:
    """(domain_a, domain_b, ...): displacement before and after erasure, joined by group and pair, averaged by pair."""
    on = [*keys, "domain_a", "domain_b"]
    a = raw.select(*on, F.col("l2").alias("l2_raw"), F.col("cosine").alias("cosine_raw"))
    b = erased.select(*on, F.col("l2").alias("l2_erased"), F.col("cosine").alias("cosine_erased"))
    joined = a.join(b, on).withColumn("relative_l2_remaining", F.col("l2_erased") / (F.col("l2_raw") + F.lit(V.EPS)))
    names = ["l2_raw", "l2_erased", "cosine_raw", "cosine_erased", "relative_l2_remaining"]
    means = joined.groupBy("domain_a", "domain_b").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names])
    return means.withColumn("fraction_l2_removed", 1 - F.col("relative_l2_remaining"))


def image_pair_summary(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Means of ``<metric>_raw`` and ``<metric>_new`` by target and their improvement, best first."""
    parts = [F.avg(c).alias(c) for m in metrics for c in (f"{m}_raw", f"{m}_new")]
    means = df.groupBy(key).agg(*parts)
    better = [(F.col(f"{m}_raw") - F.col(f"{m}_new")).alias(f"{m}_improvement") for m in metrics]
    return means.select("*", *better).orderBy(key, F.desc(f"{metrics[0]}_improvement"))


def config_matches(stages: str | Column, key: str, expected: list[float | None], tol: float = 1e-8) -> Column:
    """Whether a JSON list of stage objects has these values under ``key``; null equals null only."""
    parsed = F.from_json(V.col(stages), "array<map<string,string>>")
    got = F.transform(parsed, lambda s: F.get_json_object(F.to_json(s), f"$.{key}").try_cast("double"))
    want = F.array(*[F.lit(e).cast("double") for e in expected])
    same = F.zip_with(got, want, lambda a, b: (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tol, F.lit(False)))
    return (F.size(got) == len(expected)) & F.forall(same, lambda x: x)


def feasible(summary: DataFrame, taus: list[float], per_a: str, per_b: str, cost: str, order: list[str]) -> DataFrame:
    """(tau, ...): configurations with both excess ratios at most tau. The taus are few and part of the plan."""
    each = summary.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    return each.filter((F.col(per_a) <= F.col("tau")) & (F.col(per_b) <= F.col("tau"))).orderBy("tau", cost, *order)


def operating_points(summary: DataFrame, taus: list[float], per_a: str, per_b: str, cost: str, order: list[str]) -> DataFrame:
    """The cheapest feasible configuration of each tau; a row of nulls where there is none."""
    best = first_of_group(feasible(summary, taus, per_a, per_b, cost, order), ["tau"], [F.col(cost), *order])
    wanted = summary.sparkSession.createDataFrame([(float(t),) for t in taus], "tau double")
    return wanted.join(best, "tau", "left")


def within_budget(summary: DataFrame, change: str, score: str, chance: str, max_change: float = 0.35, tolerance: float = 0.10) -> DataFrame:
    """Configurations that change little and leave the probe near chance."""
    return summary.filter((F.col(change) <= max_change) & (F.col(score) <= F.col(chance) + tolerance))
