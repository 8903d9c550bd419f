"""Paired vector differences across a nuisance domain.

Domain means of a group come from one aggregation, which shuffles one vector a
(group, domain) and task. A group's means are then gathered in its row; there
are at most as many as domains, so pairs and barycentres are made within the
row. Every delta keeps its keys as columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenloom.functions import vectors as V
from eigenloom.operators.splits import sample_rows
from eigenloom.roles import Roles, validate_delta_inputs
from eigenloom.session import join_checked, null_safe

SIGNS = ("one", "both")


def domain_means(df: DataFrame, keys: list[str], domain: str, vector: str) -> DataFrame:
    """(keys, domain, n, mean); rows with a null key or domain are dropped, domains compared as strings."""
    rows = df.dropna(subset=[*keys, domain]).withColumn(domain, F.col(domain).cast("string"))
    return rows.groupBy(*keys, domain).agg(F.count("*").alias("n"), V.mean_of(vector).alias("mean"))


def profiles(df: DataFrame, keys: list[str], domain: str, vector: str, order: str | None = None, least: int = 2) -> DataFrame:
    """(keys, means): a group's domain means in order, groups of ``least`` domains or more.

    Order is by domain as a string, or by the least value of the column ``order``.
    """
    rows = df.dropna(subset=[*keys, domain]).withColumn(domain, F.col(domain).cast("string"))
    place = F.min(order) if order else F.col(domain)
    means = rows.groupBy(*keys, domain).agg(place.alias("place"), F.count("*").alias("n"), V.mean_of(vector).alias("mean"))
    entry = F.struct("place", F.col(domain).alias("domain"), "n", "mean")
    return means.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("means")).filter(F.size("means") >= least)


def to_mean(groups: DataFrame, keys: list[str], domains: list[str] | None = None) -> DataFrame:
    """Each domain's mean less the unweighted mean of the domain means.

    With ``domains``, one of these that a group lacks is put at the group's mean: its delta is zero.
    """
    centred = groups.withColumn("centre", V.mean_of_vectors(F.col("means.mean")))
    if domains is not None:
        there = F.transform("means", lambda m: F.struct(m["domain"].alias("domain"), m["mean"].alias("mean")))
        absent = F.array_except(F.array(*map(F.lit, domains)), F.col("means.domain"))
        centred = centred.withColumn("means", F.concat(there, F.transform(absent, lambda d: F.struct(d.alias("domain"), F.col("centre").alias("mean")))))
    each = centred.select(*keys, "centre", F.explode("means").alias("m"))
    none = F.lit(None).cast("string")
    return each.select(*keys, F.col("m.domain").alias("domain_a"), none.alias("domain_b"), V.subtract("m.mean", "centre").alias("delta"))


def pairwise(groups: DataFrame, keys: list[str]) -> DataFrame:
    """For domains a before b: mean of b less mean of a."""
    first = groups.select(*keys, "means", F.posexplode("means").alias("at", "a"))
    both = first.select(*keys, "a", F.explode(F.slice("means", F.col("at") + 2, F.size("means"))).alias("b"))
    return both.select(*keys, F.col("a.domain").alias("domain_a"), F.col("b.domain").alias("domain_b"), V.subtract("b.mean", "a.mean").alias("delta"))


def with_signs(deltas: DataFrame, sign_mode: str = "one") -> DataFrame:
    """Adds ``sign``; with "both" every delta also comes negated."""
    if sign_mode not in SIGNS:
        raise ValueError(f"sign mode {sign_mode!r}; one of {SIGNS}")
    signs = [1] if sign_mode == "one" else [1, -1]
    each = deltas.withColumn("sign", F.explode(F.array(*[F.lit(s) for s in signs])))
    return each.withColumn("delta", V.scale("delta", F.col("sign").cast("double")))


def domain_deltas(df: DataFrame, roles: Roles, mode: str = "group_to_mean", *, sign_mode: str = "one", max_deltas: int | None = None, seed: int = 0, validate: bool = True, least: int = 2, domains: list[str] | None = None) -> DataFrame:
    """Deltas (keys, domain_a, domain_b, sign, delta) of a feature table in one of four modes.

    Groups of fewer than ``least`` domains have none; with 1, a lone domain is at zero from its mean.
    With ``domains`` (modes to the mean), a group also has a delta, which is zero, for each of these that it lacks.
    """
    if domains is not None and not mode.endswith("to_mean"):
        raise ValueError(f"domains are filled in deltas to a mean only, not in {mode!r}")
    if validate:
        validate_delta_inputs(df, roles, mode)
    keys = [roles.group, roles.pair] if mode.startswith("pair_col") else [roles.group]
    groups = profiles(df, keys, roles.domain, roles.vector, least=least)
    deltas = with_signs(to_mean(groups, keys, domains) if mode.endswith("to_mean") else pairwise(groups, keys), sign_mode)
    return deltas if max_deltas is None else sample_rows(deltas, max_deltas, [*keys, "domain_a", "domain_b", "sign"], seed)


def reference_deltas(df: DataFrame, roles: Roles, reference: str) -> DataFrame:
    """Rows less the reference row of their group, for groups with exactly one: (group, key, domain, delta_name, delta)."""
    named = df.withColumn(roles.domain, F.col(roles.domain).cast("string"))
    is_reference = F.col(roles.domain) == reference
    refs = named.filter(is_reference).groupBy(roles.group).agg(F.count("*").alias("n"), F.first(roles.vector).alias("ref")).filter("n = 1").drop("n")
    others = named.filter(~is_reference).join(refs, roles.group)
    return others.select(roles.group, roles.key, roles.domain, F.concat(F.col(roles.domain), F.lit(f"-{reference}")).alias("delta_name"), V.subtract(roles.vector, "ref").alias("delta"))


def aligned_deltas(after: DataFrame, before: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, delta): after less before of the rows that both tables have."""
    a, b = after.select(key, F.col(vector).alias("after")), before.select(key, F.col(vector).alias("before"))
    return a.join(b, key).select(key, V.subtract("after", "before").alias("delta"))


def centre_by(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Every vector less the mean of its group; all rows stay, null keys are a group."""
    means = df.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(V.mean_of(vector).alias("centre"))
    joined = df.join(means, null_safe(df, means, [(k, f"of_{k}") for k in keys]))
    return joined.select(*[V.subtract(vector, "centre").alias(c) if c == vector else F.col(c) for c in df.columns])


def displacement_pairs(df: DataFrame, roles: Roles, keys: list[str] | None = None) -> DataFrame:
    """(keys, domain_a, domain_b, l2, cosine) between the domain means of a group."""
    keys = keys or [roles.group]
    groups = profiles(df, keys, roles.domain, roles.vector)
    first = groups.select(*keys, "means", F.posexplode("means").alias("at", "a"))
    both = first.select(*keys, "a", F.explode(F.slice("means", F.col("at") + 2, F.size("means"))).alias("b"))
    return both.select(
        *keys,
        F.col("a.domain").alias("domain_a"),
        F.col("b.domain").alias("domain_b"),
        V.norm(V.subtract("b.mean", "a.mean")).alias("l2"),
        V.cosine("a.mean", "b.mean").alias("cosine"),
    )


def common_domains(df: DataFrame, roles: Roles) -> DataFrame:
    """Domains that every group has."""
    seen = df.dropna(subset=[roles.group, roles.domain]).select(roles.group, F.col(roles.domain).cast("string").alias("domain")).distinct()
    groups = seen.agg(F.countDistinct(roles.group).alias("groups"))
    return seen.groupBy("domain").agg(F.count("*").alias("n")).join(F.broadcast(groups), F.col("n") == F.col("groups")).select("domain")


def complete_group_means(df: DataFrame, roles: Roles, only_common: bool = True) -> DataFrame:
    """(group, domain, group_mean, domain_mean, delta) over common domains, or over the domains that each group has."""
    rows = df.withColumn("domain", F.col(roles.domain).cast("string"))
    rows = join_checked(rows, common_domains(df, roles), "domain") if only_common else rows.dropna(subset=["domain"])
    groups = rows.groupBy(roles.group).agg(V.mean_of(roles.vector).alias("group_mean"))
    means = domain_means(rows, [roles.group], "domain", roles.vector)
    return means.join(groups, roles.group).select(roles.group, "domain", "group_mean", F.col("mean").alias("domain_mean"), V.subtract("mean", "group_mean").alias("delta"))


def mixture_weights(n: int, n_domains: int, *, beta: float = 1.0, seed: int = 0, pure_first: int | None = None) -> np.ndarray:
    """Convex weights (n, domains): the given domain alone first, then Dirichlet draws."""
    weights = np.random.default_rng(seed).dirichlet(np.full(n_domains, beta), n)
    if pure_first is not None and n:
        weights[0] = np.eye(n_domains)[pure_first]
    return weights


def synthetic_mixtures(means: DataFrame, roles: Roles, weights: np.ndarray, domains: list[str]) -> DataFrame:
    """(group, synthetic, x): group mean plus weighted domain deltas, a row for each weight vector.

    ``means`` is from ``complete_group_means``. Weights are few and part of the plan.
    """
    spark = means.sparkSession
    rows = [(k, d, float(weights[k, j])) for k in range(len(weights)) for j, d in enumerate(domains)]
    table = spark.createDataFrame(rows, "synthetic int, domain string, weight double")
    weighed = means.join(F.broadcast(table), "domain").withColumn("part", V.scale("delta", F.col("weight")))
    summed = weighed.groupBy(roles.group, "synthetic").agg(V.mean_of("part").alias("m"), F.count("*").alias("n"), F.first("group_mean").alias("g"))
    return summed.select(roles.group, "synthetic", V.add("g", V.scale("m", F.col("n").cast("double"))).alias("x"))


def synthetic_coordinates(groups: DataFrame, roles: Roles, components: np.ndarray, std: np.ndarray, *, n: int, radius: float = 1.0, seed: int = 0, sphere: bool = False) -> DataFrame:
    """(group, synthetic, x): group mean plus random coordinates in a subspace, a row a group and draw."""
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, len(std)))
    z = z / np.linalg.norm(z, axis=1, keepdims=True) * radius if sphere else z * std * radius
    shifts = (z @ components).tolist()
    drawn = F.array(*[F.struct(F.lit(k).alias("synthetic"), F.array(*[F.lit(v) for v in s]).alias("shift")) for k, s in enumerate(shifts)])
    each = groups.select(roles.group, "group_mean", F.explode(drawn).alias("d"))
    return each.select(roles.group, "d.synthetic", V.add("group_mean", "d.shift").alias("x"))


def augmentation_deltas(images: DataFrame, encode, augmentations: list, *, key: str, pixels: str = "pixels", height: str = "height", width: str = "width", mode: str = "original_to_augmented", originals: DataFrame | None = None, vector: str = "embedding") -> DataFrame:
    """(key, draw, delta): what image augmentations do to embeddings.

    ``augmentations`` are functions of an image (height x width x 3), one draw
    each; ``augmented_to_augmented`` pairs them in twos. ``originals`` (key,
    vector) spares the originals' encoding. Images that a function fails on are left out.
    """
    from eigenloom.operators.images import encode_images, map_pixels

    def embedded(function) -> DataFrame:
        seen = images if function is None else map_pixels(images, function, pixels=pixels, height=height, width=width, output=pixels).filter(F.col(pixels).isNotNull())
        return encode_images(seen, encode, pixels=pixels, output="_e").select(key, "_e")

    if mode == "original_to_augmented":
        start = embedded(None) if originals is None else originals.select(key, F.col(vector).alias("_e"))
        pairs = [(start, a) for a in augmentations]
    elif mode == "augmented_to_augmented":
        pairs = [(embedded(a), b) for a, b in zip(augmentations[::2], augmentations[1::2], strict=True)]
    else:
        raise ValueError(f"mode {mode!r}")
    parts = [aligned_deltas(embedded(after), before, key, "_e").withColumn("draw", F.lit(k)) for k, (before, after) in enumerate(pairs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(key, "draw", "delta")


def proxy_deltas(df: DataFrame, key: str, proxy: str, vector: str, mode: str = "per_patch_centered") -> DataFrame:
    """(key, proxy, delta) of rows seen under several proxies, less their mean or their first proxy, then centred over all."""
    groups = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(proxy).alias("proxy"), V.vec(vector).alias("v")))).alias("all"))
    if mode == "per_patch_centered":
        base: Column = V.mean_of_vectors(F.col("all.v"))
    elif mode == "first_target_reference":
        base = F.get("all", F.lit(0))["v"]
    else:
        raise ValueError(f"mode {mode!r}")
    each = groups.withColumn("base", base).select(key, "base", F.explode("all").alias("p"))
    deltas = each.select(key, F.col("p.proxy").alias("proxy"), V.subtract("p.v", "base").alias("delta"))
    return deltas.join(F.broadcast(deltas.agg(V.mean_of("delta").alias("centre")))).select(key, "proxy", V.subtract("delta", "centre").alias("delta"))
