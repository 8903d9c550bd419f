"""Vectors as ``array<double>`` columns: native functions, no UDFs."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vec(x: str | Column) -> Column:
    """Any numeric array as array<double>."""
    return col(x).cast("array<double>")


def total(x: str | Column) -> Column:
    """Sum of an array's elements."""
    return F.aggregate(col(x), F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return total(F.zip_with(vec(a), vec(b), lambda x, y: x * y))


def norm(x) -> Column:
    return F.sqrt(dot(x, x))


def squared_norm(x) -> Column:
    return dot(x, x)


def add(a, b) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x - y)


def scale(x, by) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(vec(x), lambda v: v * by)


def normalise(x, eps: float = EPS) -> Column:
    """x / (norm + eps)."""
    return scale(x, 1 / (norm(x) + F.lit(eps)))


def cosine(a, b, eps: float = EPS) -> Column:
    """dot / (norm * norm + eps)."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def mean_of(x: str | Column) -> Column:
    """Aggregate: element-wise mean of a vector column. Partial sums of one vector a group and task are shuffled."""
    return vector_to_array(Summarizer.mean(array_to_vector(vec(x))))


def variance_of(x: str | Column) -> Column:
    """Aggregate: element-wise sample variance of a vector column."""
    return vector_to_array(Summarizer.variance(array_to_vector(vec(x))))


def mean_of_vectors(arrays: Column) -> Column:
    """Element-wise mean of an array of vectors, within a row."""
    first = F.transform(F.get(arrays, F.lit(0)), lambda v: v * 0.0)
    return scale(F.aggregate(arrays, first, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)), 1 / F.size(arrays).cast("double"))


def long_form(df: DataFrame, x: str, *keys: str, value: str = "v", index: str = "i") -> DataFrame:
    """A row for every element: keys, index from 0, value."""
    return df.select(*keys, F.posexplode(vec(x)).alias(index, value))


POOLINGS = ("cls", "mean", "mean_no_cls")


def pool_tokens(tokens: str | Column, mode: str) -> Column:
    """An array of token vectors as one vector: the first, the mean, or the mean without the first."""
    if mode not in POOLINGS:
        raise ValueError(f"pooling {mode!r}; one of {POOLINGS}")
    tokens = col(tokens).cast("array<array<double>>")
    if mode == "cls":
        return F.get(tokens, F.lit(0))
    return mean_of_vectors(tokens if mode == "mean" else F.slice(tokens, F.lit(2), F.size(tokens)))


def guarded_ratio(a: Column, b: Column, at: float = 1e-12) -> Column:
    """a / b, null where b is zero for all purposes."""
    return F.when(F.abs(b) > at, a / b)


def searchsorted(values: Column, x: Column) -> Column:
    """Number of elements of a sorted array that are less than ``x``."""
    return F.size(F.filter(values, lambda v: v < x))


def cumulative(values: Column) -> Column:
    """Running sums of an array."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("a"))
    return F.aggregate(values, start, lambda s, v: F.struct((s["s"] + v).alias("s"), F.concat(s["a"], F.array(s["s"] + v)).alias("a")), lambda s: s["a"])


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
