"""Vectors as array columns; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "l1")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: the plain product, of vectors that are unit ones; l2 and l1: the negated distance."""
    if metric == "cosine":
        return dot(a, b)
    if metric == "l2":
        return -F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))
    if metric == "l1":
        return -total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))
    raise ValueError(f"metric {metric!r} is not one of {METRICS}")


def normalize(v: Column, guard: str = "positive") -> Column:
    """Unit length. guard: "positive" leaves a zero vector, "eps" adds 1e-8 to the norm, "clip" takes 1e-8 at least."""
    v = doubles(v)
    by = lambda n: F.transform(v, lambda x: x / n)
    if guard == "positive":
        return F.when(norm(v) > 0, by(norm(v))).otherwise(v)
    if guard == "eps":
        return by(norm(v) + 1e-8)
    if guard == "clip":
        return by(F.greatest(norm(v), F.lit(1e-8)))
    raise ValueError(f"guard {guard!r} is not known")


def concat(a: Column, b: Column) -> Column:
    """Two embeddings as one, of unit length."""
    return normalize(F.concat(doubles(a), doubles(b)), "clip")


def blend(a: Column, b: Column, alpha: float) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (1 - alpha) * x + alpha * y)


def standardize(v: Column, mean: list[float], std: list[float]) -> Column:
    """(x / 255 - mean) / std of interleaved channels."""
    n = len(mean)
    at = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), (i % n + 1).cast("int"))
    return F.transform(doubles(v), lambda x, i: (x / 255 - at(mean, i)) / at(std, i))


def elementwise(df: DataFrame, keys: list[str], vector: str, out: str, how: str = "mean", weight: str | None = None, count: str | None = None) -> DataFrame:
    """One vector for each key: element by element the mean (weighted if weight is given) or the maximum.

    Elements are aggregated as rows, combined before the shuffle, so a key may have any number of vectors. count
    names a column for their number.
    """
    columns = [*keys, vector, *([weight] if weight else [])]
    rows = df.select(*columns).select(*keys, *([weight] if weight else []), F.posexplode(doubles(F.col(vector))).alias("_pos", "_x"))
    if how == "max":
        value = F.max("_x")
    elif weight:
        value = F.sum(F.col("_x") * F.col(weight)) / F.sum(weight)
    else:
        value = F.avg("_x")
    parts = rows.groupBy(*keys, "_pos").agg(value.alias("_x"), F.count("*").alias("_n"))
    found = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"]).alias(out)
    return parts.groupBy(*keys).agg(found, *([F.max("_n").alias(count)] if count else []))
