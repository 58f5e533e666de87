"""Column expressions over arrays of numbers; sums are in double, in order of position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the length of the shorter one."""
    both = F.zip_with(doubles(a), doubles(b), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, a_norm: Column, b: Column, b_norm: Column) -> Column:
    """0 where a norm is not positive."""
    return F.when((a_norm > 0) & (b_norm > 0), dot(a, b) / (a_norm * b_norm)).otherwise(F.lit(0.0))


def mean_vectors(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """``by``, vector and count: the component-wise mean of each group, over the common length.

    Components are exploded and averaged with partial sums, so no group is gathered in one place.
    """
    own = df.where(F.size(vector) > 0)
    sizes = own.groupBy(*by).agg(F.min(F.size(vector)).alias("_n"), F.count("*").alias("count"))
    means = own.select(*by, F.posexplode(doubles(F.col(vector))).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg("_x").alias("_m"))
    whole = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    out = whole.join(sizes, by)
    return out.select(*by, F.slice(F.transform("_v", lambda p: p["_m"]), F.lit(1), F.col("_n")).alias("vector"), "count")


def online_mean(mean: Column, count: Column, vector: Column) -> Column:
    """The mean after one more vector."""
    return F.zip_with(doubles(mean), doubles(vector), lambda m, x: (m * count + x) / (count + 1))


def merged_means(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """``by``, i and x: where ``online_mean`` ends for each group, without its order.

    Each task folds its rows to a (sum, count) for each group and component, and these are merged.
    """
    own = df.select(*by, F.posexplode(doubles(F.col(vector))).alias("i", "_x"))
    states = own.groupBy(*by, "i").agg(F.sum("_x").alias("_s"), F.count("_x").alias("_n"))
    return states.select(*by, "i", (F.col("_s") / F.col("_n")).alias("x"))
