"""Column expressions over arrays that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SUMMED = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it, block by block, so that what is copied
    does not grow with the square of the array."""

    def walk(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def all_of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / _SUMMED).cast("int")), lambda k: F.slice(x, k * _SUMMED + 1, F.lit(_SUMMED)))
        return once(blocks, lambda bs: F.flatten(F.zip_with(bs, walk(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda s, n: s + n)), F.lit(0)), walk)))

    return once(numbers, all_of)


def place_among(cuts: Column, most: int, value: Column) -> Column:
    """How many of the sorted ``cuts``, ``most`` at most, are not above the value: by binary search, so
    a row costs as many steps as ``most`` has bits."""
    if not most:
        return F.lit(0)
    steps = F.lit([1 << k for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, by: F.when(F.coalesce(F.get(cuts, at + by - 1) <= value, F.lit(False)), at + by).otherwise(at))
