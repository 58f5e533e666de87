"""Which URLs lie below seeds, for lists of seeds of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusieve.functions.urls import path


def seed_path(seed: Column) -> Column:
    """What of a seed the paths below it begin with: what follows its host, without query, fragment and
    slashes at its end; / where nothing is left."""
    below = F.regexp_extract(F.regexp_replace(seed, r"(?s)\A.*?://", ""), r"(?s)\A[^/]*/(.*)\z", 1)
    own = F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract(below, r"\A[^?#]*", 0)), r"/+\z", "")
    return F.when(own == "", "/").otherwise(own)


def prefixes(at: Column) -> Column:
    """A path and what it is cut to at each of its slashes."""
    parts = F.split(at, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scoped(pages: DataFrame, seeds: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with in_scope: whether the path is that of one of seeds(seed), or below it; all are where there
    is no seed, or one without a path. A null URL is in scope then, else null; null seeds don't count.

    The same as ``functions.urls.in_scope``, whose predicates grow with the seeds: here the distinct paths are
    cut at their slashes, and these prefixes meet the seeds' paths by an equality, however many those are.
    """
    own = seeds.where("seed is not null").select(seed_path(F.col("seed")).alias("_prefix")).distinct()
    every = own.agg((F.coalesce(F.max((F.col("_prefix") == "/").cast("int")), F.lit(1)) == 1).alias("_every"))  # one row
    at = F.when(path(F.col(url)) == "", "/").otherwise(path(F.col(url)))
    paths = pages.select(at.alias("_at")).where("_at is not null").distinct()
    below = paths.select("_at", F.explode(prefixes(F.col("_at"))).alias("_prefix")).join(own, "_prefix", "left_semi").select("_at").distinct()
    found = pages.withColumn("_at", at).join(below.withColumn("_below", F.lit(True)), "_at", "left").join(F.broadcast(every), F.lit(True), "left")
    answer = F.when(F.col("_every") | F.col("_below"), True).when(F.col("_at").isNotNull(), False)
    return found.select(*pages.columns, answer.alias("in_scope"))
