"""Connected components of a graph whose edges are rows, by repeated contraction.

Every node moves to the neighbour with the least hash, itself included; the graph of the places
moved to is contracted in turn until no edge is left, each time by a constant factor at least on
average. Then the moves are followed from the first to the last. Each round is written to the shared
folder, so lineage stays short; nothing but "is a table empty" comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusieve.runtime import discard, written


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (one row for each node that has an edge to another) of edges(a, b)."""
    edges = written(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    moves: list[DataFrame] = []
    while not moves or not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
        least = ends.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("near"))["node"].alias("root"))
        moves.append(written(least, f"{name}-moves"))
        to = moves[-1]
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        before, edges = edges, written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
        discard(before)
    out = moves[0]
    for move in moves[1:]:
        later = move.select(F.col("node").alias("root"), F.col("root").alias("further"))
        out = out.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    out = written(out, f"{name}-roots")
    discard(edges, *moves)
    return out
