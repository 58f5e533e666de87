"""Spans joined at the seams of ranges, and seeds met by prefixes, equal what a walk along each row gives."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from corpusieve.functions import urls
from corpusieve.operators import scope, state


def merged(rows):
    out = {}
    for k, a, b in sorted((r for r in rows if None not in r[1:]), key=lambda r: (str(r[0]), r[1], r[2])):
        own = out.setdefault(k, [])
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], b))
        else:
            own.append((a, b))
    return sorted(((k, *s) for k, own in out.items() for s in own), key=str)


def test_spans_of_a_hot_key_meet_at_the_seams(spark):
    dice = random.Random(4)
    rows = []
    for key, n, room, longest in (("hot", 400, 900, 4), ("dense", 60, 300, 30), (None, 60, 300, 6), ("chain", 0, 0, 0)):
        rows += [(key, a, a + dice.randrange(longest + 1)) for a in (dice.randrange(room) for _ in range(n))]
    rows += [("chain", a, a + 10) for a in range(0, 900, 10)]  # one span over all ranges
    rows += [("chain", 5, 2000), ("one", 7, 7), ("one", 7, 7), ("long", 0, 1000), ("long", 500, 510), ("long", 999, 1001), ("no", None, 4), ("no", 4, None)]
    spans = spark.createDataFrame(rows, "k string, a int, b int").repartition(3)
    for ranges in (1, 2, 7):
        got = sorted((tuple(r) for r in state.merged_spans(spans, "k", ranges).collect()), key=str)
        assert got == merged(rows), ranges
    assert state.merged_spans(spans.limit(0), "k", 3).count() == 0


def test_a_hot_key_lies_in_several_ranges(spark):
    spans = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("a"), (F.col("id") + 2).alias("b"))
    sizes = [r["count"] for r in state.segmented(spans, "a", "r", 8).groupBy("r").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700
    assert [tuple(r) for r in state.merged_spans(spans, "k", 8).collect()] == [(1, 0, 4001)]


def test_spans_do_not_depend_on_the_order_of_arrival(spark):
    """Rows are dealt out in another way each time that they are computed, and Spark reuses no exchange."""
    dealt = lambda batches: (b.assign(r=[random.random() for _ in range(len(b))]) for b in batches)
    own = spark.range(0, 60_000, 1, 4).select((F.col("id") % 30).alias("k"), (F.col("id") * 7919 % 60_000).alias("a"), F.col("id"))
    spans = own.select("k", "a", (F.col("a") + F.col("id") % 37).alias("b"))
    rows = [tuple(r) for r in spans.collect()]
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = [tuple(r) for r in state.merged_spans(spans.mapInPandas(dealt, "k long, a long, b long, r double").repartition(4, "r"), "k", 50).collect()]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted(got, key=str) == merged(rows)


PAGES = ["https://x/a", "https://x/a/", "https://x/a/b", "https://x/ab", "https://y/a/b/c?q=/z", "http://x", "https://x/", "/a/b#f", "x//a", "", None, "https://x/a//b", "https://x/é/ü"]
SEEDS = ["https://x/a/", "https://x/a/b?c=d", "https://x/é", "x/ab#z", "https://q", "", "https://x//", "https://x/a//b", "a://b://c/a"]


def test_seeds_meet_pages_by_prefixes(spark):
    pages = spark.createDataFrame([(i % 3, u) for i, u in enumerate(PAGES * 2)], "n int, url string")
    for chosen in [[], *([s] for s in SEEDS), *map(list, itertools.combinations(SEEDS[:4], 2))]:
        seeds = spark.createDataFrame([(s,) for s in [*chosen, None]], "seed string")
        got = sorted((tuple(r) for r in scope.scoped(pages, seeds).collect()), key=str)
        want = pages.select("n", "url", urls.in_scope(F.col("url"), chosen).alias("in_scope"))
        assert got == sorted((tuple(r) for r in want.collect()), key=str), chosen


def test_many_seeds(spark):
    seeds = spark.range(100_000).select(F.concat(F.lit("https://s/d"), F.col("id").cast("string"), F.lit("/")).alias("seed"))
    pages = spark.range(0, 400_000, 100).select(F.concat(F.lit("https://p/d"), F.col("id").cast("string"), F.lit("/x/y.html")).alias("url"))
    assert {r.in_scope: r["count"] for r in scope.scoped(pages, seeds).groupBy("in_scope").count().collect()} == {True: 1000, False: 3000}
