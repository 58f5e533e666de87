"""Operator 12: how filters interact, whatever the order in which they are applied.

Which filters a document fails is one mask. What a filter does at a step depends only on the set of
filters before it, so all 120 orders of five filters walk the same lattice of sets: 80 edges, each from
a set to that set and one filter more. Documents are counted by part, mask and label first, these few
counts contribute to the edges, and every step of every order reads its edge.

Filters, as conditions under which a document (null text: empty; words stand between ASCII white space)
fails: A under 50 words; B fewer than 65 distinct words of 100; C over 5 of 100 code points are A-Z; D
holds one of #$%&*|; E its text is that of a smaller doc_id, anywhere in the table.

A null source is the part of the empty string. Rows without doc_id have no smaller one, are none, and have
no label; rows that share a doc_id are no copies of one another. Of several labels of a document the
greatest counts. An empty table has no parts, so no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.runtime import table

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The conditions that a text alone decides, by filter."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE, -1), lambda w: w != "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: the k-th filter fails), good, toxic and n: how many documents are so.

    The first document of each text is found by an aggregate over digests and joined on digest and doc_id
    together, so a text that many documents share is no hot key.
    """
    text = F.coalesce("text", F.lit(""))
    bits = F.lit(0)
    for name, fails in failures(F.col("text")).items():
        bits = bits + F.when(fails, 1 << FILTERS.index(name)).otherwise(0)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("bits"))
    firsts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = own.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copied = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    return both.groupBy("part", (F.col("bits") + copied).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def edges(counted: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, applied (the set before, as bits), filter (its number), the counts of that edge and
    weighted (removed, times the orders that pass the edge)."""
    every = [F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("own"), F.lit(factorial(s.bit_count()) * factorial(filters - 1 - s.bit_count())).cast("long").alias("orders")) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]
    rows = counted.select("*", F.inline(F.array(*every)))
    n, own = F.col("n"), F.col("own")
    before, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(own) != 0
    removed = ~before & fails
    tests = {"kept": ~before & ~fails, "removed": removed, "redundant": before & fails, "unique_fails": F.col("mask") == own, "good_lost": removed & (F.col("good") == 1), "toxic_lost": removed & (F.col("toxic") == 1)}
    sums = [F.sum(F.when(tests[c], n).otherwise(0)).alias(c) for c in _COUNTS]
    return rows.groupBy("part", "applied", "filter").agg(*sums, F.sum(F.when(removed, n * F.col("orders")).otherwise(0)).alias("weighted"))


def paths(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order, step (from 1), applied and filter: every step of every order, as an edge."""
    rows = []
    for order in permutations(range(len(filters))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[k] for k in order), step, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    counted = edges(masks(docs, labels))
    shapley = counted.groupBy("part", "filter").agg(F.sum("weighted").alias("shapley"))
    both = counted.join(shapley, ["part", "filter"])
    steps = both.join(F.broadcast(paths(docs.sparkSession)), ["applied", "filter"])  # 600 rows
    return steps.select("part", "filter_order", "step", *_COUNTS, "shapley")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on all documents."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    MAP {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
      'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < t.doc_id, false)} AS fails
  FROM texts t JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = t.doc_id),
tallies AS (SELECT part, good, toxic, fails, count(*) AS n FROM docs GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS f,
    string_split(substr(filter_order, 1, step::INTEGER - 1), '') AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
walked AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failing,
    list_bool_or([coalesce(fails[b], false) FOR b IN before]) IS TRUE AS gone,
    fails[f] AND len([x FOR x IN map_values(fails) IF x]) = 1 AS alone
  FROM tallies, steps),
counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND failing), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM counted
"""
