"""A preview of a document with its hits marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusieve.functions.text import html_escape, located
from corpusieve.operators.state import runs
from corpusieve.plans.patterns import Pattern

PREVIEW, MATCHES = 15000, 300


def spans(docs: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """doc_id, a and b of hits in the first PREVIEW characters, overlapping ones merged."""
    text = F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW)
    found = []
    for p in patterns:
        if p.method != "wildcard":
            found.append(F.slice(F.transform(located(text, p.java), lambda m: F.struct(m["start"].alias("a"), (m["start"] + F.length(m["match"])).alias("b"))), 1, MATCHES))
    return runs(docs.select("doc_id", F.inline(F.concat(*found))), "doc_id")


def marked(text: Column, ordered: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The escaped preview with the spans, an ordered array of structs a, b, marked."""
    shown = F.substring(F.coalesce(text, F.lit("")), 1, PREVIEW)
    cut = lambda a, b: html_escape(F.substring(shown, a + 1, b - a))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walk = F.aggregate(ordered, start, lambda s, x: F.struct(x["b"].alias("at"), F.concat(s["out"], cut(s["at"], x["a"]), F.lit(before), cut(x["a"], x["b"]), F.lit(after)).alias("out")))
    return F.concat(walk["out"], cut(walk["at"], F.length(shown)))


def preview(docs: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """doc_id and html of documents with a hit."""
    own = spans(docs, patterns).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return docs.join(own, "doc_id").select("doc_id", marked(F.col("text"), F.col("spans")).alias("html"))
