"""Relevance, gating, hybrid ranking and storage routing: arithmetic on columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusieve.functions.text import safe_filename


@dataclass(frozen=True)
class Thresholds:
    """Gate settings (fixed values)."""

    topic: float = 0.20
    relevance: float = 0.18
    density: float = 0.001
    margin: float = 0.08
    feedback_flag: float = 0.22
    feedback_triage: float = -0.22
    model_flag: float = 0.80
    model_triage: float = 0.20


@dataclass(frozen=True)
class Weights:
    """Hybrid ranking weights (fixed values)."""

    rank: float = 1.0
    semantic: float = 2.0
    feedback: float = 1.4
    prior: float = 0.7
    penalty: float = 0.35


def relevance(topic: Column, high: Column, low: Column, penalty: Column, density: Column) -> Column:
    """Topic and feedback similarity less the host's penalty, damped where no entity is named."""
    score = 0.75 * topic + 0.25 * (high - low) - penalty
    return F.when(density <= 0, score * 0.75).otherwise(score)


def counted_hits(n: Column, topic: Column, score: Column, t: Thresholds | None = None) -> Column:
    """Hits that remain: a single one counts for nothing where all else is weak."""
    t = t or Thresholds()
    return F.when((n == 1) & (topic < t.topic) & (score < t.relevance), 0).otherwise(n)


def passes(topic: Column, density: Column, score: Column, n: Column, boost: Column, probability: Column, t: Thresholds | None = None) -> Column:
    """Whether a document is flagged; feedback overrides the rule, the model overrides both.

    ``n`` are the counted hits. A null topic means that there are no embeddings: any hit flags.
    A null probability means that there is no model.
    """
    t = t or Thresholds()
    strong = n >= 2
    rule = ((topic >= t.topic) & (density >= t.density)) | ((score >= t.relevance) & strong) | (score >= t.relevance + t.margin)
    by_feedback = F.when(boost >= t.feedback_flag, True).when((boost <= t.feedback_triage) & ~strong, False).otherwise(rule)
    by_model = F.when(probability >= t.model_flag, True).when((probability <= t.model_triage) & ~strong, False).otherwise(by_feedback)
    return F.when(topic.isNull(), n > 0).otherwise(by_model)


def review_bias(status: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s == "high_value", 0.35).when(s == "irrelevant", -0.60).otherwise(0.0)


def hybrid(rank: Column, semantic: Column, boost: Column, prior: Column, penalty: Column, status: Column, w: Weights | None = None) -> Column:
    w = w or Weights()
    return w.rank * rank + w.semantic * semantic + w.feedback * boost + w.prior * F.tanh(1.5 * prior) - w.penalty * penalty + review_bias(status)


def best_similarities(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id and the greatest of each similarity column over a document's chunks, 0 at least.

    ``chunks``(doc_id, similarity columns) meets the candidates by one join.
    """
    names = [c for c in chunks.columns if c != "doc_id"]
    best = candidates.select("doc_id").join(chunks, "doc_id").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names])
    return candidates.join(best, "doc_id", "left").withColumns({c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))) for c in names})


def ranked(rows: DataFrame, score: str, limit: int) -> DataFrame:
    """The best ``limit`` rows with their place, ties by doc_id: a top-k, then a window over it."""
    top = rows.orderBy(F.desc(score), "doc_id").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), "doc_id")))


def flagged_path(folder: str, sha256: Column, suffix: str, layout: str, title: Column) -> Column:
    """Where a flagged file belongs: its title, shortened, and the first of its digest."""
    ending = suffix if suffix.startswith(".") or not suffix else "." + suffix
    raw = F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", "")
    raw = F.when(raw == "", "file").when(F.lower(raw).endswith(ending.lower()) & F.lit(bool(ending)), F.substring(raw, F.lit(1), F.length(raw) - len(ending))).otherwise(raw)
    base = safe_filename(F.when(sha256 == "", raw).otherwise(F.concat(raw, F.lit("__"), F.substring(sha256, 1, 10))), 110)
    name = F.concat(base, F.lit(ending))
    if layout.strip().lower() == "hashed":
        return F.when(sha256 != "", F.concat_ws("/", F.lit(folder), F.substring(sha256, 1, 2), F.substring(sha256, 3, 2), name)).otherwise(F.concat_ws("/", F.lit(folder), name))
    return F.concat_ws("/", F.lit(folder), name)


def flagged(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with at least one hit and how many, as match_count; hits are counted before they meet
    documents. ``found`` has a row for each hit, or for some of them with their number as n_hits."""
    n = F.sum("n_hits") if "n_hits" in found.columns else F.count("*")
    return docs.join(found.groupBy("doc_id").agg(n.alias("match_count")), "doc_id")


def newest_flagged(docs: DataFrame, found: DataFrame, reviews: DataFrame, limit: int = 500) -> DataFrame:
    """The flagged list: the ``limit`` documents(doc_id, fetched_at, ...) with hits that were fetched last,
    with their review; ties by doc_id, never fetched ones last."""
    return with_reviews(flagged(docs, found), reviews).orderBy(F.desc_nulls_last("fetched_at"), "doc_id").limit(limit)


def with_reviews(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    return docs.join(reviews.select("doc_id", F.col("status").alias("_s")), "doc_id", "left").withColumn("review_status", F.coalesce("_s", F.lit("new"))).drop("_s")
