"""The ingest plan: from documents to hits, entities, scores, the gate and where files go.

One lazy plan with several outputs. What all of them need, the features of each document, is written
to the shared folder once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusieve.functions.text import first_line, word_count
from corpusieve.functions.urls import authority
from corpusieve.functions.vectors import cosine, norm
from corpusieve.operators import embedding, entities, learning, matching, redaction, scoring
from corpusieve.plans.patterns import compile_pack
from corpusieve.runtime import written
from corpusieve.settings import Settings


@dataclass(frozen=True)
class Model:
    """What earlier runs taught; each part may be missing."""

    topic: list[float] | None = None
    high_value: list[float] | None = None
    irrelevant: list[float] | None = None
    penalties: DataFrame | None = None  # host, penalty
    flagger: learning.Flagger | None = None


def triage(docs: DataFrame, settings: Settings, provider: Callable[[], embedding.Provider] | None = None, model: Model | None = None) -> dict[str, DataFrame]:
    """Tables by name of docs(doc_id, url, text): documents (title, sha256, metrics, gate, bucket, path),
    matches, doc_entities and doc_page_flags, all with the digest of the text. Equal texts are one document,
    the least by doc_id (null ones last) and url; different texts are as many documents, also if they share a
    doc_id. Hits are kept for documents that are not flagged as well."""
    model, provider = model or Model(), embedding.available(provider)
    text = F.coalesce("text", F.lit(""))
    row = F.struct(F.col("doc_id").isNull().alias("_none"), *[F.col(c) for c in ("doc_id", "url", "text")])
    least = docs.groupBy(F.sha2(text, 256).alias("sha256")).agg(F.min(row).alias("_row"))
    # the digest is what tables are joined by; ids come back at the end
    own = written(least.select("sha256", F.col("sha256").alias("doc_id"), F.col("_row.doc_id").alias("id"), "_row.url", "_row.text"), "triage-own")  # all that follows reads it
    ids = own.select("sha256", F.col("id").alias("doc_id"))

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("doc_id", "sha256").join(ids, "sha256")

    pack = compile_pack(list(settings.keywords), set(settings.stopwords), docs.sparkSession)
    hits = matching.capped(matching.hits(own, pack)).select("doc_id", "method", "pattern", "pattern_order", "hit", "score", "snippet") if pack else None
    if settings.query:
        asked = matching.boolean_hits(own, settings.query).withColumns({"pattern_order": F.lit(1 << 20), "hit": F.lit(0)})
        hits = asked if hits is None else hits.unionByName(asked)
    if settings.fuzzy_enabled and (fuzzy := matching.fuzzy_keywords(list(settings.keywords))):
        close = matching.fuzzy_hits(own, fuzzy).withColumns({"method": F.lit("fuzzy"), "pattern_order": F.lit(1 << 21), "hit": F.lit(0)})
        hits = close if hits is None else hits.unionByName(close)
    if hits is None:
        raise ValueError("nothing to look for: no usable keyword and no query")
    matches = written(matching.deduplicated(hits), "triage-matches")

    base = own.select("doc_id", "url", "sha256", "id", first_line(text).alias("title"), entities.density(text, word_count(text)).alias("entity_density"))
    features = base.join(matches.groupBy("doc_id").agg(F.count("*").alias("n_hits")), "doc_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    if model.penalties is not None:
        features = features.join(model.penalties.select(F.col("host").alias("_host"), F.col("penalty").alias("url_penalty")), authority(F.col("url")) == F.col("_host"), "left").drop("_host")
        features = features.withColumn("url_penalty", F.coalesce("url_penalty", F.lit(0.0)))
    else:
        features = features.withColumn("url_penalty", F.lit(0.0))
    if provider is not None and model.topic:
        vectors = embedding.whole(own, provider)
        to = lambda v: cosine(F.col("vector"), F.col("norm"), _array(v), norm(_array(v))) if v else F.lit(0.0)
        features = features.join(vectors, "doc_id").withColumns({"topic_similarity": to(model.topic), "_high": to(model.high_value), "_low": to(model.irrelevant)})
    else:
        features = features.withColumns({"vector": F.lit(None).cast("array<float>"), "topic_similarity": F.lit(None).cast("double"), "_high": F.lit(0.0), "_low": F.lit(0.0)})
    features = features.withColumn("relevance_score", scoring.relevance(F.col("topic_similarity"), F.col("_high"), F.col("_low"), F.col("url_penalty"), F.col("entity_density")))
    p = learning.probability(model.flagger, F.col("vector"), [F.col(m) for m in learning.METRICS]) if model.flagger else F.lit(None).cast("double")
    counted = F.coalesce(scoring.counted_hits(F.col("n_hits"), F.col("topic_similarity"), F.col("relevance_score")), F.col("n_hits"))
    gated = features.withColumn("passes_relevance", scoring.passes(F.col("topic_similarity"), F.col("entity_density"), F.col("relevance_score"), counted, F.col("_high") - F.col("_low"), p))
    path = scoring.flagged_path("flagged", F.col("sha256"), "txt", settings.storage_layout, F.col("title"))
    out = gated.withColumns({"has_matches": F.col("n_hits") > 0, "bucket": F.when(F.col("passes_relevance"), "flagged").otherwise("triaged"), "path": F.when(F.col("passes_relevance"), path)})
    return {
        "documents": written(out.drop("vector", "norm", "_high", "_low", "doc_id").withColumnRenamed("id", "doc_id"), "triage-documents"),
        "matches": named(matches),
        "doc_entities": named(entities.merged(entities.extract(own, settings.ner_engine))),
        "doc_page_flags": named(redaction.page_flags(own)),
    }


def _array(v: list[float]):
    return F.array(*[F.lit(float(x)) for x in v])
