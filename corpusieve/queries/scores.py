"""Queries over documents with embeddings and labels: scores, gate, hybrid search, learning.

A label is a review: quality 1 without toxicity is high_value, any other label irrelevant. Topic
similarity is to the mean of the first five embeddings, a host's penalty follows from its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusieve.functions import text as T
from corpusieve.functions import vectors as V
from corpusieve.operators import entities, feedback, learning, matching, scoring, search, state
from corpusieve.plans.patterns import compile_pack
from corpusieve.queries.documents import DENSITY, ORACLES as DOCUMENT_SQL
from corpusieve.queries.documents import redaction_max, sql_bm25, sql_count, sql_mentions
from corpusieve.runtime import table, written
from corpusieve.sources import sinks

PACK, SINGLE = ["that", "with"], ["license", "copyright", "nicht", "dans"]


def review_rows(spark: SparkSession, d: str) -> DataFrame:
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "high_value").otherwise("irrelevant")
    return table(spark, d, "labels").select("doc_id", status.alias("status"))


_REVIEWS = "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'high_value' ELSE 'irrelevant' END AS status FROM labels"


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), V.doubles(F.col("embedding")).alias("e"), V.norm(F.col("embedding")).alias("e_norm"))


def similarities(spark, d) -> DataFrame:
    """doc_id, topic, high, low and query similarity of every document with an embedding."""
    own = vectors(spark, d)
    reviewed = V.mean_vectors(own.join(review_rows(spark, d), "doc_id"), ["status"], "e")
    topic = V.mean_vectors(own.where("doc_id < 5").withColumn("status", F.lit("topic")), ["status"], "e")
    query = own.where("doc_id = 0").select(F.lit("query").alias("status"), F.col("e").alias("vector"), F.lit(1).cast("long").alias("count"))
    means = reviewed.unionByName(topic).unionByName(query).groupBy().pivot("status", ["topic", "high_value", "irrelevant", "query"]).agg(F.first("vector"))
    met = own.join(F.broadcast(means), F.lit(True), "inner")  # one row
    cos = {name: V.cosine(F.col("e"), F.col("e_norm"), F.col(c), V.norm(F.col(c))) for name, c in (("topic", "topic"), ("high", "high_value"), ("low", "irrelevant"), ("semantic", "query"))}
    return met.select("doc_id", *[c.alias(n) for n, c in cos.items()])


def scored(spark, d, only: DataFrame | None = None) -> DataFrame:
    """doc_id, source, title, n, topic, high, low, semantic, density, penalty, relevance. With
    ``only``(doc_id), a bounded list, texts of other documents are not looked at."""
    text = F.coalesce("text", F.lit(""))
    n = sum((F.regexp_count(text, F.lit(p.java)) for p in compile_pack(PACK)), F.lit(0))
    every = table(spark, d, "documents")
    if only is not None:
        every = every.join(F.broadcast(only.select("doc_id")), "doc_id", "left_semi")
    docs = every.select("doc_id", "source", T.first_line(text).alias("title"), n.alias("n"), entities.density(text, T.word_count(text)).alias("density"), (F.regexp_extract("source", r"(\d+)", 1).cast("int") % 5 * 0.05).alias("penalty"))
    own = docs.join(similarities(spark, d), "doc_id")
    return own.withColumn("relevance", scoring.relevance(F.col("topic"), F.col("high"), F.col("low"), F.col("penalty"), F.col("density")))


_COS = "list_inner_product(v.e, {0}.c) / (v.n * sqrt(list_inner_product({0}.c, {0}.c)))"
_MEAN = "SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v JOIN {0}) GROUP BY i)"
_SCORED = f"""
  SELECT *, (CASE WHEN density <= 0 THEN 0.75 ELSE 1.0 END)::DOUBLE * (0.75 * topic + 0.25 * (high - low) - penalty) AS relevance FROM (
    WITH v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
    r AS ({_REVIEWS}), t AS ({_MEAN.format("(SELECT doc_id FROM v WHERE doc_id < 5) USING (doc_id)")}),
    h AS ({_MEAN.format("(SELECT doc_id FROM r WHERE status = 'high_value') USING (doc_id)")}), l AS ({_MEAN.format("(SELECT doc_id FROM r WHERE status = 'irrelevant') USING (doc_id)")}),
    q AS (SELECT e AS c FROM v WHERE doc_id = 0)
    SELECT v.doc_id, v.e, source, string_split(text, chr(10))[1] AS title, {" + ".join(sql_count(k) for k in PACK)} AS n, {DENSITY} AS density, regexp_extract(source, '([0-9]+)', 1)::INT % 5 * 0.05::DOUBLE AS penalty,
           {_COS.format("t")} AS topic, {_COS.format("h")} AS high, {_COS.format("l")} AS low, {_COS.format("q")} AS semantic
    FROM v JOIN documents USING (doc_id), t, h, l, q)
"""


def relevance_score(spark, d):
    return scored(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("topic", "density", "relevance")])


def gate_decision(spark, d):
    own = scored(spark, d)
    boost, p = F.col("high") - F.col("low"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 100) / 100.0)
    n = scoring.counted_hits(F.col("n"), F.col("topic"), F.col("relevance"))
    return own.select("doc_id", n.cast("long").alias("n"), scoring.passes(F.col("topic"), F.col("density"), F.col("relevance"), n, boost, p).alias("flagged"))


GATE_SQL = f"""
SELECT doc_id, k AS n, CASE WHEN p >= 0.8 THEN true WHEN p <= 0.2 AND k < 2 THEN false WHEN high - low >= 0.22 THEN true WHEN high - low <= -0.22 AND k < 2 THEN false
  ELSE (topic >= 0.2 AND density >= 0.001) OR (relevance >= 0.18 AND k >= 2) OR relevance >= 0.18 + 0.08 END AS flagged
FROM (SELECT *, CASE WHEN n = 1 AND topic < 0.2 AND relevance < 0.18 THEN 0 ELSE n END AS k, CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 / 100.0 END AS p FROM ({_SCORED}))
"""


def hybrid_search(spark, d):
    found = written(search.rank_scores(search.find(search.with_title(table(spark, d, "documents")), "that OR with", 250)), "hybrid-found")
    own = written(scored(spark, d, found).select("doc_id", "penalty", "relevance", "semantic", "high", "low"), "hybrid-scored")
    best = scoring.best_similarities(found, own.select("doc_id", "semantic", "high", "low"))
    rows = scoring.with_reviews(best.join(own.select("doc_id", "penalty", "relevance"), "doc_id", "left"), review_rows(spark, d))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = scoring.hybrid(F.col("keyword_rank"), F.col("semantic"), F.col("high") - F.col("low"), zero("relevance"), zero("penalty"), F.col("review_status"))
    return scoring.ranked(rows.withColumn("score", F.round(score, 6)), "score", 200).select("doc_id", F.col("place").cast("long").alias("place"), "score", "review_status")


HYBRID_SQL = f"""
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, score, review_status FROM (
  SELECT doc_id, coalesce(status, 'new') AS review_status, round((n + 1 - rank) / n::DOUBLE + 2 * greatest(0, coalesce(semantic, 0)) + 1.4 * (greatest(0, coalesce(high, 0)) - greatest(0, coalesce(low, 0)))
         + 0.7 * tanh(1.5 * coalesce(relevance, 0)) - 0.35 * coalesce(penalty, 0) + CASE status WHEN 'high_value' THEN 0.35 WHEN 'irrelevant' THEN -0.60 ELSE 0 END, 6) AS score
  FROM (SELECT doc_id, row_number() OVER (ORDER BY bm25, doc_id) AS rank, count(*) OVER () AS n FROM (SELECT * FROM ({sql_bm25("that", "with")}) ORDER BY bm25, doc_id LIMIT 250))
  LEFT JOIN (SELECT doc_id, semantic, high, low, relevance, penalty FROM ({_SCORED})) USING (doc_id) LEFT JOIN ({_REVIEWS}) USING (doc_id)
) ORDER BY place LIMIT 200
"""


def semantic_sorted_index(spark, d):
    """The lines in the order of the index; what they are sorted by is kept, since a sort reads its input twice."""
    own = scoring.with_reviews(scored(spark, d), review_rows(spark, d)).select("doc_id", F.col("relevance").alias("relevance_score"), F.col("topic").alias("topic_similarity"), F.col("density").alias("entity_density"), "review_status", F.concat(F.lit("p/"), "doc_id").alias("local_path"), F.col("source").alias("url"), "title")
    return sinks.index_lines(written(own.drop("doc_id"), "index-scored"))


INDEX_SQL = f"""
SELECT printf('%.4f', relevance) AS relevance_score, printf('%.4f', topic) AS topic_similarity, printf('%.6f', density) AS entity_density, coalesce(status, 'new') AS review_status,
       'p/' || doc_id AS local_path, source AS url, title FROM ({_SCORED}) LEFT JOIN ({_REVIEWS}) USING (doc_id)
"""

MODEL = learning.Flagger([((i * 37) % 11 - 5) / 10 for i in range(67)], 0.1, [0.1, 0.2, 0.0], [0.5, 0.25, 0.0])


def flagger_predict(spark, d):
    own = scored(spark, d).join(vectors(spark, d), "doc_id")
    p = learning.probability(MODEL, F.col("e"), [F.col("relevance"), F.col("topic"), F.col("density")])
    return own.select("doc_id", F.round(p, 6).alias("p"))


PREDICT_SQL = f"""
SELECT doc_id, round(1 / (1 + exp(-(0.1 + list_inner_product(e, {MODEL.weights[:64]}::DOUBLE[]) + {MODEL.weights[64]} * (relevance - 0.1) / 0.5 + {MODEL.weights[65]} * (topic - 0.2) / 0.25 + {MODEL.weights[66]} * density))), 6) AS p FROM ({_SCORED})
"""


def standardize(spark, d):
    own = scored(spark, d).select("doc_id", "relevance", "topic", F.lit(3.0).alias("fixed"))
    return learning.standardised(own, ["relevance", "topic", "fixed"]).select("doc_id", *[F.round(f"z_{c}", 6).alias(c) for c in ("relevance", "topic", "fixed")])


STANDARD_SQL = f"SELECT doc_id, round((relevance - avg(relevance) OVER ()) / stddev_pop(relevance) OVER (), 6) AS relevance, round((topic - avg(topic) OVER ()) / stddev_pop(topic) OVER (), 6) AS topic, 0.0::DOUBLE AS fixed FROM ({_SCORED})"


def train_flagger(spark, d):
    """Metrics of a flagger on the quarter of reviewed documents that it never saw."""
    own = scored(spark, d).join(vectors(spark, d), "doc_id").join(review_rows(spark, d), "doc_id")
    rows = own.select("doc_id", F.col("e").alias("embedding"), (F.col("status") == "high_value").cast("int").alias("label"), F.col("relevance").alias("relevance_score"), F.col("topic").alias("topic_similarity"), F.col("density").alias("entity_density"))
    model = learning.train(rows.where(~learning.held_out(F.col("doc_id"))))
    test = rows.where(learning.held_out(F.col("doc_id")))
    p = learning.probability(model, F.col("embedding"), [F.col(m) for m in learning.METRICS]) if model else F.lit(0.5)
    return learning.metrics(test.select("label", p.alias("score")))


def classifier_metrics(spark, d):
    own = table(spark, d, "labels").select(F.col("quality").alias("label"), ((F.col("doc_id") * 7 + F.col("quality") * 3) % 17 / 17.0).alias("score"))
    return learning.metrics(own).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("auc", 6).alias("auc"))


METRICS_SQL = """
WITH s AS (SELECT quality AS label, (doc_id * 7 + quality * 3) % 17 / 17.0::DOUBLE AS score FROM labels),
r AS (SELECT *, (rank() OVER (ORDER BY score) + count(*) OVER (ORDER BY score) ) / 2.0 AS rk FROM s)
SELECT count(*) AS n, round(avg(((score >= 0.5)::INT = label)::INT), 6) AS accuracy,
       round(((sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))))::DOUBLE, 6) AS auc FROM r
"""


def _found(spark, d, pack: list[str]) -> DataFrame:
    return matching.hit_counts(table(spark, d, "documents"), compile_pack(pack))


def _sql_found(pack: list[str]) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern, {sql_count(k)} AS n_hits FROM documents" for k in pack) + ") WHERE n_hits > 0"


def phrase_blacklist(spark, d):
    log = review_rows(spark, d).select("doc_id", F.col("status").alias("label"), F.col("doc_id").alias("ts"), F.lit(0).alias("seq"))
    return feedback.phrase_blacklist(log, _found(spark, d, SINGLE)).withColumn("rank", F.col("rank").cast("long"))


BLACKLIST_SQL = f"""
SELECT pattern, row_number() OVER (ORDER BY first_at DESC, pattern) AS rank FROM (SELECT pattern, min(doc_id) AS first_at FROM (
  SELECT doc_id, min(pattern) AS pattern FROM ({_sql_found(SINGLE)}) GROUP BY doc_id HAVING count(*) = 1) JOIN ({_REVIEWS}) USING (doc_id) WHERE status = 'irrelevant' GROUP BY pattern)
"""


def _parts(spark, d) -> tuple[DataFrame, dict]:
    docs = table(spark, d, "documents")
    flagged = scoring.with_reviews(scoring.flagged(docs.select("doc_id", "source"), _found(spark, d, SINGLE)), review_rows(spark, d))
    ents = entities.merged(entities.extract(docs)).select("doc_id", "label", "canonical", "count")
    return flagged, {"matches": (_found(spark, d, SINGLE), ["pattern"]), "entities": (ents, ["label", "canonical"])}


def export_flagged_nested(spark, d):
    flagged, parts = _parts(spark, d)
    return sinks.nested(flagged, parts).select("doc_id", F.to_json(F.struct("source", "review_status", "matches", "entities")).alias("document"))


def export_flagged_counts(spark, d):
    flagged, parts = _parts(spark, d)
    return sinks.nested(flagged, parts).select("doc_id", "review_status", F.size("matches").cast("long").alias("n_matches"))


def _sql_mentions() -> str:
    """doc_id, label and canonical of every mention; those told by digits are found in texts whose
    separators are doubled, which their digits don't show."""
    parts = []
    for label, count in sql_mentions().items():
        found = count[len("len(") : -1]
        form = "regexp_replace(m, '[^0-9]', '', 'g')" if label in ("PHONE", "SSN") else "trim(lower(m), ' \"''`.,;:()[]{}<>')"
        parts.append(f"SELECT doc_id, '{label}' AS label, {form} AS canonical FROM (SELECT doc_id, unnest({found}) AS m FROM documents)")
    return " UNION ALL ".join(parts)


NESTED_SQL = f"""
SELECT doc_id, to_json({{'source': source, 'review_status': coalesce(status, 'new'), 'matches': m, 'entities': coalesce(e, [])}})::VARCHAR AS document
FROM (SELECT doc_id, list({{'pattern': pattern, 'n_hits': n_hits}} ORDER BY pattern) AS m FROM ({_sql_found(SINGLE)}) GROUP BY doc_id)
JOIN documents USING (doc_id) LEFT JOIN ({_REVIEWS}) USING (doc_id) LEFT JOIN (
  SELECT doc_id, list({{'label': label, 'canonical': canonical, 'count': n}} ORDER BY label, canonical) AS e FROM (
    SELECT doc_id, label, canonical, count(*) AS n FROM ({_sql_mentions()}) WHERE canonical <> '' GROUP BY ALL) GROUP BY doc_id) USING (doc_id)
"""

EXPORT_SQL = f"SELECT doc_id, coalesce(status, 'new') AS review_status, count(*) AS n_matches FROM ({_sql_found(SINGLE)}) LEFT JOIN ({_REVIEWS}) USING (doc_id) GROUP BY 1, 2"


def purge_derived(spark, d):
    tables = {"matches": _found(spark, d, SINGLE), "doc_reviews": review_rows(spark, d)}
    left = state.purge(tables, table(spark, d, "documents").where("doc_id % 5 = 0").select("doc_id"))
    return left["matches"].groupBy("pattern").agg(F.count("*").alias("n")).unionByName(left["doc_reviews"].groupBy(F.col("status").alias("pattern")).agg(F.count("*").alias("n")))


PURGE_SQL = f"SELECT pattern, count(*) AS n FROM ({_sql_found(SINGLE)}) WHERE doc_id % 5 <> 0 GROUP BY 1 UNION ALL SELECT status, count(*) FROM ({_REVIEWS}) GROUP BY 1"


def flagged_with_metrics(spark, d):
    own = scoring.flagged(scored(spark, d).select("doc_id", "source", F.round("relevance", 6).alias("relevance")), _found(spark, d, PACK))
    return scoring.ranked(scoring.with_reviews(own, review_rows(spark, d)), "relevance", 500).drop("place")


def search_with_metrics(spark, d):
    found = written(search.find(search.with_title(table(spark, d, "documents")), "license OR copyright", 250).select("doc_id", F.round("bm25", 6).alias("bm25")), "search-found")
    rows = found.join(scored(spark, d, found).select("doc_id", F.round("relevance", 6).alias("relevance")), "doc_id", "left")
    return scoring.with_reviews(rows, review_rows(spark, d))


def results_list(spark, d):
    own = scoring.with_reviews(scoring.flagged(table(spark, d, "documents").select("doc_id"), _found(spark, d, SINGLE)), review_rows(spark, d))
    return own.join(redaction_max(spark, d).withColumnRenamed("score", "_r"), "doc_id", "left").select("doc_id", "match_count", "review_status", F.coalesce("_r", F.lit(0.0)).alias("redaction"))


def label_places(spark, d):
    """The best three documents of each review, by relevance."""
    own = scored(spark, d).join(review_rows(spark, d), "doc_id").select("status", "doc_id", F.round("relevance", 6).alias("relevance"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("relevance"), "doc_id")).cast("long")).where("place <= 3")


QUERIES = {
    f.__name__: f
    for f in (flagged_with_metrics, search_with_metrics, results_list, relevance_score, gate_decision, hybrid_search, semantic_sorted_index, flagger_predict, standardize)
    + (train_flagger, classifier_metrics, phrase_blacklist, export_flagged_nested, export_flagged_counts, purge_derived, label_places)
}

ORACLES = {
    "flagged_with_metrics": f"""SELECT doc_id, source, round(relevance, 6) AS relevance, match_count, coalesce(status, 'new') AS review_status FROM (SELECT doc_id, source, relevance FROM ({_SCORED}))
        JOIN (SELECT doc_id, sum(n_hits)::BIGINT AS match_count FROM ({_sql_found(PACK)}) GROUP BY 1) USING (doc_id) LEFT JOIN ({_REVIEWS}) USING (doc_id) ORDER BY round(relevance, 6) DESC, doc_id LIMIT 500""",
    "search_with_metrics": f"""SELECT doc_id, round(bm25, 6) AS bm25, round(relevance, 6) AS relevance, coalesce(status, 'new') AS review_status FROM (SELECT * FROM ({sql_bm25("license", "copyright")}) ORDER BY bm25, doc_id LIMIT 250)
        LEFT JOIN (SELECT doc_id, relevance FROM ({_SCORED})) USING (doc_id) LEFT JOIN ({_REVIEWS}) USING (doc_id)""",
    "results_list": f"""SELECT doc_id, match_count, coalesce(status, 'new') AS review_status, coalesce(score, 0.0)::DOUBLE AS redaction FROM (SELECT doc_id, sum(n_hits)::BIGINT AS match_count FROM ({_sql_found(SINGLE)}) GROUP BY 1)
        LEFT JOIN ({_REVIEWS}) USING (doc_id) LEFT JOIN ({DOCUMENT_SQL["redaction_max"]}) USING (doc_id)""",
    "relevance_score": f"SELECT doc_id, round(topic, 6) AS topic, round(density, 6) AS density, round(relevance, 6) AS relevance FROM ({_SCORED})",
    "gate_decision": GATE_SQL,
    "hybrid_search": HYBRID_SQL,
    "semantic_sorted_index": INDEX_SQL,
    "flagger_predict": PREDICT_SQL,
    "standardize": STANDARD_SQL,
    "classifier_metrics": METRICS_SQL,
    "phrase_blacklist": BLACKLIST_SQL,
    "export_flagged_nested": NESTED_SQL,
    "export_flagged_counts": EXPORT_SQL,
    "purge_derived": PURGE_SQL,
    "label_places": f"""SELECT * FROM (SELECT status, doc_id, round(relevance, 6) AS relevance, row_number() OVER (PARTITION BY status ORDER BY round(relevance, 6) DESC, doc_id) AS place
        FROM (SELECT doc_id, relevance FROM ({_SCORED})) JOIN ({_REVIEWS}) USING (doc_id)) WHERE place <= 3""",
}
