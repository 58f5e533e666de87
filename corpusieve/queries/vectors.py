"""Queries over embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusieve.functions import vectors as V
from corpusieve.operators import matching, pairs
from corpusieve.queries.events import REVIEWS_SQL, review_log
from corpusieve.runtime import scratch, table
from corpusieve.streaming.feedback import Feedback


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _query(spark, d, where: str) -> DataFrame:
    return rows(spark, d).where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), V.norm(F.col("embedding")).alias("q_norm"))


def vector_norm(spark, d):
    return rows(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def cosine_to_query(spark, d):
    own = rows(spark, d).select("vec_id", "embedding", V.norm(F.col("embedding")).alias("n"))
    met = own.join(F.broadcast(_query(spark, d, "vec_id = 0")), F.lit(True), "inner")  # one row
    return met.select("vec_id", F.round(V.cosine(F.col("q"), F.col("q_norm"), F.col("embedding"), F.col("n")), 6).alias("cosine"))


def semantic_topk(spark, d):
    own = rows(spark, d).select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"), V.norm(F.col("embedding")).alias("v_norm"))
    top = matching.top_by_cosine(_query(spark, d, "vec_id in (0, 1, 2)"), own, 20)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "row_id", F.round("similarity", 6).alias("similarity"))


def semantic_hits(spark, d):
    keywords = rows(spark, d).where("vec_id < 40").select(F.col("vec_id").alias("keyword_id"), F.col("embedding").alias("k"))
    found = matching.semantic_hits(keywords, rows(spark, d).select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")), 0.3, 30)
    return found.select("row_id", "keyword_id", F.round("score", 6).alias("score"))


def label_centroids(spark, d):
    own = V.mean_vectors(rows(spark, d), ["label"], "embedding")
    return own.select("label", "count", F.posexplode("vector").alias("i", "x")).select("label", F.col("count").cast("long").alias("n"), F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def online_centroid(spark, d):
    """The mean of the vectors that were last reviewed as each label, kept while the log of reviews comes in
    by parts that are out of order: a review that changes takes its vector back."""
    log, own = review_log(spark, d), rows(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    found = spark.createDataFrame([], "doc_id long, pattern string")
    state = Feedback(spark, scratch(spark, "feedback"), own, found)
    for k in range(2):
        state.step(log.where(F.col("seq") % 2 == k), k)
    means = state.tables()["centroids"]
    return means.select("label", F.col("count").cast("long").alias("n"), F.posexplode("vector").alias("i", "x")).select("label", "n", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def suggest_related(spark, d):
    """For the first twenty vectors as keywords, the five nearest other ones of all rows."""
    own = rows(spark, d).select("vec_id", "embedding", V.norm(F.col("embedding")).alias("n"))
    a, b = own.where("vec_id < 20").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), F.col("n").alias("xn")), own.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), F.col("n").alias("yn"))
    met = pairs.met(a, b).where(F.col("a") != F.col("b")).select("a", "b", F.round(V.cosine(F.col("x"), F.col("xn"), F.col("y"), F.col("yn")), 6).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return met.withColumn("place", place.cast("long")).where("place <= 5")


QUERIES = {f.__name__: f for f in (vector_norm, cosine_to_query, semantic_topk, semantic_hits, label_centroids, online_centroid, suggest_related)}

_V = "SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings"
ORACLES = {
    "vector_norm": f"SELECT vec_id, round(n, 6) AS norm FROM ({_V})",
    "cosine_to_query": f"WITH v AS ({_V}) SELECT v.vec_id, round(list_inner_product(q.e, v.e) / (q.n * v.n), 6) AS cosine FROM v, v q WHERE q.vec_id = 0",
    "semantic_topk": f"""WITH v AS ({_V}), s AS (SELECT q.vec_id AS query_id, v.vec_id AS row_id, list_inner_product(q.e, v.e) / (q.n * v.n) AS s FROM v, v q WHERE q.vec_id IN (0, 1, 2))
        SELECT query_id, rank, row_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM s) WHERE rank <= 20""",
    "semantic_hits": f"""WITH v AS ({_V}), s AS (SELECT k.vec_id AS keyword_id, v.vec_id AS row_id, list_inner_product(k.e, v.e) / (k.n * v.n) AS s FROM v, v k WHERE k.vec_id < 40)
        SELECT row_id, keyword_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, keyword_id) AS r FROM s WHERE s >= 0.3) WHERE r <= 30""",
    "label_centroids": """SELECT label, count(*) AS n, i - 1 AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i""",
    "online_centroid": f"""WITH r AS ({REVIEWS_SQL}), l AS (SELECT doc_id, label FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, seq DESC, label DESC) = 1)
        SELECT label, count(*) AS n, i - 1 AS i, round(avg(x), 6) AS x FROM (SELECT l.label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings JOIN l ON vec_id = doc_id WHERE l.label IN ('high_value', 'irrelevant')) GROUP BY label, i""",
    "suggest_related": f"""WITH v AS ({_V}), s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e) / (a.n * b.n), 6) AS similarity FROM v a, v b WHERE a.vec_id < 20 AND a.vec_id <> b.vec_id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS place FROM s) WHERE place <= 5""",
}
