"""What reviews teach: host penalties, a phrase blacklist, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusieve.functions.vectors import mean_vectors, norm
from corpusieve.operators.state import folded, latest, penalty_steps, reviews, upsert

BLACKLIST_KEPT = 500


def host_penalties(log: DataFrame) -> DataFrame:
    """host and penalty after all reviews log(host, label, ts, seq), in their order."""
    own = log.select("host", "ts", "seq", penalty_steps(F.col("label")).alias("step"))
    return folded(own, "host", ["ts", "seq"], "step", "penalty", 0.0, 0.60, 0.0)


def phrase_times(log: DataFrame, found: DataFrame) -> DataFrame:
    """pattern and at (ts, seq): when a document that it alone matched was first found irrelevant."""
    single = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pattern").alias("pattern")).where("n = 1")
    return log.where("label = 'irrelevant'").join(single, "doc_id").groupBy("pattern").agg(F.min(F.struct("ts", "seq")).alias("at"))


def newest_phrases(times: DataFrame, kept: int = BLACKLIST_KEPT) -> DataFrame:
    """pattern and rank (1: newest) of the newest ``kept``."""
    newest = times.orderBy(F.desc("at"), "pattern").limit(kept)
    return newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("at"), "pattern"))).select("pattern", "rank")


def phrase_blacklist(log: DataFrame, found: DataFrame, kept: int = BLACKLIST_KEPT) -> DataFrame:
    """pattern and rank (1: newest): patterns that alone matched a document found irrelevant; of
    each its first time counts, and the newest ``kept`` stay."""
    return newest_phrases(phrase_times(log, found), kept)


def keyword_blacklist(keywords: DataFrame, blacklist: DataFrame) -> DataFrame:
    return keywords.join(blacklist.select(F.trim("keyword").alias("_k")), F.trim(keywords["keyword"]) == F.col("_k"), "left_anti")


def centroids(log: DataFrame, vectors: DataFrame) -> DataFrame:
    """label, vector, norm and count: means of the vectors(doc_id, vector) reviewed as each."""
    own = latest(log, "doc_id", "ts", "seq").where("label in ('high_value', 'irrelevant')").select("doc_id", "label").join(vectors, "doc_id")
    return mean_vectors(own, ["label"], "vector").withColumn("norm", norm(F.col("vector")))


def upsert_centroids(table: DataFrame, new: DataFrame) -> DataFrame:
    """Centroids(label, model_name, ...) with those of ``new`` in place of theirs."""
    return upsert(table, new.where("vector is not null"), "label", "model_name")


def apply_feedback(log: DataFrame, found: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """All that a feedback log(doc_id, label, host, ts, seq) changes, each as its whole new table."""
    return {
        "reviews": reviews(log.withColumnRenamed("label", "status")),
        "url_penalties": host_penalties(log),
        "phrase_blacklist": phrase_blacklist(log, found),
        "centroids": centroids(log, vectors),
    }


def penalties_from_json(rows: DataFrame, column: str) -> DataFrame:
    """``penalties``, a map, parsed from JSON; what is no such object is an empty map."""
    parsed = F.from_json(column, "map<string,double>")
    return rows.withColumn("penalties", F.coalesce(parsed, F.create_map().cast("map<string,double>")))
