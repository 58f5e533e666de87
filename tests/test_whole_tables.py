"""Queries read all rows of their tables: fixtures with ids beyond any that a cut would keep."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusieve.functions import vectors as V
from corpusieve.operators import matching
from corpusieve.queries import QUERIES


def test_online_centroid_equals_the_walk_over_all_vectors(spark, tmp_path):
    ids = [*range(195, 206), 4000, 1_000_000]
    rows = [(i, [float(i % 7), i / 3, -1.0 * (i % 5)], i % 2) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.label, r.i): r.x for r in QUERIES["online_centroid"](spark, str(tmp_path)).collect()}
    ordered = spark.read.parquet(f"{tmp_path}/embeddings.parquet").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: V.doubles(x["embedding"])).alias("vs"))
    start = F.struct(F.lit(0.0).alias("n"), F.transform(F.get("vs", F.lit(0)), lambda x: F.lit(0.0)).alias("m"))
    walk = F.aggregate("vs", start, lambda s, v: F.struct((s["n"] + 1).alias("n"), V.online_mean(s["m"], s["n"], v).alias("m")))
    want = {(r.label, i): x for r in ordered.select("label", walk["m"].alias("m")).collect() for i, x in enumerate(r.m)}
    assert got == pytest.approx(want, abs=1e-6)


def test_state_queries_read_even_and_odd_events(spark, tmp_path):
    import datetime

    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    rows = [
        (2, at(0), 1, "signup", 1.0, "{}"),
        (3, at(1), 1, "signup", 1.0, "{}"),  # the last of its URL is odd
        (4, at(2), 2, "signup", 1.0, "{}"),
        (5, at(3), 4, "view", 1.0, "{}"),  # only an odd event
        (7, at(4), 5, "error", 1.0, "{}"),
        (6, at(5), 5, "view", 1.0, "{}"),
    ]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    of = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.status: r.n for r in of("clear_pending")} == {"done": 2, "abandoned": 3}
    assert [r.url for r in of("pending_queue")] == ["view:4", "error:5", "view:5"]
    assert [tuple(r) for r in of("diag_done_detail")] == [(2, 1, 1)]


def test_suggest_related_takes_candidates_from_all_rows(spark, tmp_path):
    rows = [(i, [1.0, float(i)], 0) for i in range(20)] + [(500 + i, [1.0, 3 + i / 1000], 0) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["suggest_related"](spark, str(tmp_path)).collect()
    assert [r.b for r in sorted(found, key=lambda r: r.place) if r.a == 3] == [500, 501, 502, 503, 504]
    assert {r.a for r in found} == set(range(20))  # the stated keywords only


def test_fuzzy_searches_every_sentence(spark):
    docs = spark.createDataFrame([(0, "filler words here. " * 1600 + "the black book")], "doc_id long, text string")
    assert [(r.pattern, r.score, r.snippet) for r in matching.fuzzy_hits(docs, ["black book"]).collect()] == [("black book", 1.0, "the black book")]
    assert [(r.pattern, r.score) for r in matching.fuzzy_subset_hits(docs, ["black book"]).collect()] == [("black book", 1.0)]
