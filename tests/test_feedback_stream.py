"""Feedback taken in batch by batch is that of the whole log."""

from __future__ import annotations

import datetime
import random

import pytest

from corpusieve.operators import feedback
from corpusieve.streaming import attempts
from corpusieve.streaming.feedback import Feedback

SCHEMA = "doc_id long, label string, host string, ts timestamp, seq long"
START = datetime.datetime(2024, 1, 1)


def rows_of(tables):
    out = {name: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str) for name, df in tables.items() if name != "centroids"}
    means = {r.label: (r["count"], r.vector, r.norm) for r in tables["centroids"].collect()}
    return out, {k: (n, [round(y, 9) for y in v], round(size, 9)) for k, (n, v, size) in means.items()}


def test_each_batch_leaves_what_the_whole_log_gives(spark, tmp_path):
    dice = random.Random(2)
    labels = ["high_value", "irrelevant", "reviewed", "new", "odd", None]
    rows = [(dice.choice([*range(12), None]), dice.choice(labels), dice.choice(["a.org", "b.org", "c.org", None]), START + datetime.timedelta(minutes=dice.randrange(40)), i) for i in range(90)]
    vectors = spark.createDataFrame([(i, [dice.gauss(0, 1) for _ in range(3 + (i == 3))]) for i in range(11)] + [(11, [])], "doc_id long, vector array<float>")
    found = spark.createDataFrame([(i, f"p{k}") for i in range(12) for k in range(1 + i % 2)] + [(2, "p0")], "doc_id long, pattern string")
    schema = spark.createDataFrame([], SCHEMA).schema
    path, root, check = (f"file://{tmp_path}/{x}" for x in ("log", "state", "check"))
    state, log, seen = Feedback(spark, root, vectors, found), spark.createDataFrame([], schema), 0
    with pytest.raises(ValueError, match="no batch"):
        state.tables()
    for n in (40, 1, 49):  # later batches have rows that are older than what was walked
        part = spark.createDataFrame(rows[seen : seen + n], schema)
        seen += n
        part.coalesce(1).write.mode("append").parquet(path)
        Feedback(spark, root, vectors, found).follow(attempts.source(spark, path, schema), check).awaitTermination()  # begins where the last one ended
        log = spark.createDataFrame(rows[:seen], schema)
        got, want = rows_of(state.tables()), rows_of(feedback.apply_feedback(log.where("doc_id is not null or host is not null"), found, vectors))
        for name in ("phrase_blacklist", "url_penalties", "reviews"):
            assert [r for r in got[0][name] if r[0] is not None] == [r for r in want[0][name] if r[0] is not None], name
        assert got[1] == want[1]
    before = state.versions.newest()
    state.step(part, before - 1)  # the last batch again, as after a failure
    assert state.versions.newest() == before and rows_of(state.tables())[1] == got[1]


def test_a_vector_is_taken_back_without_a_rest(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [0.1, 0.7]), (2, [1e-7, 3.3])], "doc_id long, vector array<double>")
    found = spark.createDataFrame([], "doc_id long, pattern string")
    state = Feedback(spark, f"file://{tmp_path}/s", vectors, found)
    for k, (doc, label) in enumerate([(1, "irrelevant"), (2, "irrelevant"), (1, "high_value"), (2, "reviewed")]):
        state.step(spark.createDataFrame([(doc, label, None, START, k)], SCHEMA), k)
    assert {r.label: (r["count"], r.vector) for r in state.tables()["centroids"].collect()} == {"high_value": (1, [0.1, 0.7])}
