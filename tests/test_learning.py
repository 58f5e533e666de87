"""The flagger finds a signal that was planted, ranks rows it has not seen by it, and is the same each time."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusieve.operators import learning

SCHEMA = "id long, embedding array<double>, relevance_score double, topic_similarity double, entity_density double, label int"


def made(spark, signal, n=600):
    dice = random.Random(11)
    rows = []
    for i in range(n):
        label = int(dice.random() < 0.3)
        embedding = [dice.gauss(signal * (2 * label - 1), 1.0), dice.gauss(0, 1), dice.gauss(0, 1)]
        rows.append((i, embedding, dice.gauss(0, 5), dice.gauss(signal * label, 1), None if i % 9 == 0 else dice.gauss(0, 1), label))
    return spark.createDataFrame(rows, SCHEMA)


def held_out_metrics(rows):
    out = learning.held_out(F.col("id"))
    model = learning.train(rows.where(~out))
    score = learning.probability(model, F.col("embedding"), [F.col(m) for m in learning.METRICS])
    return model, learning.metrics(rows.where(out).select("label", score.alias("score"))).first()


def test_a_planted_signal_is_learned_and_noise_is_not(spark):
    rows = made(spark, 1.5).cache()
    model, found = held_out_metrics(rows)
    assert found.auc > 0.95 and found.accuracy > 0.85
    assert model.weights[0] > 3 * max(abs(w) for w in model.weights[1:3]) and model.weights[4] > 0
    again = learning.train(rows.where(~learning.held_out(F.col("id"))).repartition(7))
    assert max(abs(a - b) for a, b in zip(model.weights, again.weights, strict=True)) < 1e-6
    _, noise = held_out_metrics(made(spark, 0.0))
    assert 0.3 < noise.auc < 0.7
