"""The small linear flagger: features, training, prediction, metrics."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusieve.functions.vectors import dot
from corpusieve.operators.state import segmented

METRICS = ("relevance_score", "topic_similarity", "entity_density")
VERSION = 1


@dataclass(frozen=True)
class Flagger:
    """Weights of the embedding, then of the standardised metrics."""

    weights: list[float]
    bias: float
    means: list[float]
    scales: list[float]
    version: int = VERSION

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Flagger | None:
        """None for anything but a flagger of this version whose parts fit together."""
        try:
            own = Flagger(**json.loads(text))
            fits = own.version == VERSION and len(own.means) == len(own.scales) == len(METRICS) and len(own.weights) > len(METRICS)
            return own if fits and all(isinstance(x, int | float) for x in [*own.weights, own.bias, *own.means, *own.scales]) else None
        except (TypeError, ValueError):
            return None


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """z_<column> of each: less the mean, by the population's deviation; a tiny one counts as 1."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    own = df.join(F.broadcast(stats), F.lit(True), "inner")  # one row
    scale = {c: F.when(F.col(f"_s_{c}") <= 1e-8, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return own.select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / scale[c]).alias(f"z_{c}") for c in columns])


def probability(model: Flagger, embedding: Column, metrics: list[Column]) -> Column:
    """P(high value); 0.5 where the embedding is missing or shorter than the model's."""
    n = len(model.weights) - len(METRICS)
    z = F.lit(model.bias)
    for w, m, s, x in zip(model.weights[n:], model.means, model.scales, metrics, strict=True):
        z = z + w * (F.coalesce(x, F.lit(0.0)) - m) / (s if s > 1e-8 else 1.0)
    weights = F.array(*[F.lit(float(w)) for w in model.weights[:n]])
    fits = F.coalesce(F.size(embedding) >= n, F.lit(False))
    return F.when(fits, sigmoid(z + dot(F.slice(embedding, 1, n), weights))).otherwise(0.5)


def train(rows: DataFrame, embedding: str = "embedding", label: str = "label", least: int = 6) -> Flagger | None:
    """A flagger from rows(embedding, metrics, label 0/1), by logistic regression with an L2
    penalty and balanced classes; None with fewer rows or only one class. Deterministic."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = {r[label]: r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    if total < least or set(counts) != {0, 1}:
        return None
    own = rows.select(embedding, label, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS])
    stats = own.agg(*[f(m).alias(f"{n}{i}") for i, m in enumerate(METRICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means, scales = [stats[f"m{i}"] for i in range(len(METRICS))], [stats[f"s{i}"] if stats[f"s{i}"] > 1e-8 else 1.0 for i in range(len(METRICS))]
    z = F.array(*[(F.col(m) - a) / s for m, a, s in zip(METRICS, means, scales, strict=True)])
    weight = F.when(F.col(label) == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
    data = own.select(array_to_vector(F.concat(F.col(embedding).cast("array<double>"), z)).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, standardization=False, maxIter=100).fit(data)
    return Flagger([float(x) for x in fitted.coefficients], float(fitted.intercept), means, scales)


def held_out(key: Column, buckets: int = 4) -> Column:
    """A stable quarter (by default) of the rows."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)) == 0


def metrics(scored: DataFrame) -> DataFrame:
    """n, accuracy and auc of scored(label, score); auc from ranks, ties share theirs. Scores are
    summed up by ranges first, so no task sorts all of them."""
    same = segmented(scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("good")), "score", "_range")
    totals = same.groupBy("_range").agg(F.sum("n").alias("_t"))  # a row for each range
    below = totals.select("_range", F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    before = F.sum("n").over(Window.partitionBy("_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    ranks = same.withColumn("_before", F.coalesce(before, F.lit(0))).join(F.broadcast(below), "_range").withColumn("rank", F.col("_below") + F.col("_before") + (F.col("n") + 1) / 2)
    sums = ranks.agg(F.sum("n").alias("n"), F.sum("good").alias("p"), F.sum(F.col("good") * F.col("rank")).alias("r"))
    right = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
    auc = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return sums.join(F.broadcast(right), F.lit(True), "inner").select("n", "accuracy", auc.alias("auc"))
