"""Feedback as a stream: reviews, host penalties, the phrase blacklist and centroids follow the log batch
by batch.

Centroids are sums that can be taken back: a review that changes takes its document's vector out of one
label's sum and puts it into another's. Sums are decimals, so what comes in goes out without a rest. A host's
penalty is walked on from where it was; only for hosts of which a batch has rows that are older than what was
walked already the whole log of these hosts is walked again. All tables of a batch become the newest version
together, under the batch's number, so a batch that is replayed finds its version and changes nothing.

Reviews come from people, so the state of all documents reviewed is small beside the corpus, and each batch
writes it anew; vectors are read only for documents whose label changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusieve.functions.vectors import norm
from corpusieve.operators.feedback import BLACKLIST_KEPT, host_penalties, newest_phrases, phrase_times
from corpusieve.operators.state import REVIEWS, latest, penalty_steps
from corpusieve.operators.versions import Versions
from corpusieve.streaming.attempts import for_each

LEARNED = ("high_value", "irrelevant")
_EXACT = "decimal(38,18)"


class Feedback:
    """The state below ``root`` of a log(doc_id, label, host, ts, seq), given vectors(doc_id, vector) and
    found(doc_id, pattern)."""

    def __init__(self, spark: SparkSession, root: str, vectors: DataFrame, found: DataFrame) -> None:
        self.spark, self.root, self.vectors, self.found = spark, root.rstrip("/"), vectors, found
        self.versions = Versions(spark, root)

    def _now(self) -> dict:
        number = self.versions.newest()
        return self.versions.read(number) if number else {}

    def _read(self, now: dict, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{now[name]}") if name in now else None

    def step(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch; nothing if it, or a later one, was taken in before."""
        if self.versions.newest() > number:
            return
        now, new = self._now(), {}

        def put(name: str, rows: DataFrame) -> DataFrame:
            new[name] = f"{name}-{number}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{new[name]}")
            return self.spark.read.parquet(f"{self.root}/{new[name]}")

        log = put("log", batch.select("doc_id", "label", "host", "ts", "seq"))
        logs = [*now.get("logs", []), new.pop("log")]
        reviews = self._read(now, "reviews")
        come = latest(log.where("doc_id is not null").select("doc_id", "label", "ts", "seq"), "doc_id", "ts", "seq")
        after = latest(reviews.unionByName(come), "doc_id", "ts", "seq") if reviews is not None else come
        after = put("reviews", after)
        put("sums", self._sums(self._read(now, "sums"), self._moves(reviews, come, after)))
        put("penalties", self._penalties(self._read(now, "penalties"), log, logs))
        times, before = phrase_times(log, self.found), self._read(now, "times")
        times = times if before is None else before.unionByName(times).groupBy("pattern").agg(F.min("at").alias("at"))
        put("times", times)
        self.versions.put(number + 1, {**new, "logs": logs})

    def _moves(self, reviews: DataFrame | None, come: DataFrame, after: DataFrame) -> DataFrame:
        """doc_id, label and by: 1 for a label that a document got, -1 for one that it lost."""
        now = after.join(come.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("label").alias("_in"))
        before = reviews.select("doc_id", F.col("label").alias("_out")) if reviews is not None else now.select("doc_id", F.lit(None).cast("string").alias("_out")).limit(0)
        changed = now.join(before, "doc_id", "left").where(~F.col("_in").eqNullSafe(F.col("_out")))
        both = F.array(F.struct(F.col("_in").alias("label"), F.lit(1).alias("by")), F.struct(F.col("_out").alias("label"), F.lit(-1).alias("by")))
        return changed.select("doc_id", F.inline(both)).where(F.col("label").isin(*LEARNED))

    def _sums(self, before: DataFrame | None, moves: DataFrame) -> DataFrame:
        """label, i, s and n: sum and number of the components i of the vectors of each label."""
        own = moves.join(self.vectors.select("doc_id", "vector").where(F.size("vector") > 0), "doc_id")
        parts = own.select("label", "by", F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x")).select("label", "i", F.when(F.col("by") > 0, F.col("x").cast(_EXACT)).otherwise(-F.col("x").cast(_EXACT)).alias("s"), F.col("by").cast("long").alias("n"))
        whole = parts if before is None else before.unionByName(parts)
        return whole.groupBy("label", "i").agg(F.sum("s").cast(_EXACT).alias("s"), F.sum("n").alias("n"))

    def _penalties(self, before: DataFrame | None, log: DataFrame, logs: list[str]) -> DataFrame:
        """host, penalty, ts and seq (of the last row walked)."""
        place = F.struct("ts", "seq")
        own = log.where("host is not null").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", penalty_steps(F.col("label")).alias("step")))).alias("_steps"), F.min(place).alias("_first"), F.max(place).alias("_last"))  # of one batch
        if before is None:
            before = own.select("host", F.lit(0.0).alias("penalty"), "_last.ts", "_last.seq").limit(0)
        both = before.join(own, "host", "full_outer")
        walked = F.aggregate("_steps", F.coalesce("penalty", F.lit(0.0)), lambda s, x: F.greatest(F.lit(0.0), F.least(F.lit(0.6), s + x["step"])))
        late = F.coalesce(F.col("_first") <= place, F.lit(False))
        last = F.when(F.col("_last").isNull() | F.coalesce(place > F.col("_last"), F.lit(False)), place).otherwise(F.col("_last"))
        rows = both.select("host", F.when(F.col("_steps").isNull(), F.col("penalty")).otherwise(walked).alias("penalty"), last.alias("_at"), late.alias("late"))
        behind = rows.where("late").select("host")
        if behind.isEmpty():
            return rows.select("host", "penalty", "_at.ts", "_at.seq")
        whole = self.spark.read.parquet(*[f"{self.root}/{x}" for x in logs]).join(behind, "host", "left_semi")
        again = host_penalties(whole).select("host", F.col("penalty").alias("_again"))
        return rows.join(again, "host", "left").select("host", F.coalesce("_again", "penalty").alias("penalty"), "_at.ts", "_at.seq")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in what is there of a stream of the log, and ends."""
        return for_each(stream, checkpoint, self.step)

    def tables(self, kept: int = BLACKLIST_KEPT) -> dict[str, DataFrame]:
        """What ``apply_feedback`` makes of the whole log."""
        now = self._now()
        if not now:
            raise ValueError(f"no batch was taken in below {self.root}")
        reviews, sums = self._read(now, "reviews"), self._read(now, "sums")
        wide = sums.where("n > 0").groupBy("label").agg(F.max("n").alias("count"), F.array_sort(F.collect_list(F.struct("i", (F.col("s").cast("double") / F.col("n")).alias("x"), "n"))).alias("_v"))
        # components that all vectors of the label have
        vector = F.transform(F.filter("_v", lambda v: v["n"] == F.col("count")), lambda v: v["x"])
        return {
            "reviews": reviews.where(F.col("label").isin(*REVIEWS) & (F.col("label") != "new")).select("doc_id", F.col("label").alias("status")),
            "url_penalties": self._read(now, "penalties").select("host", "penalty"),
            "phrase_blacklist": newest_phrases(self._read(now, "times"), kept),
            "centroids": wide.select("label", vector.alias("vector"), "count").withColumn("norm", norm(F.col("vector"))),
        }
