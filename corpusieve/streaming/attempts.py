"""The attempt log as a stream: latest state, counters, new documents, change detection.

A log folder of Parquet files is read file by file. State views are kept in buckets by key, each in
versions that ``foreachBatch`` writes, named by the batch: a batch writes anew only those buckets that
it has keys of, and one that is replayed writes the same again. Older versions go when two newer ones
of their bucket are there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusieve.operators.state import latest


def source(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """The log as a stream, at most ``files`` new files for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: Buckets that a state is kept in.
BUCKETS = 64


def keep_latest(stream: DataFrame, root: str, checkpoint: str, key: str, *order: str, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the last row of each key below ``root``; ``current_state`` reads it."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # as many as there are buckets
        held = _versions(spark, root, number)
        before = [held[b][-1] for b in touched if b in held]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*before)) if before else batch
        own = latest(rows, key, *order).withColumn(_BUCKET, bucket)
        own.repartition(max(1, len(touched)), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{root}/batch={number:010d}")
        path, fs = _files(spark, root)
        for b in touched:
            for old in held.get(b, [])[:-1]:  # the one before stays for who reads it now
                fs.delete(path(old), True)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


_BUCKET = "state_bucket"


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str, before: int | None = None) -> dict[int, list[str]]:
    """For each bucket the folders of its versions, oldest first, of batches that were written whole
    (``before``: lower ones only)."""
    path, fs = _files(spark, root)
    out: dict[int, list[str]] = {}
    if not fs.exists(path(root)):
        return out
    for batch in sorted(x.getPath().toString() for x in fs.listStatus(path(root))):
        number = batch.rpartition("batch=")[2]
        if number.isdigit() and (before is None or int(number) < before) and fs.exists(path(f"{batch}/_SUCCESS")):
            for x in fs.listStatus(path(batch)):
                name = x.getPath().getName()
                if name.startswith(f"{_BUCKET}="):
                    out.setdefault(int(name.partition("=")[2]), []).append(x.getPath().toString())
    return out


def current_state(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole version of every bucket."""
    return spark.read.parquet(*[own[-1] for own in _versions(spark, root).values()])


def status_counts(log: DataFrame, ts: str, status: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, status and n; the same code for a stream, with a watermark, and for a table."""
    own = log.withColumn("_ts", F.col(ts).cast("timestamp"))
    own = own.withWatermark("_ts", late) if log.isStreaming else own
    return own.groupBy(F.window("_ts", window).alias("w"), F.col(status).alias("status")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")


def new_documents(stream: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose digest was not seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["sha256"])


def host_rates(stream: DataFrame) -> DataFrame:
    """host and rate after each batch of stream(host, ts, status): halved (0.2 at least) by a busy
    response, else raised by a twentieth (1 at most). State is one number for each host."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rate = state.get[0] if state.exists else 1.0
        rows = pd.concat(list(batches)).sort_values("ts")
        for status in rows["status"]:
            rate = max(0.2, min(1.0, rate * (0.5 if status in (429, 502, 503) else 1.05)))
        state.update((rate,))
        yield pd.DataFrame({"host": [key[0]], "rate": [rate]})

    return stream.groupBy("host").applyInPandasWithState(fold, "host string, rate double", "rate double", "update", "NoTimeout")


def for_each(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``step`` on what is there now, batch by batch, and ends."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
