"""What leaves the engine: the sorted index, CSV, nested JSON, routed folders."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusieve.schemas import conformed, schema

INDEX = ("relevance_score", "topic_similarity", "entity_density", "review_status", "local_path", "url", "title")


def _fixed(c: Column, digits: int) -> Column:
    """A number as Python and C print it: rounded by its exact value, ties to the even digit. Java's
    formats round the shortest digits that tell the number apart instead, so this is in Python."""

    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        return batch.map(f"{{:.{digits}f}}".format)

    return F.when(c.isNull(), "").otherwise(of(c.cast("double")))


def index_lines(rows: DataFrame) -> DataFrame:
    """The lines of the sorted index as they are printed: the best score first, none last; lines of
    one score by url and path, then by a hash of all else, since what is sorted by is sampled to the
    driver and a title may be long. A review that is missing or empty is new."""
    return rows.orderBy(F.desc_nulls_last("relevance_score"), "url", "local_path", F.xxhash64(*INDEX)).select(
        _fixed(F.col("relevance_score"), 4).alias("relevance_score"),
        _fixed(F.col("topic_similarity"), 4).alias("topic_similarity"),
        _fixed(F.col("entity_density"), 6).alias("entity_density"),
        F.when(F.col("review_status") != "", F.col("review_status")).otherwise("new").alias("review_status"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("local_path", "url", "title")],
    )


def append(rows: DataFrame, table: str, root: str, now: datetime | None = None) -> None:
    """Adds rows to the stored table of that name, with its columns and types. Its time of entry
    (created_at, fetched_at or updated_at) is ``now`` where rows have none; by default the clock's."""
    names = [f.name for f in schema(table)]
    clock = F.lit(now) if now else F.current_timestamp()
    for c in ("created_at", "fetched_at", "updated_at"):
        if c in names:
            rows = rows.withColumn(c, F.coalesce(F.col(c).cast("timestamp"), clock) if c in rows.columns else clock)
    conformed(rows, table).write.mode("append").parquet(f"{root}/{table}")


def write_sorted_index(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """A TSV folder with the best first. Files are ranges of the order; ``one_file`` only for
    lists that fit one task."""
    ordered = index_lines(rows)
    (ordered.coalesce(1) if one_file else ordered).write.option("emptyValue", "").csv(path, sep="\t", header=True, quote="")


def write_indexes_by_review(rows: DataFrame, path: str) -> None:
    """One sorted index for all rows and one for each of the two decided reviews."""
    write_sorted_index(rows, f"{path}/all")
    for status in ("high_value", "irrelevant"):
        write_sorted_index(rows.where(F.col("review_status") == status), f"{path}/{status}")


def write_csv(rows: DataFrame, path: str, limit: int = 2000) -> None:
    rows.orderBy(F.desc("fetched_at"), "doc_id").limit(limit).write.csv(path, header=True)


def nested(docs: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Documents with their rows of each part(doc_id, ...) as an array of structs, in the order of
    the columns that are named with it; one aggregation for each part, none for each document."""
    out = docs
    for name, (rows, order) in parts.items():
        rest = [c for c in rows.columns if c not in ("doc_id", *order)]
        gathered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(gathered, "doc_id", "left").withColumn(name, F.coalesce(name, F.slice(F.array(F.struct(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*order, *rest)])), 1, 0)))
    return out


def write_nested(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_routed(rows: DataFrame, path: str, bucket: str = "bucket") -> None:
    """Rows in one folder for each bucket (raw, triaged, flagged, ...)."""
    rows.write.partitionBy(bucket).parquet(path)
