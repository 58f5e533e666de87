"""The corpus pipeline: language, quality, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return rows of ``docs`` with the same columns. No SQL can express these stages, so the
tests compare them with brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.llm import chosenpath, langid, packing, quality
from corpusieve.runtime import bound_batches, discard, scratch, table, written

#: A document must be in one of the learned languages with this probability at least.
LANGUAGE_SURE = 0.5
#: Words whose ids a worker remembers while packing: fewer than by default, as workers that wait for a later
#: run's first stages still hold them.
REMEMBERED = 400_000
QUALITY_LEAST = 0.5


def _where(docs: DataFrame, value: Column, test: Callable[[Column], Column]) -> DataFrame:
    """Rows whose ``value`` passes; it is computed once, under a name that no column has."""
    name = f"_{uuid.uuid4().hex}"
    return docs.withColumn(name, value).where(test(F.col(name))).drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language, whose code lengths are not far above those of its
    training texts; where none can be learned, all."""
    bound_batches(spark)
    texts = langid.training_texts(docs)
    model = langid.train(texts)
    if not model.languages:
        return docs
    bounds = langid.most_bits(texts)

    def known(p: Column) -> Column:
        bound = F.lit(float("inf"))
        for name, bits in bounds.items():
            bound = F.when(p["lang_pred"] == name, bits).otherwise(bound)
        return (p["lang_pred"] != langid.UNDETERMINED) & (p["score"] >= LANGUAGE_SURE) & (p["bits"] <= bound)

    return _where(docs, langid.predict(F.col("text"), model), known)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts."""
    bound_batches(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _where(docs, quality.score(F.col("text"), model), lambda score: score >= QUALITY_LEAST)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the least doc_id, nulls last. All
    rows whose text is null, empty or without words are copies of one another; of rows that are
    repeated whole, one stays."""
    bound_batches(spark)
    return chosenpath.keep_one(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences; a row for each piece of a document. A null text is
    empty, which leaves its end token; a null doc_id stays null."""
    import public_tokenizers

    bound_batches(spark)
    return packing.digest(packing.library_pack(docs, scratch(spark, "pipeline-packed"), public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_copies", near_copies),
    ("packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
