"""python -m corpusieve.cli triage IN OUT --keywords PACK... : triages a folder of documents.

IN is a folder of files, or of Parquet with doc_id, url and text; OUT gets one Parquet folder for each
table and the sorted index.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusieve.operators.triage import triage
from corpusieve.settings import Settings
from corpusieve.sources import files, sinks


def run(spark: SparkSession, source: str, target: str, settings: Settings, parquet: bool = False) -> None:
    if parquet:
        docs = spark.read.parquet(source).select("doc_id", "url", "text")
    else:
        docs = files.read_files(spark, source).select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("url"), "text")
    out = triage(docs, settings)
    for name, table in out.items():
        table.write.mode("overwrite").parquet(f"{target}/{name}")
    rows = out["documents"].where("passes_relevance").select("relevance_score", "topic_similarity", "entity_density", F.lit("new").alias("review_status"), F.col("path").alias("local_path"), "url", "title")
    sinks.write_sorted_index(rows, f"{target}/index")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusieve", description=__doc__)
    parser.add_argument("command", choices=["triage"])
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--keywords", nargs="*", default=[], help="keyword pack files")
    parser.add_argument("--query", default="", help="a boolean query")
    parser.add_argument("--settings", default="", help="a settings file")
    parser.add_argument("--parquet", action="store_true", help="the source is Parquet")
    a = parser.parse_args(args)
    settings = Settings.load(a.settings) if a.settings else Settings()
    keywords, failed = files.load_packs(a.keywords)
    for path in failed:
        print(f"not read: {path}")
    settings = replace(settings, keywords=tuple(keywords) or settings.keywords, query=a.query or settings.query)
    run(SparkSession.builder.getOrCreate(), a.source, a.target, settings, a.parquet)


if __name__ == "__main__":
    main()
