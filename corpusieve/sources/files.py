"""Files as documents: routing by type, digests, text and DOCX, tables, keyword packs, TSV."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.sources import html as web

PDF_MAGIC = "255044462D"
_PARAGRAPH = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parser_of(path: Column, content_type: Column) -> Column:
    """pdf, docx, txt or html: by type, then by suffix; txt if neither tells."""
    kind, low = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(path)
    by_type = F.when(F.contains(kind, F.lit("pdf")), "pdf").when(F.contains(kind, F.lit("wordprocessingml")) | F.contains(kind, F.lit("msword")), "docx").when(F.contains(kind, F.lit("text/plain")), "txt").when(F.contains(kind, F.lit("html")), "html")
    by_suffix = F.when(low.endswith(".pdf"), "pdf").when(low.rlike(r"\.docx?$"), "docx").when(low.endswith(".txt"), "txt").when(low.rlike(r"\.html?$"), "html")
    return F.coalesce(by_type, by_suffix, F.lit("txt"))


def is_pdf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 5)) == PDF_MAGIC


def docx_text(content: bytes) -> str:
    """Non-empty paragraphs, one for each line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_PARAGRAPH}t")).strip() for p in root.iter(f"{_PARAGRAPH}p"))
    return "\n".join(line for line in lines if line)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, sha256, parser and text of all files below a folder; formats that need a
    library that is not here (PDF) have null text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    own = raw.select("path", "length", F.sha2("content", 256).alias("sha256"), F.when(is_pdf(F.col("content")), "pdf").otherwise(parser_of(F.col("path"), F.lit(None).cast("string"))).alias("parser"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for kind, content in zip(batch["parser"], batch["content"], strict=True):
                if kind == "docx":
                    try:
                        texts.append(docx_text(content))
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                        texts.append(None)
                elif kind == "pdf":
                    texts.append(None)
                else:
                    decoded = content.decode("utf-8", "ignore")
                    texts.append(web.visible_text(decoded) if kind == "html" else decoded)
            yield batch.drop(columns="content").assign(text=texts)

    return own.mapInPandas(parse, "path string, length long, sha256 string, parser string, text string")


def clean_table(cells: Column) -> Column:
    """Cells of an extracted table with null as empty; null for a table without cells."""
    filled = F.transform(cells, lambda row: F.transform(row, lambda c: F.coalesce(c, F.lit(""))))
    return F.when(F.exists(filled, lambda row: F.size(row) > 0), filled)


def read_labelled_tsv(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Rows of a TSV with a header; metric columns that are no number are null. With ``label`` only
    rows of that review status, or all rows, labelled so, where there is no such column."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    for c in ("relevance_score", "topic_similarity", "entity_density"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.col(c).try_cast("double"))
    if label is None:
        return rows
    if "review_status" in rows.columns:
        return rows.where(F.lower(F.trim("review_status")) == label)
    return rows.withColumn("review_status", F.lit(label))


def read_labelled_folder(spark: SparkSession, path: str, label: str, index: str = "semantic_sorted.txt") -> DataFrame:
    """local_path and review_status of the documents in a folder, its index file aside."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return rows.where(F.lower("path").rlike(r"\.(pdf|docx?|txt|html?)$") & ~F.col("path").endswith("/" + index)).select(F.col("path").alias("local_path"), F.lit(label).alias("review_status"))


def read_labelled(spark: SparkSession, root: str, labels: tuple[str, ...] = ("high_value", "irrelevant"), index: str = "semantic_sorted.txt") -> DataFrame:
    """Labelled documents below ``root``, a folder for each label: the rows of its index file if there
    are any, else the documents that lie there. Labels without a folder have none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    columns = "local_path string, review_status string, url string, title string, relevance_score double, topic_similarity double, entity_density double"
    found = spark.createDataFrame([], columns)
    for label in labels:
        own = None
        if fs.exists(path(f"{root}/{label}/{index}")):
            own = read_labelled_tsv(spark, f"{root}/{label}/{index}", label)
        if own is None or own.isEmpty():
            own = read_labelled_folder(spark, f"{root}/{label}", label, index) if fs.exists(path(f"{root}/{label}")) else None
        if own is not None:
            found = found.unionByName(own.withColumn("review_status", F.lit(label)).select(*[c for c in own.columns if c in found.columns]), allowMissingColumns=True)
    return found


# -- keyword packs, which are small and live on the driver


def pack_keywords(pack: object) -> list[str]:
    """All keywords of one parsed pack in order: a list, or an object with keyword lists, categories,
    patterns and example expansions."""
    if isinstance(pack, list):
        return [str(x).strip() for x in pack if str(x).strip()]
    if not isinstance(pack, dict):
        return []
    out: list[str] = []

    def take(values: object, prefix: str = "") -> None:
        """A list of keywords, or an object whose values are such lists."""
        if isinstance(values, dict):
            for v in values.values():
                take(v if isinstance(v, list) else None, prefix)
        elif isinstance(values, list):
            for word in (str(v).strip() for v in values if v is not None):
                if word:
                    out.append(word if word.startswith(prefix) else prefix + word)

    def inside(key: str, part: str) -> object:
        found = pack.get(key)
        return found.get(part) if isinstance(found, dict) else None

    for key in ("seed_keywords", "keywords", "terms", "categories"):
        take(pack.get(key))
    take(pack.get("regex_patterns"), "re:")
    take(inside("wildcards_and_globs", "examples"))
    take(pack.get("semantic_hint_tokens"))
    take(inside("euphemism_and_codeword_expansion_rules", "example_expansions"))
    return first_of_each(out)


def first_of_each(keywords: list[str]) -> list[str]:
    """Without later repeats, case aside."""
    return list({k.lower(): k for k in reversed(keywords)}.values())[::-1]


def load_packs(paths: list[str]) -> tuple[list[str], list[str]]:
    """Keywords of several pack files, first wins, and the files that could not be read."""
    every, failed = [], []
    for path in paths:
        try:
            every += pack_keywords(json.loads(Path(path).read_text(encoding="utf-8")))
        except (OSError, ValueError):
            failed.append(path)
    return first_of_each(every), failed


def save_pack(path: str, keywords: list[str]) -> None:
    Path(path).write_text(json.dumps({"seed_keywords": first_of_each(keywords)}, ensure_ascii=False, indent=2), encoding="utf-8")


def deduplicated(keywords: DataFrame) -> DataFrame:
    """Keyword rows(keyword, ord) without later repeats, case aside: for packs too long for a
    driver's list."""
    return keywords.groupBy(F.lower("keyword").alias("folded")).agg(F.min_by("keyword", "ord").alias("keyword"), F.min("ord").alias("ord"))


def robots_allows(body: Column, agent: str, url: Column) -> Column:
    """Whether a robots file allows a fetch; a null body allows all."""

    @F.pandas_udf("boolean")
    def allowed(bodies: pd.Series, urls: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        known: dict[str | None, RobotFileParser] = {}
        out = []
        for b, u in zip(bodies, urls, strict=True):
            if b not in known:
                known[b] = RobotFileParser()
                known[b].parse((b or "").splitlines())
            out.append(known[b].can_fetch(agent, u or ""))
        return pd.Series(out)

    return allowed(body, url)
