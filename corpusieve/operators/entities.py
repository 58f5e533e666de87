"""Entities by pattern, their canonical form, and their merge by document."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusieve.functions.text import located, pages

#: Entity patterns (fixed values, in Java's dialect).
PATTERNS = {
    "EMAIL": r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "URL": r"(?iU)\bhttps?://[^\s)\]}>'\"]+",
    "PHONE": r"(?U)(?<!\d)(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)",
    "SSN": r"(?U)\b\d{3}-\d{2}-\d{4}\b",
}
#: A text without these has no such entity; it is cheaper to see than the pattern.
_SCREEN = {"EMAIL": "@", "URL": "://", "PHONE": None, "SSN": "-"}
#: What is cut from both ends of a mention, and forms of address that a person's name goes without (fixed values).
_EDGES = " \t\r\n\"'`.,;:()[]{}<>"
_ADDRESS = r"^(mr|mrs|ms|miss|dr|prof|sir|madam)\.?\s+"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no such function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def canonical(text: Column, label: Column, normalise: bool = True) -> Column:
    """The form under which mentions count as one entity. ``normalise`` brings in NFKC first, by an
    Arrow function; without it no Python runs, and forms of ASCII mentions are the same."""
    t = nfkc(text) if normalise else text
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+", " ")
    low = F.lower(F.btrim(t, F.lit(_EDGES)))
    kind = F.upper(label)
    person = F.trim(F.regexp_replace(low, _ADDRESS, ""))
    low = F.when(kind == "PERSON", person).otherwise(low)
    plain = F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s\-./@]", ""), r"\s+", " "))
    return F.when(kind.isin("EMAIL", "URL"), low).when(kind.isin("PHONE", "SSN"), F.regexp_replace(low, r"\D+", "")).otherwise(plain)


#: What an engine makes of a text.
MENTIONS = "array<struct<label:string,label_order:int,text:string,start:int>>"


def _perhaps(text: Column, label: str) -> Column:
    """Whether a text can hold an entity of the label, by a cheaper test."""
    return F.contains(text, F.lit(_SCREEN[label])) if _SCREEN[label] else text.rlike(r"\d{4}")


def mentions(text: Column) -> Column:
    """All mentions in a text as structs of label, text and start, by label and place."""

    def of(label: str, order: int) -> Column:
        rows = F.transform(located(text, PATTERNS[label]), lambda m: F.struct(F.lit(label).alias("label"), F.lit(order).alias("label_order"), m["match"].alias("text"), m["start"].alias("start")))
        return F.when(_perhaps(text, label), rows).otherwise(F.array().cast(MENTIONS))

    return F.concat(*[of(label, order) for order, label in enumerate(PATTERNS)])


def tagged(text: Column, make: Callable[[], Callable[[str], list[tuple[str, str, int]]]]) -> Column:
    """Mentions that a tagger finds: ``make`` gives it in the worker, once for a task, and it turns a
    text into (label, mention, start). Labels come after those of the patterns, in the order of names."""

    @F.pandas_udf(MENTIONS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = make()
        for batch in batches:
            yield pd.Series([[{"label": label, "label_order": len(PATTERNS), "text": m, "start": at} for label, m, at in sorted(tagger(t or ""), key=lambda x: (x[0], x[2]))] for t in batch], dtype=object)

    return of(text)


#: Engines by name: from a text column to its mentions. More are added by ``ENGINES[name] = ...``.
ENGINES: dict[str, Callable[[Column], Column]] = {"regex": mentions}


def engine(name: str) -> Callable[[Column], Column]:
    """The engine of that name, the patterns for any that is not there or can't be loaded."""
    found = ENGINES.get((name or "").strip().lower(), mentions)
    if found is not mentions:
        try:
            found(F.lit(""))
        except ImportError:
            return mentions
    return found


def extract(docs: DataFrame, by: str = "regex") -> DataFrame:
    """doc_id, label, label_order, text, start and page_no of every mention, by an engine's name; pages are told by [PAGE n] marks,
    and page_no is null before the first and after one whose number has more than 32 bits."""
    text = F.coalesce("text", F.lit(""))
    marks = F.transform(located(text, r"(?i)\[PAGE\s+\d+\]"), lambda m: F.struct(m["start"].alias("at"), F.regexp_extract(m["match"], r"\d+", 0).try_cast("int").alias("page_no")))
    rows = docs.select("doc_id", marks.alias("marks"), F.explode(engine(by)(text)).alias("e"))
    before = F.filter("marks", lambda m: m["at"] <= F.col("e.start"))
    return rows.select("doc_id", "e.label", "e.label_order", "e.text", "e.start", F.get(before, F.size(before) - 1)["page_no"].alias("page_no"))


def extract_by_page(docs: DataFrame) -> DataFrame:
    """As ``extract`` without offsets: pages are cut first, so nothing is counted twice."""
    own = docs.select("doc_id", F.explode(pages(F.coalesce("text", F.lit("")))).alias("p"))
    return own.select("doc_id", "p.page_no", F.explode(mentions(F.col("p.text"))).alias("e")).select("doc_id", "page_no", "e.label", "e.text")


def merged(found: DataFrame, normalise: bool = True) -> DataFrame:
    """doc_id, label, canonical, display, count, variants and page_nos of each entity.

    The longest mention is displayed, of equally long ones the first; mentions whose canonical form
    is empty are left out. One shuffle by document and entity, with partial aggregation.
    """
    own = found.withColumn("canonical", canonical(F.col("text"), F.col("label"), normalise)).where("canonical <> '' and label <> ''")
    shown = F.max_by("text", F.struct(F.length("text"), -F.col("label_order"), -F.col("start")))
    return own.groupBy("doc_id", "label", "canonical").agg(shown.alias("display"), F.count("*").alias("count"), F.sort_array(F.collect_set("text")).alias("variants"), F.sort_array(F.collect_set("page_no")).alias("page_nos"))


def density(text: Column, words: Column) -> Column:
    """Mentions for each word."""
    counts = [F.when(_perhaps(text, label), F.regexp_count(text, F.lit(PATTERNS[label]))).otherwise(0) for label in PATTERNS]
    return sum(counts[1:], counts[0]) / F.greatest(words, F.lit(1))
