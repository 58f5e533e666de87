"""Signs of redaction and of scanned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusieve.functions.text import marked_pages

BLOCKS = "█■▮"
LEAST_SCORE = 0.25
#: Characters below which a page counts as one that has hardly any text (fixed value).
SHORT = 60


def text_score(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    blocks = F.length(t) - F.length(F.translate(t, BLOCKS, ""))
    score = F.when(t.rlike("redact(ed|ion)"), 0.25).otherwise(0.0) + F.when(blocks >= 20, F.least(F.lit(0.5), blocks / 400.0)).otherwise(0.0) + F.when(F.contains(t, F.lit("[redacted]")), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def black_area_ratio(boxes: Column, page_width: Column, page_height: Column) -> Column:
    """Share of a page that dark boxes (structs of width, height, darkness) of at least a
    hundredth of it cover."""
    page = page_width * page_height
    large = F.filter(boxes, lambda b: (b["darkness"] <= 0.45) & (b["width"] * b["height"] >= 0.01 * page))
    return F.when(page > 0, F.aggregate(large, F.lit(0.0), lambda s, b: s + b["width"] * b["height"]) / page).otherwise(0.0)


def dark_pixel_ratio(histogram: Column) -> Column:
    """Share of pixels darker than 40 in a 256-bin histogram."""
    total = F.aggregate(histogram, F.lit(0.0), lambda s, n: s + n)
    return F.when(total > 0, F.aggregate(F.slice(histogram, 1, 40), F.lit(0.0), lambda s, n: s + n) / total).otherwise(0.0)


def page_score(text: Column, area: Column, pixels: Column) -> Column:
    """The strongest sign; pixels only count where the page has hardly any text."""
    dark = F.when(F.length(text) < SHORT, F.greatest(F.lit(0.0), 2.0 * (pixels - 0.25))).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(text_score(text), 3.0 * area, dark))


def page_flags(docs: DataFrame, signs: DataFrame | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, page_no, score and details of pages that look redacted.

    ``signs``(doc_id, page_no, boxes, page_width, page_height, histogram) is what was seen of pages: dark
    boxes as ``black_area_ratio`` takes them and a histogram of gray. Pages without signs go by their
    text alone, pages without text by their signs alone. Pixels were looked at where the text is short.
    """
    own = docs.select("doc_id", F.inline(marked_pages(F.coalesce("text", F.lit("")))))
    if signs is None:
        seen = own.withColumns({"_area": F.lit(0.0), "_large": F.lit(0), "_pixels": F.lit(0.0)})
    else:
        page = F.col("page_width") * F.col("page_height")
        large = F.size(F.filter("boxes", lambda b: (b["darkness"] <= 0.45) & (b["width"] * b["height"] >= 0.01 * page)))
        drawn = signs.select("doc_id", "page_no", black_area_ratio(F.col("boxes"), F.col("page_width"), F.col("page_height")).alias("_area"), large.alias("_large"), dark_pixel_ratio(F.col("histogram")).alias("_pixels"))
        both = own.join(drawn, ["doc_id", "page_no"], "full_outer")
        seen = both.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(c, F.lit(zero)).alias(c) for c, zero in (("_area", 0.0), ("_large", 0), ("_pixels", 0.0))])
    text, looked = F.col("text"), F.length("text") < SHORT
    details = F.struct(
        text_score(text).alias("text_score"),
        F.col("_area").alias("black_area_ratio"),
        F.col("_large").alias("big_black_rects"),
        F.when(looked, F.col("_pixels")).otherwise(0.0).alias("dark_pixel_ratio"),
        (looked if signs is not None else F.lit(False)).alias("pixel_check_used"),
    )
    scored = seen.select("doc_id", "page_no", page_score(text, F.col("_area"), F.col("_pixels")).alias("score"), details.alias("details"))
    return scored.where(F.col("score") >= least)


def looks_scanned(pages: Column, chars: int = 40, share: float = 0.35) -> Column:
    """Whether fewer than ``share`` of the pages (an array of texts) have ``chars`` characters."""
    good = F.filter(pages, lambda p: F.length(F.trim(p)) >= chars)
    return F.when(F.size(pages) == 0, True).otherwise(F.size(good) / F.size(pages) < share)


def otsu(histogram: DataFrame) -> DataFrame:
    """threshold of a histogram(bin, n): where the variance between the two sides is greatest, of
    equals the first. 256 rows, so windows over all of them are no burden."""
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    w = histogram.select("bin", F.sum("n").over(up).alias("low"), F.sum(F.col("bin") * F.col("n")).over(up).alias("low_sum"), F.sum("n").over(all_).alias("total"), F.sum(F.col("bin") * F.col("n")).over(all_).alias("total_sum"))
    high = F.col("total") - F.col("low")
    split = w.where((F.col("low") > 0) & (high > 0)).withColumn("between", F.col("low").cast("double") * high * F.pow(F.col("low_sum") / F.col("low") - (F.col("total_sum") - F.col("low_sum")) / high, 2))
    return split.orderBy(F.desc("between"), "bin").limit(1).select(F.col("bin").alias("threshold"))
