"""Queries over web pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.functions import urls as U
from corpusieve.operators.scope import scoped
from corpusieve.runtime import table
from corpusieve.sources import files, html


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _links(spark, d) -> DataFrame:
    return rows(spark, d).select("page_id", F.col("url").alias("base"), F.explode(U.links(F.col("html"))).alias("link"))


def html_title(spark, d):
    return rows(spark, d).select("page_id", html.title(F.col("html"), F.col("url")).alias("title"))


def html_text(spark, d):
    return rows(spark, d).select("page_id", html.text(F.col("html")).alias("text"))


def link_extract(spark, d):
    return _links(spark, d).groupBy("page_id", "link").agg(F.count("*").alias("n"))


def links_resolved(spark, d):
    return _links(spark, d).select("page_id", U.normalized(U.resolved(F.col("link"), F.col("base"))).alias("url")).distinct()


def normalize_url(spark, d):
    return rows(spark, d).select("page_id", U.normalized(F.col("url")).alias("url"))


def url_host(spark, d):
    return rows(spark, d).select("page_id", U.authority(F.col("url")).alias("host"), U.site(F.col("url")).alias("site"))


def looks_downloadable(spark, d):
    return rows(spark, d).select("page_id", U.looks_downloadable(F.col("url")).alias("downloadable"))


def known_document_urls(spark, d):
    return rows(spark, d).where(U.known_document(F.col("url"))).select("page_id", "url")


def pagination_links(spark, d):
    return rows(spark, d).where(U.pagination(F.col("url"))).select("page_id", F.col("url"), U.first_page(F.col("url")).alias("first"))


def same_site(spark, d):
    """Pages of the same site as some seed: seeds are the first ten pages."""
    seeds = rows(spark, d).where("page_id < 10").select(U.site(F.col("url")).alias("site")).distinct()
    return rows(spark, d).join(seeds, U.site(F.col("url")) == F.col("site"), "left_semi").select("page_id")


SEEDS = ["https://example.com/a", "https://example.com/doc", "https://example.com/page"]


def page_in_scope(spark, d):
    return rows(spark, d).select("page_id", U.in_scope(F.col("url"), SEEDS).alias("in_scope"))


def scope_by_seeds(spark, d):
    """All pages against the addresses of every twentieth page and the folder of every hundredth."""
    own = rows(spark, d)
    folder = F.when(F.col("page_id") % 100 == 0, F.regexp_replace("url", "/[^/]*$", "/")).otherwise(F.col("url"))
    seeds = own.where("page_id % 20 = 0").select(folder.alias("seed"))
    return scoped(own.select("page_id", "url"), seeds).select("page_id", "in_scope")


def parse_dispatch(spark, d):
    kind = F.when(F.col("page_id") % 5 == 0, "application/pdf").when(F.col("page_id") % 5 == 1, "text/html; charset=utf-8").otherwise(F.lit(None).cast("string"))
    return rows(spark, d).select("page_id", files.parser_of(F.regexp_replace("url", r"[?#].*$", ""), kind).alias("parser"))


def not_pdf_guard(spark, d):
    return rows(spark, d).select("page_id", html.not_pdf(F.col("html"), F.lit("application/pdf")).alias("rejected"), html.age_gate(F.col("html"), F.col("url")).alias("age_gate"))


def url_penalty(spark, d):
    hosts = rows(spark, d).select(U.authority(F.col("url")).alias("host")).distinct().select("host", (F.length("host") % 7 * 0.05).alias("penalty")).where("penalty > 0")
    own = rows(spark, d).select("page_id", U.authority(F.col("url")).alias("host"))
    return own.join(hosts, "host", "left").select("page_id", F.round(F.coalesce("penalty", F.lit(0.0)), 6).alias("penalty"))


def seed_validation(spark, d):
    """Addresses that can be seeds, each once: half of them are entered with spaces or twice."""
    typed = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), "url")).otherwise(F.substring_index("url", "://", -1))
    own = rows(spark, d).select(typed.alias("url")).unionByName(rows(spark, d).select("url"))
    return own.where(U.valid_seed(F.col("url"))).select(F.trim("url").alias("url")).distinct()


QUERIES = {f.__name__: f for f in (html_title, html_text, link_extract, links_resolved, normalize_url, url_host, looks_downloadable, known_document_urls, pagination_links, same_site, page_in_scope, scope_by_seeds, parse_dispatch, not_pdf_guard, url_penalty, seed_validation)}

_S = r"[A-Za-z][A-Za-z0-9+.\-]*"
_AUTH = rf"lower(regexp_extract(url, '^{_S}://([^/?#]*)', 1))"
_SITE = rf"regexp_replace({_AUTH}, '^www\.', '')"
_PATH = rf"regexp_extract(url, '^(?:{_S}://[^/?#]*)?([^?#]*)', 1)"
_TITLE = r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g')"
_PLAIN = f"replace(replace(replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_NORMAL = rf"lower(regexp_extract(url, '^({_S}):', 1)) || '://' || {_AUTH} || regexp_replace({_PATH}, '//+', '/', 'g') || regexp_extract(regexp_replace(url, '#.*$', ''), '(\?.+)$', 1)"
_JOINED = f"regexp_extract(url, '^({_S}://[^/?#]*)', 1) || link"
_SCOPE = " OR ".join(f"p = '{s.split('.com')[1]}' OR starts_with(p, '{s.split('.com')[1]}/')" for s in SEEDS)
ORACLES = {
    "seed_validation": "SELECT DISTINCT trim(url) AS url FROM pages WHERE regexp_matches(url, '(?i)^https?://')",
    "html_title": f"SELECT page_id, CASE WHEN {_PLAIN} <> '' THEN {_PLAIN} ELSE url END AS title FROM pages",
    "link_extract": r"""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1))) AS link FROM pages)
        WHERE link <> '' AND NOT regexp_matches(lower(link), '^(mailto|javascript):') GROUP BY 1, 2""",
    "html_text": r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>|<!--.*?-->', '<>', 'g'), '<[^>]*>'),
        lambda x: trim(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'))), lambda x: x <> ''), chr(10)) AS text FROM pages""",
    "links_resolved": rf"""SELECT DISTINCT page_id, {_NORMAL} AS url FROM (SELECT page_id, {_JOINED} AS url FROM (
        SELECT page_id, url, trim(unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1))) AS link FROM pages) WHERE link <> '')""",
    "normalize_url": f"SELECT page_id, {_NORMAL} AS url FROM pages",
    "url_host": f"SELECT page_id, {_AUTH} AS host, {_SITE} AS site FROM pages",
    "looks_downloadable": rf"SELECT page_id, regexp_matches(lower({_PATH}), '\.(pdf|docx?|txt|html?)$') AS downloadable FROM pages",
    "known_document_urls": "SELECT page_id, url FROM pages WHERE " + " OR ".join(f"lower(url) LIKE '%.{x}'" for x in ("pdf", "doc", "docx", "txt", "html", "htm")),
    "pagination_links": "SELECT page_id, url, regexp_replace(url, '([?&]page=)[1-9][0-9]*', '\\10', 'g') AS first FROM pages WHERE " + " OR ".join(f"contains(lower(url), '{x}')" for x in ("?page=", "&page=", "?p=", "&p=", "pager")),
    "same_site": f"SELECT page_id FROM pages WHERE {_SITE} IN (SELECT {_SITE} FROM pages WHERE page_id < 10)",
    "scope_by_seeds": f"""WITH s AS (SELECT DISTINCT regexp_replace(regexp_extract(CASE WHEN page_id % 100 = 0 THEN regexp_replace(url, '/[^/]*$', '/') ELSE url END, '://[^/]*(/[^?#]*)', 1), '/+$', '') AS e FROM pages WHERE page_id % 20 = 0)
        SELECT page_id, p IN (SELECT e FROM s) OR EXISTS (SELECT 1 FROM s WHERE starts_with(p, e || '/')) OR EXISTS (SELECT 1 FROM s WHERE e = '') AS in_scope
        FROM (SELECT page_id, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS p FROM pages)""",
    "page_in_scope": f"SELECT page_id, ({_SCOPE}) AS in_scope FROM (SELECT page_id, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS p FROM pages)",
    "parse_dispatch": r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' WHEN page_id % 5 = 1 THEN 'html' WHEN u LIKE '%.pdf' THEN 'pdf' WHEN u LIKE '%.doc' OR u LIKE '%.docx' THEN 'docx'
        WHEN u LIKE '%.txt' THEN 'txt' WHEN u LIKE '%.html' OR u LIKE '%.htm' THEN 'html' ELSE 'txt' END AS parser FROM (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS u FROM pages)""",
    "not_pdf_guard": r"""SELECT page_id, (contains(h, '<html') OR contains(h, '<!doctype html') OR NOT starts_with(regexp_replace(h, '^[\r\n\t ]+', ''), '%pdf-')) AS rejected,
        (contains(url, '/age-verify') OR contains(h, '/age-verify') OR contains(h, 'are you 18') OR contains(h, 'age verification') OR contains(h, 'age-verify-block')) AS age_gate
        FROM (SELECT page_id, url, lower(substring(html, 1, 2048)) AS h FROM pages)""",
    "url_penalty": f"SELECT page_id, round(length({_AUTH}) % 7 * 0.05::DOUBLE, 6) AS penalty FROM pages",
}
