"""Column expressions over URLs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DOCUMENT_SUFFIX = r"\.(pdf|docx?|txt|html?)$"


def authority(url: Column) -> Column:
    """Lower-cased host with user and port, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def site(url: Column) -> Column:
    """The authority without one leading www."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return site(a) == site(b)


def known_document(url: Column) -> Column:
    """Whether the whole URL ends like a document."""
    return F.lower(url).rlike(DOCUMENT_SUFFIX)


def looks_downloadable(url: Column) -> Column:
    """Whether the URL's path ends like a document."""
    return F.lower(path(url)).rlike(DOCUMENT_SUFFIX)


def pagination(url: Column) -> Column:
    return F.lower(url).rlike(r"[?&]p(age)?=|pager")


def normalized(url: Column) -> Column:
    """An absolute URL with lower-case scheme and authority, single slashes in its path and no
    fragment."""
    bare = F.regexp_replace(url, r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    has_authority = bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    query = F.regexp_extract(bare, r"(\?.+)$", 1)
    tidy = F.regexp_replace(path(bare), "//+", "/")
    return F.when(has_authority, F.concat(scheme, F.lit("://"), authority(bare), tidy, query)).otherwise(F.concat(F.lit("https:"), F.regexp_replace(bare, "//+", "/")))


@F.pandas_udf(StringType())
def resolved(url: pd.Series, base: pd.Series) -> pd.Series:
    """A link resolved against its page's URL, with . and .. steps; Spark has no such function."""
    from urllib.parse import urljoin

    return pd.Series([None if u is None else urljoin(b or "", u) for u, b in zip(url, base, strict=True)], dtype=object)


def links(html: Column) -> Column:
    """Targets of all anchors, without mail and script links, in order of appearance."""
    anchors = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(0))
    bare = F.transform(anchors, lambda a: F.regexp_extract(a, r"""(?is)^<a\s[^>]*?href\s*=\s*["']?(.*?)["']?$""", 1))
    kept = F.transform(bare, lambda u: F.regexp_replace(u, r"^\s+|\s+$", ""))
    return F.filter(kept, lambda u: (u != "") & ~F.lower(u).rlike("^(mailto|javascript):"))


def in_scope(url: Column, seeds: list[str]) -> Column:
    """Whether the path is that of a seed or below it."""
    ok = F.lit(not seeds)
    at = F.when(path(url) == "", "/").otherwise(path(url))
    for seed in seeds:
        exact = "/" + "/".join(seed.split("://", 1)[-1].split("/")[1:])
        exact = exact.split("?")[0].split("#")[0].rstrip("/") or "/"
        ok = ok | F.lit(exact == "/") | (at == exact) | at.startswith(exact.rstrip("/") + "/")
    return ok


def first_page(url: Column, must_have: str = "page") -> Column:
    """A listing URL whose page number is put back to 0."""
    return F.regexp_replace(url, rf"(?<=[?&]{must_have}=)[1-9][0-9]*", "0")


def valid_seeds(seeds: list[str]) -> list[str]:
    """Web addresses among what was entered, stripped, without repeats, in order."""
    return list(dict.fromkeys(s.strip() for s in seeds if s.strip().lower().startswith(("http://", "https://"))))


def valid_seed(url: Column) -> Column:
    return F.trim(url).rlike("(?i)^https?://")
