"""Keyword packs compiled into patterns, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

from corpusieve.functions.text import glob_pattern, literal_pattern


@dataclass(frozen=True)
class Pattern:
    """``method`` is keyword, wildcard or regex; ``java`` is what Spark searches for."""

    method: str
    source: str
    java: str
    order: int


def _usable(java: str, spark=None) -> bool:
    """Whether Java accepts the pattern, asked of the JVM where a session is at hand."""
    if spark is None:
        try:
            re.compile(java)
        except re.error:
            return False
        return True
    from py4j.protocol import Py4JJavaError

    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Py4JJavaError:
        return False
    return True


def compile_pack(keywords: list[str], stopwords: set[str] | frozenset[str] = frozenset(), spark=None) -> list[Pattern]:
    """Keywords as patterns: "re:" marks a regular expression (dropped if invalid), * or ? a glob,
    all else is literal. Literals come first, then globs, then regular expressions, each in the
    order given; literals that equal a stopword and those without a word are left out."""
    literals, globs, regexes = [], [], []
    for keyword in (k.strip() for k in keywords):
        if not keyword:
            continue
        if keyword.startswith("re:"):
            java = "(?i)" + keyword[3:].strip()
            if _usable(java, spark):
                regexes.append(("regex", keyword, java))
        elif "*" in keyword or "?" in keyword:
            globs.append(("wildcard", keyword, glob_pattern(keyword.lower())))
        elif keyword.lower() not in stopwords and (java := literal_pattern(keyword)):
            literals.append(("keyword", keyword, java))
    return [Pattern(*p, order) for order, p in enumerate(literals + globs + regexes)]
