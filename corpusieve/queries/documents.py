"""Queries over documents: matching, search, entities, redaction, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusieve.functions import text as T
from corpusieve.operators import entities, highlight, matching, redaction, scoring, search, state
from corpusieve.plans import boolean
from corpusieve.plans.patterns import compile_pack
from corpusieve.runtime import scratch, table
from corpusieve.sources import files

WORDS, PHRASES, FREQUENT = ["that", "license", "nicht", "dans"], ["on the", "of the"], ["the", "of", "and", "de", "in"]
GLOBS, REGEX = ["licen*", "th?t"], "re:[a-z]{3,}tion"
BOOLEAN, NEAR = 'license AND ("on the" OR with) AND NOT nicht', "license NEAR/5 the"
FUZZY = ["that with this", "with that from"]
SEARCH = "license OR copyright"
_W = r"[^\p{L}\p{N}_]"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _counts(pack: list[str]):
    return lambda spark, d: matching.hit_counts(docs(spark, d), compile_pack(pack))


def sql_count(keyword: str, column: str = "text") -> str:
    """How often a whole word or phrase occurs. There is no look-around here, so separators are
    doubled: each side of one can then take its own."""
    body = r"\s+".join(keyword.split())
    return rf"len(regexp_extract_all(regexp_replace({column}, '({_W})', '\1\1', 'g'), '(?i)(?:^|{_W}){body}(?:$|{_W})'))"


def _sql_rows(counts: dict[str, str], source: str = "documents") -> str:
    parts = [f"SELECT doc_id, '{p}' AS pattern, {c} AS n_hits FROM {source}" for p, c in counts.items()]
    return f"SELECT doc_id, pattern, n_hits FROM ({' UNION ALL '.join(parts)}) WHERE n_hits > 0"


_GLOB_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_\-'']*[\p{L}\p{N}_])?')"
_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
#: Start (from 0) of every token `license`.
_STARTS = rf"""
  SELECT doc_id, text, toks, i, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(toks[1:i-1], lambda t: length(t))), 0) AS start
  FROM (SELECT doc_id, text, {_TOKENS} AS toks, string_split_regex(text, '[\p{{L}}\p{{N}}_]+') AS gaps, unnest(range(1, len({_TOKENS}) + 1)) AS i FROM documents WHERE contains(lower(text), 'license'))
  WHERE lower(toks[i]) = 'license'
"""
_SNIPPETS = f"""
  SELECT doc_id, 'license' AS pattern, start::BIGINT AS start,
         substring(text, greatest(0, start - 90)::INT + 1, (start + 7 + 90 - greatest(0, start - 90))::INT) AS snippet FROM ({_STARTS})
"""


def large_pack(spark, d) -> list[str]:
    """Words of three letters and more and pairs of words in the passages of `benchmark`, which is a small
    table: some thousand keywords."""
    passages = table(spark, d, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda w, i: F.when(w != F.get("w", i + 1), F.concat_ws(" ", w, F.get("w", i + 1))))
    return sorted({r[0] for r in passages.select(F.explode(F.concat("w", pairs))).where("col is not null").distinct().collect()})


def pack_hits(spark, d):
    """How often a document has each keyword of a large pack."""
    return matching.hit_counts(docs(spark, d), compile_pack(large_pack(spark, d)))


PACK_SQL = r"""
WITH p AS (SELECT regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM benchmark),
pack AS (
  SELECT unnest(w) AS pattern FROM p
  UNION SELECT a || ' ' || b FROM (SELECT unnest(w[1:len(w)-1]) AS a, unnest(w[2:len(w)]) AS b FROM p) WHERE a <> b),
t AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w, string_split_regex(text, '[\p{L}\p{N}_]+') AS g FROM documents),
u AS (SELECT doc_id, unnest(w) AS a, unnest(w[2:len(w)+1]) AS b, unnest(g[2:len(w)+1]) AS gap FROM t WHERE len(w) > 0),
f AS (
  SELECT doc_id, a AS pattern FROM u
  UNION ALL SELECT doc_id, a || ' ' || b FROM u WHERE b IS NOT NULL AND regexp_full_match(gap, '[ 	

]+'))
SELECT doc_id, pattern, count(*) AS n_hits FROM f JOIN pack USING (pattern) GROUP BY doc_id, pattern
"""


def keyword_snippets(spark, d):
    return matching.hits(docs(spark, d), compile_pack(["license"])).select("doc_id", "pattern", F.col("start").cast("long").alias("start"), "snippet")


def match_dedupe(spark, d):
    found = matching.deduplicated(matching.hits(docs(spark, d), compile_pack(["license"])))
    return found.groupBy("doc_id", "pattern").agg(F.count("*").alias("n_unique"))


def hit_cap(spark, d):
    found = matching.capped(matching.hits(docs(spark, d), compile_pack(FREQUENT), with_snippet=False))
    return found.groupBy("doc_id", "pattern").agg(F.count("*").alias("n_kept"))


def _hit_cap_sql() -> str:
    counts = [f"SELECT doc_id, '{k}' AS pattern, {i} AS o, {sql_count(k)} AS n FROM documents" for i, k in enumerate(FREQUENT)]
    return f"""
      SELECT doc_id, pattern, greatest(1, least(n, 201 - before))::BIGINT AS n_kept
      FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({" UNION ALL ".join(counts)}))
      WHERE n > 0"""


def boolean_query(spark, d):
    return matching.boolean_hits(docs(spark, d), BOOLEAN).select("doc_id", "method", "snippet")


def near_query(spark, d):
    return docs(spark, d).where(boolean.compiled(NEAR, F.col("text"))).select("doc_id")


NEAR_SQL = r"""
SELECT doc_id FROM (
  SELECT doc_id, list_filter(range(1, len(t) + 1), lambda i: t[i] = 'license') AS l, list_filter(range(1, len(t) + 1), lambda i: t[i] = 'the') AS r
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents WHERE contains(lower(text), 'license')))
WHERE len(list_filter(l, lambda i: len(list_filter(r, lambda j: abs(i - j) <= 5)) > 0)) > 0
"""


def sentences(spark, d):
    s = T.sentences(F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


SENTENCES_SQL = r"""
SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest
FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[\n.?!]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
"""


def _chunked(size: int, overlap: int, most: int | None = None, chars: int | None = None):
    def run(spark, d):
        own = docs(spark, d) if chars is None else docs(spark, d).withColumn("text", F.substring("text", 1, chars))
        rows = matching.chunk_rows(own, size, overlap)
        rows = rows if most is None else rows.where(F.col("chunk_index") < most)
        return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("text", 256).alias("digest"))

    return run


def _chunks_sql(size: int, overlap: int, most: int | None = None, chars: int | None = None) -> str:
    step, text = size - overlap, "text" if chars is None else f"substring(text, 1, {chars})"
    return f"""
SELECT doc_id, i AS chunk_index, i * {step} AS start, least(n, i * {step} + {size}) AS "end", sha256(substring(t, (i * {step} + 1)::INT, {size})) AS digest
FROM (SELECT doc_id, t, length(t) AS n, unnest(range(0, greatest(1, ceil((length(t) - {overlap}) / {step}.0)::BIGINT))) AS i FROM (SELECT doc_id, {text} AS t FROM documents) WHERE length(t) > 0)
{f"WHERE i < {most}" if most else ""}
"""


def bm25_search(spark, d):
    found = search.find(search.with_title(docs(spark, d)), SEARCH, 50)
    rank = F.row_number().over(Window.orderBy("bm25", "doc_id")).cast("long")
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"), rank.alias("rank"))


_FOLDED = rf"""translate(lower(text), '{T.MARKED}', '{T.PLAIN}')"""


def sql_bm25(first: str, second: str, source: str = "documents") -> str:
    """doc_id and bm25 of documents with either word, in title (the first line) or text."""
    return rf"""
  WITH t AS (
    SELECT doc_id, list_concat(regexp_extract_all(string_split({_FOLDED}, chr(10))[1], '[\p{{L}}\p{{N}}]+'), regexp_extract_all({_FOLDED}, '[\p{{L}}\p{{N}}]+')) AS toks FROM {source}
  ), f AS (
    SELECT doc_id, len(toks) AS dl, len(list_filter(toks, lambda x: x = '{first}')) AS f1, len(list_filter(toks, lambda x: x = '{second}')) AS f2 FROM t
  ), c AS (SELECT count(*) AS n, avg(dl) AS al, sum((f1 > 0)::INT) AS d1, sum((f2 > 0)::INT) AS d2 FROM f)
  SELECT doc_id, -greatest(ln((n - d1 + .5) / (d1 + .5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (.25 + .75 * dl / al))
                 -greatest(ln((n - d2 + .5) / (d2 + .5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (.25 + .75 * dl / al)) AS bm25
  FROM f, c WHERE f1 + f2 > 0"""


_TOP = f"SELECT doc_id, bm25, row_number() OVER (ORDER BY bm25, doc_id) AS rank FROM ({sql_bm25("license", "copyright")}) ORDER BY bm25, doc_id LIMIT 50"


def keyword_rank_score(spark, d):
    found = search.rank_scores(search.find(search.with_title(docs(spark, d)), SEARCH, 50))
    return found.select("doc_id", F.round("keyword_rank", 6).alias("keyword_rank"))


FTS = {
    "fts_phrase": '"on the"',
    "fts_prefix": "licen*",
    "fts_near": "NEAR(license the, 5)",
    "fts_not": "license NOT copyright",
    "fts_column": "title:the license",
    "fts_fallback": ", ",
}


def _fts(query: str):
    def run(spark, d):
        found = search.find(search.with_title(docs(spark, d)), query, 250)
        return found.select("doc_id", F.round("bm25", 6).alias("bm25"))

    return run


def _sql_places(words: list[str], field: str, prefix: bool = False) -> str:
    """How often words follow each other in a list of words."""
    tests = [f"{field}[i + {k}] = '{w}'" if not (prefix and k == len(words) - 1) else f"starts_with({field}[i + {k}], '{w}')" for k, w in enumerate(words)]
    return f"len(list_filter(range(1, len({field}) + 1), lambda i: {' AND '.join(tests)}))"


def _sql_both(words: list[str], prefix: bool = False) -> str:
    return f"({_sql_places(words, 't', prefix)} + {_sql_places(words, 'c', prefix)})"


def _sql_near(field: str, a: str, b: str, n: int) -> str:
    return f"len(list_filter(range(1, len({field}) + 1), lambda i: {field}[i] = '{a}' AND list_contains({field}[greatest(1, i - {n + 1}):i + {n + 1}], '{b}'))) > 0"


def _sql_fts(counts: dict[str, str], holds: str, scored: list[str]) -> str:
    """bm25 of documents for which ``holds``, by the named counts over t (title) and c (content)."""
    own, numbers = ", ".join(f"{e} AS {k}" for k, e in counts.items()), ", ".join(f"sum(({k} > 0)::INT) AS d_{k}" for k in scored)
    score = " ".join(f"- greatest(ln((n - d_{k} + .5) / (d_{k} + .5)), 1e-6) * {k} * 2.2 / ({k} + 1.2 * (.25 + .75 * dl / al))" for k in scored)
    return rf"""
  WITH t AS (SELECT doc_id, regexp_extract_all(string_split({_FOLDED}, chr(10))[1], '[\p{{L}}\p{{N}}]+') AS t, regexp_extract_all({_FOLDED}, '[\p{{L}}\p{{N}}]+') AS c FROM documents),
  f AS (SELECT doc_id, t, c, len(t) + len(c) AS dl, {own} FROM t), s AS (SELECT count(*) AS n, avg(dl) AS al, {numbers} FROM f)
  SELECT doc_id, round(bm25, 6) AS bm25 FROM (SELECT doc_id, {score} AS bm25 FROM f, s WHERE {holds}) ORDER BY round(bm25, 9), doc_id LIMIT 250"""


def _fts_sql() -> dict[str, str]:
    near = f"a > 0 AND b > 0 AND ({_sql_near('t', 'license', 'the', 5)} OR {_sql_near('c', 'license', 'the', 5)})"
    return {
        "fts_phrase": _sql_fts({"a": _sql_both(["on", "the"])}, "a > 0", ["a"]),
        "fts_prefix": _sql_fts({"a": _sql_both(["licen"], True)}, "a > 0", ["a"]),
        "fts_near": _sql_fts({"a": _sql_both(["license"]), "b": _sql_both(["the"])}, near, ["a", "b"]),
        "fts_not": _sql_fts({"a": _sql_both(["license"]), "b": _sql_both(["copyright"])}, "a > 0 AND b = 0", ["a"]),
        "fts_column": _sql_fts({"a": _sql_places(["the"], "t"), "b": _sql_both(["license"])}, "a > 0 AND b > 0", ["a", "b"]),
        "fts_fallback": "SELECT doc_id, 0.0::DOUBLE AS bm25 FROM documents WHERE text ILIKE '%, %' ORDER BY doc_id LIMIT 250",
    }


def indexed_search(spark, d):
    """The search by an index that was written in two parts."""
    root, own = scratch(spark, "search-index"), search.with_title(docs(spark, d))
    search.Index.append(own.where("doc_id % 2 = 0"), root)
    search.Index.append(own, root)
    found = search.find(own, SEARCH, 50, index=search.Index.open(spark, root))
    rank = F.row_number().over(Window.orderBy("bm25", "doc_id")).cast("long")
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"), rank.alias("rank"))


def index_upkeep(spark, d):
    """The search by an index that grew, whose documents changed and went, and that was merged."""
    own = search.with_title(docs(spark, d))
    store = search.Store(spark, scratch(spark, "search-store"))
    store.upsert(own.where("doc_id % 2 = 0").withColumn("content", F.concat("content", F.lit(" copyright license"))))
    store.upsert(own)  # all of these changed
    store.remove(own.where("doc_id % 7 = 3"))
    store.upsert(own.where("doc_id % 14 = 3"))
    store.merge(everything=True)
    found = search.find(own, SEARCH, 50, index=store.index())
    rank = F.row_number().over(Window.orderBy("bm25", "doc_id")).cast("long")
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"), rank.alias("rank"))


def like_search(spark, d):
    return search.like_search(search.with_title(docs(spark, d)), "Licens_", 250)


# -- entities


def entities_regex(spark, d):
    return entities.extract(docs(spark, d)).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


_EMAIL = r"(?i)[A-Z0-9_](?:[A-Z0-9._%+-]*)@[A-Z0-9.-]+\.[A-Z]{2,}"
_DIGITS = r"regexp_replace(text, '([^0-9])', '\1\1', 'g')"


def sql_mentions(column: str = "text") -> dict[str, str]:
    double = rf"regexp_replace({column}, '([^0-9])', '\1\1', 'g')"
    ss = r"[\s.-]{0,2}"
    return {
        "EMAIL": f"len(regexp_extract_all({column}, '{_EMAIL}'))",
        "URL": rf"len(regexp_extract_all({column}, '(?i)https?://[^\s)\]}}>''\"]+'))",
        "PHONE": rf"len(regexp_extract_all({double}, '(?:^|[^0-9])(?:\+{{0,2}}1(?:[\s.-]{{2}})?)?(?:\(\([0-9]{{3}}\)\)|[0-9]{{3}})(?:[\s.-]{{2}})?[0-9]{{3}}(?:[\s.-]{{2}})?[0-9]{{4}}(?:$|[^0-9])'))",
        "SSN": rf"len(regexp_extract_all(regexp_replace({column}, '({_W})', '\1\1', 'g'), '(?:^|{_W})[0-9]{{3}}--[0-9]{{2}}--[0-9]{{4}}(?:$|{_W})'))",
    }


def _entities_sql() -> str:
    parts = [f"SELECT doc_id, '{label}' AS label, {c} AS n FROM documents" for label, c in sql_mentions().items()]
    return f"SELECT doc_id, label, n FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


def entities_merged(spark, d):
    own = entities.merged(entities.extract(docs(spark, d)).where("label = 'EMAIL'"))
    return own.select("doc_id", "label", "canonical", "display", "count", F.concat_ws("|", "variants").alias("variants"))


ENTITIES_MERGED_SQL = rf"""
SELECT doc_id, 'EMAIL' AS label, canonical, max_by(m, (length(m), -i)) AS display, count(*) AS count, string_agg(DISTINCT m, '|' ORDER BY m) AS variants
FROM (SELECT doc_id, m[i] AS m, i, trim(lower(m[i]), ' "''`.,;:()[]{{}}<>') AS canonical
      FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS m, unnest(range(1, len(regexp_extract_all(text, '{_EMAIL}')) + 1)) AS i FROM documents))
GROUP BY doc_id, canonical
"""


def entity_canonical(spark, d):
    own = table(spark, d, "customer").select("c_custkey", F.concat(F.lit(" Dr.  "), F.initcap("c_mktsegment"), F.lit(" -  "), "c_name", F.lit(", ")).alias("t"))
    return own.select("c_custkey", entities.canonical(F.col("t"), F.lit("PERSON")).alias("person"), entities.canonical(F.col("t"), F.lit("ORG")).alias("org"), entities.canonical(F.col("c_custkey").cast("string"), F.lit("PHONE")).alias("digits"))


ENTITY_CANONICAL_SQL = r"""
SELECT c_custkey, regexp_replace(regexp_replace(low, '^dr\.\s+', ''), '[^\w\s\-./@]', '', 'g') AS person,
       regexp_replace(low, '[^\w\s\-./@]', '', 'g') AS org, c_custkey::VARCHAR AS digits
FROM (SELECT c_custkey, lower('dr. ' || c_mktsegment || ' - ' || c_name) AS low FROM customer)
"""


def entity_wide(spark, d):
    """Full-width digits and letters are the same entity as plain ones."""
    wide = lambda c: F.translate(c, "0123456789CustomerABC", "０１２３４５６７８９ＣｕｓｔｏｍｅｒＡＢＣ")  # noqa: E731
    own = table(spark, d, "customer").select("c_custkey", wide(F.col("c_name")).alias("t"), wide(F.col("c_custkey").cast("string")).alias("k"))
    return own.select("c_custkey", entities.canonical(F.col("t"), F.lit("ORG")).alias("org"), entities.canonical(F.col("k"), F.lit("PHONE")).alias("digits"))


def entities_fallback(spark, d):
    """An engine that is not there leaves the patterns."""
    return entities.extract(docs(spark, d), "no such engine").groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def entity_density(spark, d):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", F.round(entities.density(t, T.word_count(t)), 9).alias("density"))


WORD_COUNT = r"greatest(1, len(list_filter(string_split_regex(replace(text, '[PAGE', ' '), '\s+'), lambda w: w <> '')))"
DENSITY = f"(({' + '.join(sql_mentions().values())}) / {WORD_COUNT}::DOUBLE)"


def word_count(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.coalesce("text", F.lit(""))).cast("long").alias("n_words"))


def page_of_offset(spark, d):
    t = F.concat(F.lit("[PAGE 1] "), F.substring("text", 1, 1000), F.lit(" [PAGE 2] "), F.expr("substring(text, 1001)"))
    found = entities.extract(docs(spark, d).select("doc_id", t.alias("text"))).where("label = 'EMAIL'")
    return found.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


PAGE_SQL = rf"""
SELECT doc_id, page_no, n FROM (
  SELECT doc_id, 1::INT AS page_no, len(regexp_extract_all(substring(text, 1, 1000), '{_EMAIL}')) AS n FROM documents
  UNION ALL SELECT doc_id, 2::INT, len(regexp_extract_all(substring(text, 1001), '{_EMAIL}')) FROM documents) WHERE n > 0
"""

# -- redaction


def _hidden(column: str = "text"):
    """Texts in which frequent words stand for what is blacked out."""
    t = F.replace(F.replace(F.col(column), F.lit("that"), F.lit("████")), F.lit("with"), F.lit("[REDACTED]"))
    return F.replace(t, F.lit("der"), F.lit("■■▮"))


_HIDDEN = "replace(replace(replace(text, 'that', '████'), 'with', '[REDACTED]'), 'der', '■■▮')"


def _sql_score(t: str) -> str:
    blocks = f"(length({t}) - length(translate({t}, '█■▮', '')))"
    low = f"lower({t})"
    return f"least(1.0, (CASE WHEN regexp_matches({low}, 'redact(ed|ion)') THEN 0.25 ELSE 0.0 END) + (CASE WHEN {blocks} >= 20 THEN least(0.5, {blocks} / 400.0) ELSE 0.0 END) + (CASE WHEN contains({low}, '[redacted]') THEN 0.3 ELSE 0.0 END))::DOUBLE"


def redaction_text_score(spark, d):
    return docs(spark, d).select("doc_id", F.round(redaction.text_score(_hidden()), 6).alias("score"))


def _paged(spark, d):
    t = F.concat(F.lit("[PAGE 1]\n"), F.substring(_hidden(), 1, 800), F.lit("\n[PAGE 2]\n"), F.expr(f"substring({_HIDDEN}, 801)"))
    return docs(spark, d).select("doc_id", t.alias("text"))


def page_redaction_flags(spark, d):
    return redaction.page_flags(_paged(spark, d)).select("doc_id", "page_no", F.round("score", 6).alias("score"))


_FLAGS = f"""
SELECT doc_id, page_no, round({_sql_score("t")}, 6) AS score FROM (
  SELECT doc_id, 1::INT AS page_no, substring({_HIDDEN}, 1, 800) AS t FROM documents
  UNION ALL SELECT doc_id, 2::INT, substring({_HIDDEN}, 801) FROM documents)
WHERE {_sql_score("t")} >= 0.25
"""


def _signs(spark, d):
    box = lambda share, dark: F.struct((F.col("n_chars") % 500 * share).cast("double").alias("width"), F.lit(100.0).alias("height"), dark.alias("darkness"))  # noqa: E731
    boxes = F.array(box(1, F.col("doc_id") % 10 / 10.0), box(2, F.lit(0.1)))
    gray = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.when(i < 40, F.col("doc_id") % 400).otherwise(1).cast("double"))
    return docs(spark, d).select("doc_id", F.lit(3).alias("page_no"), boxes.alias("boxes"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), gray.alias("histogram"))


def page_signs(spark, d):
    """Pages by their text, and by boxes and pixels of a third page that has none."""
    own = redaction.page_flags(_paged(spark, d), _signs(spark, d))
    return own.select("doc_id", "page_no", F.round("score", 6).alias("score"), F.round("details.black_area_ratio", 6).alias("area"), F.round("details.dark_pixel_ratio", 6).alias("pixels"))


def redaction_max(spark, d):
    return page_redaction_flags(spark, d).groupBy("doc_id").agg(F.max("score").alias("score"))


_SIGNS = f"""
SELECT doc_id, page_no, score, 0.0::DOUBLE AS area, 0.0::DOUBLE AS pixels FROM ({_FLAGS}) UNION ALL
SELECT doc_id, 3::INT, round(least(1.0, greatest(3 * area, 2 * (pixels - 0.25))), 6)::DOUBLE, round(area, 6), round(pixels, 6) FROM (
  SELECT doc_id, ((CASE WHEN doc_id % 10 / 10.0 <= 0.45 AND n_chars % 500 * 100 >= 4800 THEN n_chars % 500 * 100 ELSE 0 END) + (CASE WHEN n_chars % 500 * 200 >= 4800 THEN n_chars % 500 * 200 ELSE 0 END)) / 480000.0::DOUBLE AS area,
         40 * (doc_id % 400) / (40 * (doc_id % 400) + 216)::DOUBLE AS pixels FROM documents)
WHERE greatest(3 * area, 2 * (pixels - 0.25)) >= 0.25
"""


def scanned_doc_heuristic(spark, d):
    return docs(spark, d).select("doc_id", redaction.looks_scanned(F.split("text", "\n", -1)).alias("scanned"))


SCANNED_SQL = """
SELECT doc_id, len(list_filter(p, lambda x: length(trim(x)) >= 40)) / len(p)::DOUBLE < 0.35 AS scanned
FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
"""


def otsu_threshold(spark, d):
    return redaction.otsu(docs(spark, d).groupBy((F.col("n_chars") % 256).alias("bin")).agg(F.count("*").alias("n")))


OTSU_SQL = """
WITH h AS (SELECT n_chars % 256 AS bin, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS low, sum(bin * n) OVER (ORDER BY bin) AS low_sum, sum(n) OVER () AS total, sum(bin * n) OVER () AS total_sum FROM h)
SELECT bin AS threshold FROM w WHERE low > 0 AND total > low
ORDER BY low::DOUBLE * (total - low) * pow(low_sum / low::DOUBLE - (total_sum - low_sum) / (total - low)::DOUBLE, 2) DESC, bin LIMIT 1
"""

# -- documents as rows


def doc_dedupe_sha256(spark, d):
    return state.distinct_documents(docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id")


def flagged_docs(spark, d):
    own = docs(spark, d)
    return scoring.flagged(own.select("doc_id", "source"), matching.hits(own, compile_pack(["license", "copyright"]), with_snippet=False))


def newest_flagged(spark, d):
    """The flagged list, last fetched first."""
    from corpusieve.queries.scores import review_rows

    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 7919 % 1000 * 60).cast("timestamp_ntz")
    own = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 10 != 3, at).alias("fetched_at"))
    return scoring.newest_flagged(own, matching.hit_counts(docs(spark, d), compile_pack(["license", "copyright"])), review_rows(spark, d), 40)


def doc_lookup(spark, d):
    """One document's fields by its id, and defaults where there is none."""
    own = docs(spark, d).select("doc_id", "source", "n_chars")
    there, missing = (state.lookup(own, "doc_id", k, {"source": "none", "n_chars": 0}) for k in (7, -1))
    return there.unionByName(missing)


def metrics_update(spark, d):
    """Metrics of a third of the documents are replaced; the others keep theirs."""
    own = docs(spark, d).select("doc_id", (F.col("n_chars") / 1000.0).alias("relevance_score"), F.lit(None).cast("double").alias("topic_similarity"))
    new = docs(spark, d).where("doc_id % 3 = 0").select("doc_id", F.lit(0.5).alias("relevance_score"), F.when(F.col("doc_id") % 2 == 0, 0.25).alias("topic_similarity"))
    return state.update_metrics(own, new)


def matches_for_doc(spark, d):
    found = matching.hit_counts(docs(spark, d), compile_pack(WORDS + PHRASES))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n_hits"), "pattern")).cast("long")
    return found.withColumn("place", n)


def flagged_path(spark, d):
    own = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"), T.first_line(F.col("text")).alias("title"))
    return own.select("doc_id", scoring.flagged_path("flagged", F.col("sha"), "txt", "hashed", F.col("title")).alias("path"))


FLAGGED_PATH_SQL = r"""
SELECT doc_id, 'flagged/' || sha[1:2] || '/' || sha[3:4] || '/' || (CASE WHEN length(s) > 110 THEN regexp_replace(substring(s, 1, 110), '\s+$', '') ELSE s END) || '.txt' AS path
FROM (SELECT doc_id, sha, regexp_replace(regexp_replace((CASE WHEN t = '' THEN 'file' WHEN lower(t) LIKE '%.txt' THEN t[:-5] ELSE t END) || '__' || sha[1:10], '[\\/:*?"<>|]+', '_', 'g'), '\s+', ' ', 'g') AS s
      FROM (SELECT doc_id, sha256(text) AS sha, regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g') AS t FROM documents))
"""


def highlight_spans(spark, d):
    own = highlight.spans(docs(spark, d), compile_pack(["license", "copyright"]))
    return own.select("doc_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


_ESCAPED = "replace(replace(replace(replace(replace(substring(text, 1, 15000), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def highlight_preview(spark, d):
    return highlight.preview(docs(spark, d), compile_pack(["license", "copyright"]))


def keyword_pack_dedupe(spark, d):
    own = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("keyword"), F.col("p_partkey").alias("ord"))
    return files.deduplicated(own).select("keyword", "ord")


def keyword_blacklist(spark, d):
    from corpusieve.operators import feedback

    part = table(spark, d, "part")
    return feedback.keyword_blacklist(part.select(F.concat("p_name", F.lit(" "), "p_brand").alias("keyword")).distinct(), part.where("p_size > 40").select(F.concat(F.lit(" "), "p_name", F.lit(" "), "p_brand").alias("keyword")).distinct())


def keyword_filter(spark, d):
    """Keywords that contain what was typed, of either case."""
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("re"))).select("p_name").distinct()


def page_flags_sorted(spark, d):
    """Flags of documents by score, then page, as a place in their document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "page_no"))
    return page_redaction_flags(spark, d).withColumn("place", place.cast("long"))


def entities_sorted(spark, d):
    """Entities by label, then count, then form, as a place in their document."""
    own = entities.merged(entities.extract(docs(spark, d)).where("label = 'EMAIL'"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("label", F.desc("count"), "display"))
    return own.select("doc_id", "label", "display", "count", place.cast("long").alias("place"))


def docs_in_list(spark, d):
    """Documents of a list of ids, which is a small table."""
    ids = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return docs(spark, d).join(ids, "doc_id", "left_semi").select("doc_id", "source")


def chunk_embeddings(spark, d):
    """Chunks of the index with their vectors' norms, by the hashing provider."""
    from corpusieve.operators import embedding

    rows = embedding.by_chunk(docs(spark, d), embedding.HashingProvider)
    return rows.select("doc_id", "chunk_index", "start", "end", F.round("norm", 4).alias("norm"))


def chunk_upkeep(spark, d):
    """Chunks that have a vector, of a store whose documents changed and went before."""
    from corpusieve.operators.chunk_store import ChunkStore
    from corpusieve.operators.embedding import HashingProvider

    own = docs(spark, d).select("doc_id", "text")
    store = ChunkStore(spark, scratch(spark, "chunk-store"), HashingProvider)
    store.update(own.where("doc_id % 2 = 0").withColumn("text", F.concat(F.lit("before "), "text")))
    store.update(own)
    store.remove(own.where("doc_id % 7 = 3"))
    places = [F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "end")]
    return store.table().select("doc_id", *places, F.size("vector").alias("dimensions"))


QUERIES = {
    **{name: _fts(query) for name, query in FTS.items()},
    "indexed_search": indexed_search,
    "index_upkeep": index_upkeep,
    "highlight_spans": highlight_spans,
    "entity_wide": entity_wide,
    "entities_fallback": entities_fallback,
    "page_signs": page_signs,
    "newest_flagged": newest_flagged,
    "doc_lookup": doc_lookup,
    "metrics_update": metrics_update,
    "keyword_filter": keyword_filter,
    "page_flags_sorted": page_flags_sorted,
    "entities_sorted": entities_sorted,
    "docs_in_list": docs_in_list,
    "chunk_embeddings": chunk_embeddings,
    "chunk_upkeep": chunk_upkeep,
    "pack_hits": pack_hits,
    "keyword_hits": _counts(WORDS),
    "phrase_hits": _counts(PHRASES),
    "wildcard_hits": _counts(GLOBS),
    "regex_hits": _counts([REGEX]),
    "keyword_snippets": keyword_snippets,
    "match_dedupe": match_dedupe,
    "hit_cap": hit_cap,
    "boolean_query": boolean_query,
    "near_query": near_query,
    "fuzzy_subset_hits": lambda s, d: matching.fuzzy_subset_hits(docs(s, d), FUZZY),
    "fuzzy_hits": lambda s, d: matching.fuzzy_hits(docs(s, d), FUZZY),
    "sentences": sentences,
    "chunks": _chunked(2500, 250),
    "chunks_generic": _chunked(4000, 200),
    "chunks_long": _chunked(4500, 300, 12, 60000),
    "word_count": word_count,
    "bm25_search": bm25_search,
    "like_search": like_search,
    "keyword_rank_score": keyword_rank_score,
    "entities_regex": entities_regex,
    "entities_merged": entities_merged,
    "entity_canonical": entity_canonical,
    "entity_density": entity_density,
    "page_of_offset": page_of_offset,
    "scanned_doc_heuristic": scanned_doc_heuristic,
    "redaction_text_score": redaction_text_score,
    "page_redaction_flags": page_redaction_flags,
    "redaction_max": redaction_max,
    "otsu_threshold": otsu_threshold,
    "doc_dedupe_sha256": doc_dedupe_sha256,
    "flagged_docs": flagged_docs,
    "matches_for_doc": matches_for_doc,
    "flagged_path": flagged_path,
    "highlight_preview": highlight_preview,
    "keyword_pack_dedupe": keyword_pack_dedupe,
    "keyword_blacklist": keyword_blacklist,
}

_PREVIEW_TOKENS = _TOKENS.replace("text", "p")


def _sql_spans(word: str) -> str:
    """Start and end of a word in the first 15,000 characters."""
    return rf"""SELECT doc_id, start::BIGINT AS a, (start + {len(word)})::BIGINT AS b FROM (
      SELECT doc_id, toks, i, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(toks[1:i-1], lambda t: length(t))), 0) AS start
      FROM (SELECT doc_id, {_PREVIEW_TOKENS} AS toks, string_split_regex(p, '[\p{{L}}\p{{N}}_]+') AS gaps, unnest(range(1, len({_PREVIEW_TOKENS}) + 1)) AS i FROM (SELECT doc_id, substring(text, 1, 15000) AS p FROM documents) WHERE contains(lower(p), '{word}'))
      WHERE lower(toks[i]) = '{word}')"""


ORACLES = {
    **_fts_sql(),
    "indexed_search": f"SELECT doc_id, round(bm25, 6) AS bm25, rank FROM ({_TOP})",
    "index_upkeep": f"SELECT doc_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25, doc_id) AS rank FROM ({sql_bm25('license', 'copyright', "(SELECT * FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 14 = 3)")}) ORDER BY bm25, doc_id LIMIT 50",
    "highlight_spans": " UNION ALL ".join(_sql_spans(w) for w in ("license", "copyright")),
    "highlight_preview": rf"""SELECT doc_id, regexp_replace({_ESCAPED}, '(?i)\b(license|copyright)\b', '<mark>\1</mark>', 'g') AS html FROM documents
        WHERE {sql_count("license", "substring(text, 1, 15000)")} + {sql_count("copyright", "substring(text, 1, 15000)")} > 0""",
    "entity_wide": "SELECT c_custkey, lower(replace(c_name, '#', '')) AS org, c_custkey::VARCHAR AS digits FROM customer",
    "entities_fallback": _entities_sql(),
    "page_signs": _SIGNS,
    "newest_flagged": f"""SELECT doc_id, fetched_at, match_count, coalesce(status, 'new') AS review_status FROM (
        SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7919 % 1000) END AS fetched_at, {sql_count("license")} + {sql_count("copyright")} AS match_count FROM documents)
        LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'high_value' ELSE 'irrelevant' END AS status FROM labels) USING (doc_id) WHERE match_count > 0 ORDER BY fetched_at DESC NULLS LAST, doc_id LIMIT 40""",
    "doc_lookup": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 7 UNION ALL SELECT -1, 'none', 0",
    "metrics_update": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE n_chars / 1000.0 END::DOUBLE AS relevance_score, CASE WHEN doc_id % 6 = 0 THEN 0.25 END::DOUBLE AS topic_similarity FROM documents",
    "keyword_filter": "SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 're')",
    "page_flags_sorted": f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_no) AS place FROM ({_FLAGS})",
    "entities_sorted": f"SELECT doc_id, label, display, count, row_number() OVER (PARTITION BY doc_id ORDER BY label, count DESC, display) AS place FROM ({ENTITIES_MERGED_SQL})",
    "docs_in_list": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "chunk_upkeep": f'SELECT doc_id, chunk_index, start, "end", 64 AS dimensions FROM ({_chunks_sql(2500, 250)}) WHERE doc_id % 7 <> 3',
    "pack_hits": PACK_SQL,
    "keyword_hits": _sql_rows({k: sql_count(k) for k in WORDS}),
    "phrase_hits": _sql_rows({k: sql_count(k) for k in PHRASES}),
    "wildcard_hits": _sql_rows({"licen*": f"len(list_filter({_GLOB_WORDS}, lambda w: regexp_full_match(w, 'licen.*')))", "th?t": f"len(list_filter({_GLOB_WORDS}, lambda w: regexp_full_match(w, 'th.t')))"}),
    "regex_hits": _sql_rows({REGEX: "len(regexp_extract_all(text, '(?i)[a-z]{3,}tion'))"}),
    "keyword_snippets": _SNIPPETS,
    "match_dedupe": f"SELECT doc_id, pattern, count(DISTINCT snippet) AS n_unique FROM ({_SNIPPETS}) GROUP BY 1, 2",
    "hit_cap": _hit_cap_sql(),
    "boolean_query": f"""SELECT doc_id, 'query' AS method, '((license AND ("on the" OR with)) AND NOT(nicht))' AS snippet FROM documents
        WHERE {sql_count("license")} > 0 AND ({sql_count("on the")} > 0 OR {sql_count("with")} > 0) AND {sql_count("nicht")} = 0""",
    "near_query": NEAR_SQL,
    "fuzzy_subset_hits": " UNION ALL ".join(
        rf"""SELECT doc_id, '{k}' AS pattern, 1.0::DOUBLE AS score FROM documents
        WHERE len(list_filter(string_split_regex(lower(text), '[\n.?!]+'), lambda s: list_has_all(string_split_regex(s, '\s+'), {k.split()}))) > 0"""
        for k in FUZZY
    ),
    "sentences": SENTENCES_SQL,
    "chunks": _chunks_sql(2500, 250),
    "chunks_generic": _chunks_sql(4000, 200),
    "chunks_long": _chunks_sql(4500, 300, 12, 60000),
    "word_count": f"SELECT doc_id, {WORD_COUNT} AS n_words FROM documents",
    "bm25_search": f"SELECT doc_id, round(bm25, 6) AS bm25, rank FROM ({_TOP})",
    "like_search": "SELECT doc_id, 0.0::DOUBLE AS bm25 FROM documents WHERE text ILIKE '%Licens_%' ORDER BY doc_id LIMIT 250",
    "keyword_rank_score": f"SELECT doc_id, round((n - rank + 1) / n::DOUBLE, 6) AS keyword_rank FROM (SELECT *, count(*) OVER () AS n FROM ({_TOP}))",
    "entities_regex": _entities_sql(),
    "entities_merged": ENTITIES_MERGED_SQL,
    "entity_canonical": ENTITY_CANONICAL_SQL,
    "entity_density": f"SELECT doc_id, round({DENSITY}, 9) AS density FROM documents",
    "page_of_offset": PAGE_SQL,
    "scanned_doc_heuristic": SCANNED_SQL,
    "redaction_text_score": f"SELECT doc_id, round({_sql_score(_HIDDEN)}, 6) AS score FROM documents",
    "page_redaction_flags": _FLAGS,
    "redaction_max": f"SELECT doc_id, max(score) AS score FROM ({_FLAGS}) GROUP BY doc_id",
    "otsu_threshold": OTSU_SQL,
    "doc_dedupe_sha256": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "flagged_docs": f"SELECT doc_id, source, n AS match_count FROM (SELECT doc_id, source, {sql_count('license')} + {sql_count('copyright')} AS n FROM documents) WHERE n > 0",
    "matches_for_doc": f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_hits DESC, pattern) AS place FROM ({_sql_rows({k: sql_count(k) for k in WORDS + PHRASES})})",
    "flagged_path": FLAGGED_PATH_SQL,
    "keyword_pack_dedupe": "SELECT min_by(k, p_partkey) AS keyword, min(p_partkey) AS ord FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS k FROM part) GROUP BY lower(k)",
    "keyword_blacklist": "SELECT DISTINCT p_name || ' ' || p_brand AS keyword FROM part WHERE p_name || ' ' || p_brand NOT IN (SELECT p_name || ' ' || p_brand FROM part WHERE p_size > 40)",
}
