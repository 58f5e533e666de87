from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusieve.functions import urls
from corpusieve.operators import entities, feedback, highlight, learning, redaction, scoring, search, state, versions
from corpusieve.plans import fts
from corpusieve.plans.patterns import compile_pack
from corpusieve.settings import Settings
from corpusieve.sources import files, html, sinks
from corpusieve.streaming import attempts


def one(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


# -- entities


def test_entities_merge(spark):
    text = "[PAGE 1] Mail Ann@Example.com or ann@example.com. Call (212) 555-0100, 212-555-0100; SSN 123-45-6789"
    rows = {r.label: r for r in entities.merged(entities.extract(one(spark, doc_id=1, text=text))).collect()}
    assert (rows["EMAIL"].canonical, rows["EMAIL"]["count"], rows["EMAIL"].page_nos) == ("ann@example.com", 2, [1])
    assert (rows["PHONE"].canonical, rows["PHONE"]["count"]) == ("2125550100", 2)
    assert rows["SSN"].canonical == "123456789"
    assert entities.extract_by_page(one(spark, doc_id=1, text=text)).count() == 5


@pytest.mark.parametrize(("text", "label", "want"), [("Dr. Jane  Roe", "PERSON", "jane roe"), ("“Acme”, Inc!", "ORG", "acme, inc".replace(",", "")), ("(ﬁle)", "ORG", "file")])
def test_canonical(spark, text, label, want):
    assert one(spark, t=text).select(entities.canonical(F.col("t"), F.lit(label), normalise=True)).first()[0] == want


# -- search


def test_search_language(spark):
    rows = [(1, "hello", "hello world of café"), (2, "", "hello there big world"), (3, "other", "nothing")]
    index = search.build_index(spark.createDataFrame(rows, "doc_id long, title string, content string"))
    ids = lambda q: sorted(r.doc_id for r in search.search(index, q).collect())
    assert ids("hello world") == [1, 2]
    assert ids('"hello world"') == [1]
    assert ids("hel* NOT cafe") == [2]
    assert ids("NEAR(there world, 1)") == [2]
    assert ids("NEAR(hello world, 0)") == [1]
    assert ids("title:other OR content:cafe") == [1, 3]
    for bad in ("what?", '"open', "a AND", "(", "nope:x"):
        with pytest.raises(fts.QueryError):
            fts.parse(bad)


def test_find_falls_back(spark):
    docs = spark.createDataFrame([(1, "t", "50% off?"), (2, "t", "505 off")], "doc_id long, title string, content string")
    assert [r.doc_id for r in search.find(docs, "50% off?").collect()] == [1]
    assert [r.doc_id for r in search.like_search(docs, "50% OFF").collect()] == [1, 2]
    assert search.find(docs, "  ").count() == 0
    assert [r.doc_id for r in search.like_search(docs, "50%", literal=True).collect()] == [1]


def test_index_round_trip(spark, tmp_path):
    index = search.build_index(spark.createDataFrame([(1, "a", "b c")], "doc_id long, title string, content string"))
    index.write(f"file://{tmp_path}/i")
    assert search.search(search.Index.open(spark, f"file://{tmp_path}/i"), "b").count() == 1


# -- scores


@pytest.mark.parametrize(
    ("topic", "density", "score", "n", "boost", "p", "want"),
    [(0.2, 0.001, 0.0, 0, 0.0, None, True), (0.1, 0.0, 0.18, 1, 0.0, None, False), (0.1, 0.0, 0.18, 2, 0.0, None, True), (0.1, 0.0, 0.26, 0, 0.0, None, True), (0.0, 0.0, 0.0, 0, 0.22, None, True)]
    + [(0.2, 0.001, 0.0, 1, -0.22, None, False), (0.2, 0.001, 0.0, 2, -0.22, None, True), (0.0, 0.0, 0.0, 0, 0.0, 0.8, True), (0.2, 0.001, 0.0, 1, 0.3, 0.2, False), (None, 0.0, 0.0, 1, 0.0, None, True), (None, 0.0, 0.0, 0, 0.9, 0.9, False)],
)
def test_gate(spark, topic, density, score, n, boost, p, want):
    c = lambda v: F.lit(v).cast("double")
    assert spark.range(1).select(scoring.passes(c(topic), c(density), c(score), F.lit(n), c(boost), c(p))).first()[0] is want


def test_relevance_damps_negative_scores_too(spark):
    assert spark.range(1).select(scoring.relevance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.4), F.lit(0.0))).first()[0] == pytest.approx(-0.3)


def test_flagged_path(spark):
    row = one(spark, sha="abcdef0123456789", title=' My: "file".pdf ')
    paths = row.select(scoring.flagged_path("out", F.col("sha"), ".pdf", "hashed", F.col("title")), scoring.flagged_path("out", F.col("sha"), "pdf", "flat", F.lit(None).cast("string"))).first()
    assert list(paths) == ["out/ab/cd/My_ _file___abcdef0123.pdf", "out/file__abcdef0123.pdf"]


# -- redaction


@pytest.mark.parametrize(("text", "want"), [("", 0.0), ("was redacted", 0.25), ("█" * 19, 0.0), ("█" * 20, 0.05), ("[REDACTED]", 0.55), ("■" * 400 + "[redacted]", 1.0)])
def test_redaction_score(spark, text, want):
    assert one(spark, t=text).select(redaction.text_score(F.col("t"))).first()[0] == pytest.approx(want)


def test_area_and_pixels(spark):
    box = F.array(F.struct(F.lit(500.0).alias("width"), F.lit(100.0).alias("height"), F.lit(0.1).alias("darkness")))
    area = redaction.black_area_ratio(box, F.lit(600.0), F.lit(800.0))
    score = redaction.page_score(F.lit("short"), area, redaction.dark_pixel_ratio(F.array(*[F.lit(1)] * 256)))
    assert spark.range(1).select(area).first()[0] == pytest.approx(50000 / 480000)
    assert spark.range(1).select(score).first()[0] == pytest.approx(0.3125)


def test_otsu_splits_two_peaks(spark):
    h = spark.createDataFrame([(20, 100), (22, 50), (200, 80), (203, 10)], "bin int, n long")
    assert 22 <= redaction.otsu(h).first().threshold < 200


# -- state


def test_upsert_and_queue(spark):
    old = spark.createDataFrame([("a", "done", 1, None, None), ("b.pdf", "done", 1, "p", None), ("c.pdf", "done", 1, "p", "s"), ("d", "retry", 5, None, None)], "url string, status string, discovered_at long, local_path string, sha256 string")
    new = spark.createDataFrame([(u, "queued", 9) for u in ("a", "b.pdf", "c.pdf", "e")], "url string, status string, discovered_at long")
    got = {r.url: (r.status, r.discovered_at) for r in state.upsert_urls(old, new).collect()}
    assert got == {"a": ("done", 1), "b.pdf": ("queued", 1), "c.pdf": ("done", 1), "d": ("retry", 5), "e": ("queued", 9)}
    over = {r.url: (r.status, r.discovered_at) for r in state.upsert_urls(old, new, preserve_done=False).collect()}
    assert over["a"] == ("queued", 9) and over["d"] == ("retry", 5)
    queue = state.pending(state.upsert_urls(old, new), urls.known_document(F.col("url")))
    assert [r.url for r in queue.collect()] == ["d", "e", "b.pdf"]
    assert state.clear_pending(queue).where("status <> 'abandoned'").count() == 0


def test_entity_and_embedding_upserts(spark):
    schema = "doc_id long, label string, canonical string, variants array<string>, page_nos array<int>, count int"
    old = spark.createDataFrame([(1, "EMAIL", "a", ["A"], [1], 1)], schema)
    new = spark.createDataFrame([(1, "EMAIL", "a", ["b", "a", "a"], [2, 1, 2], 0), (1, "", "x", [], [], 1)], schema)
    (r,) = state.upsert_entities(old, new).collect()
    assert (r.variants, r.page_nos, r["count"]) == (["a", "b"], [1, 2], 1)
    schema = "doc_id long, model_name string, chunk_index int, vector array<float>"
    got = state.upsert_embeddings(spark.createDataFrame([(1, "m", 0, [1.0])], schema), spark.createDataFrame([(1, "m", 0, [2.0]), (1, "", 1, [3.0]), (2, "m", 0, None)], schema))
    assert [r.vector for r in got.collect()] == [[2.0]]


def test_reviews_purge_and_diff(spark):
    log = spark.createDataFrame([(1, "high_value", 1, 1), (1, "new", 2, 2), (2, "odd", 1, 1), (3, "ignored", 1, 1)], "doc_id long, status string, ts long, seq long")
    assert [tuple(r) for r in state.reviews(log).collect()] == [(3, "ignored")]
    tables = {"matches": log.select("doc_id"), "doc_reviews": log.select("doc_id")}
    left = state.purge(tables, spark.createDataFrame([(1,)], "doc_id long"))
    assert (left["matches"].count(), left["doc_reviews"].count()) == (2, 4)
    assert state.reset(tables)["matches"].count() == 0
    before = spark.createDataFrame([("a", None), ("b", "1"), ("c", "1")], "url string, sha256 string")
    after = spark.createDataFrame([("a", None), ("b", "2"), ("d", "1")], "url string, sha256 string")
    assert {r.url: r.change for r in state.snapshot_diff(before, after, compared=("sha256",)).collect()} == {"b": "changed", "c": "removed", "d": "added"}


def test_storage_updates(spark):
    docs = spark.createDataFrame([(1, "p", "s"), (2, None, "t")], "doc_id long, local_path string, sha256 string")
    got = state.update_storage(docs, spark.createDataFrame([(1, None, "x"), (2, "q", None)], docs.schema)).orderBy("doc_id").collect()
    assert [(r.local_path, r.sha256) for r in got] == [("p", "x"), ("q", "t")]
    moved = state.update_paths(docs, spark.createDataFrame([(" S ", "new")], "sha256 string, path string"))
    assert {r.sha256: r.local_path for r in moved.collect()} == {"s": "new", "t": None}
    assert state.update_metrics(docs, spark.createDataFrame([(1, 0.5)], "doc_id long, relevance_score double")).count() == 2
    assert state.valid_page_flags(spark.createDataFrame([(0, "x"), (1, ""), (1, "x")], "page_no int, flag string")).count() == 1


def test_spans(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8)], "k int, a int, b int")
    assert sorted((r.a, r.b) for r in state.merged_spans(rows, "k").collect()) == [(0, 5), (7, 9)]


def test_highlight(spark):
    docs = spark.createDataFrame([(1, "a <b> art & ART")], "doc_id long, text string")
    assert highlight.preview(docs, compile_pack(["art"])).first().html == "a &lt;b&gt; <mark>art</mark> &amp; <mark>ART</mark>"


# -- feedback and learning


def test_feedback(spark):
    log = spark.createDataFrame([(1, "irrelevant", "h", 1, 1), (2, "high_value", "h", 2, 2), (2, "high_value", "h", 3, 3)], "doc_id long, label string, host string, ts long, seq long")
    found = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, pattern string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "doc_id long, vector array<double>")
    got = feedback.apply_feedback(log, found, vectors)
    assert got["url_penalties"].first().penalty == 0.0
    assert [r.pattern for r in got["phrase_blacklist"].collect()] == ["x"]
    assert {r.label: (r.vector, r.norm) for r in got["centroids"].collect()} == {"irrelevant": ([1.0, 0.0], 1.0), "high_value": ([0.0, 2.0], 2.0)}
    parsed = feedback.penalties_from_json(spark.createDataFrame([('{"h": 0.1}',), ("no",)], "j string"), "j").collect()
    assert [r.penalties for r in parsed] == [{"h": 0.1}, {}]


def test_flagger(spark):
    rows = [([float(i % 2), 1.0], i % 2, 0.1 * i, 0.5, None) for i in range(20)]
    df = spark.createDataFrame(rows, "embedding array<double>, label int, relevance_score double, topic_similarity double, entity_density double")
    model = learning.train(df)
    p = learning.probability(model, F.col("embedding"), [F.col(m) for m in learning.METRICS])
    assert learning.metrics(df.select("label", p.alias("score"))).first().auc == 1.0
    assert learning.Flagger.from_json(model.to_json()) == model
    assert learning.Flagger.from_json("{}") is None and learning.Flagger.from_json(json.dumps({**json.loads(model.to_json()), "version": 9})) is None
    assert learning.train(df.limit(3)) is None
    assert df.select(learning.probability(model, F.array(F.lit(1.0)), [F.lit(0.0)] * 3)).first()[0] == 0.5


# -- sources and sinks


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><style>x</style></head><body><p>One</p><script>no</script> <noscript>no</noscript>Two &lt;</body>"
    row = one(spark, h=page).select(html.title(F.col("h"), F.lit("f")), html.text(F.col("h")), html.not_pdf(F.col("h"), F.lit("")), html.not_pdf(F.lit(" %PDF-1.4"), F.lit("application/pdf")), html.age_gate(F.lit("Are you 18?"), F.lit(""))).first()
    assert list(row) == ["A & B", "A & B\nOne\nTwo <", True, False, True]
    assert one(spark, h="Access Denied errors.edgesuite.net").select(html.blocked(F.lit(403), F.col("h"))).first()[0]


def test_index_numbers_round_by_their_exact_value(spark):
    values = [1 / 128, 3 / 128, -1 / 128, 1 / 640, 5e-5, 0.00125, -0.00005, 5e-7, 0.9999995, 1 / 32, -0.0, 1e-300, 123456.5, 99999999999999991611392.0, float("nan"), float("-inf"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    lines = sinks.index_lines(rows.select(*[F.col("v").alias(c) for c in ("relevance_score", "topic_similarity", "entity_density")], F.lit(None).cast("string").alias("review_status"), F.col("i").cast("string").alias("local_path"), F.lit("").alias("url"), F.lit("").alias("title")))
    got = {int(r.local_path): (r.relevance_score, r.topic_similarity, r.entity_density) for r in lines.collect()}
    assert got == {i: ("",) * 3 if v is None else (f"{v:.4f}", f"{v:.4f}", f"{v:.6f}") for i, v in enumerate(values)}
    assert got[0][2] == "0.007812" and got[1][2] == "0.023438"


def test_references_without_a_semicolon_stay(spark):
    pages = {"<title>a&amp;&amp</title>b": "a&&amp\nb", "<p>x &ampfoo; &lt &copy1 &amp;lt;": "x &ampfoo; &lt &copy1 &lt;", "<p>&#39;&#39 &quot;\ufdd0 &am</p>&": "'' \"\ufdd0 &am\n&", "&copy": "&copy", "<a href='?a&lt=1'>&middot;</a>": "·"}
    for page, want in pages.items():
        assert one(spark, h=page).select(html.text(F.col("h"))).first()[0] == want, page


def test_urls(spark):
    row = one(spark, u="HTTPS://User@WWW.Example.com:80//a//b.PDF?q=1#f").select(urls.normalized(F.col("u")), urls.site(F.lit("https://www.a.b/x")), urls.looks_downloadable(F.col("u")), urls.known_document(F.col("u")), urls.first_page(F.lit("x?page=12&a=1"))).first()
    assert list(row) == ["https://user@www.example.com:80/a/b.PDF?q=1", "a.b", True, False, "x?page=0&a=1"]
    scope = one(spark, a="https://x/start/page", b="https://x/page", c="https://x/start").select(*[urls.in_scope(F.col(c), ["https://x/start/"]) for c in "abc"]).first()
    assert list(scope) == [True, False, True]
    links = one(spark, h="""<a href="/a/../b.pdf">x</a><a class=k href='mailto:x'>y</a>""").select(F.explode(urls.links(F.col("h"))).alias("l"))
    assert [r[0] for r in links.select(urls.resolved(F.col("l"), F.lit("https://x/y/z"))).collect()] == ["https://x/b.pdf"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hi\xff there")
    (tmp_path / "b.html").write_text("<p>x</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:document>')
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    got = {r.path[-5:]: r.text for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": "hi there", ".html": "x", "c.pdf": None, ".docx": "One\nTwo"}


def test_packs(tmp_path):
    pack = {"seed_keywords": ["A", "a", " "], "categories": {"x": ["b"]}, "regex_patterns": {"r": ["c+", "re:d"]}, "wildcards_and_globs": {"examples": ["e*"]}, "semantic_hint_tokens": ["f"], "euphemism_and_codeword_expansion_rules": {"example_expansions": {"s": ["g"]}}}
    assert files.pack_keywords(pack) == ["A", "b", "re:c+", "re:d", "e*", "f", "g"]
    files.save_pack(str(tmp_path / "p.json"), ["x", "X", "y"])
    assert files.load_packs([str(tmp_path / "p.json"), str(tmp_path / "none")]) == (["x", "y"], [str(tmp_path / "none")])


def test_robots_and_tables(spark):
    df = one(spark, b="User-agent: *\nDisallow: /private", u="https://x/private/a")
    assert df.select(files.robots_allows(F.col("b"), "bot", F.col("u")), files.robots_allows(F.lit(None).cast("string"), "bot", F.col("u"))).first()[:] == (False, True)
    cells = spark.createDataFrame([([["a", None]],), ([[]],)], "c array<array<string>>")
    assert [r[0] for r in cells.select(files.clean_table(F.col("c"))).collect()] == [[["a", ""]], None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, None, 0.1, "high_value", "p", "u", "t"), (None, 0.2, None, None, None, None, None), (0.9, 0.1, 0.2, "new", "q", "v", "w")], "relevance_score double, topic_similarity double, entity_density double, review_status string, local_path string, url string, title string")
    sinks.write_sorted_index(rows, f"file://{tmp_path}/i", one_file=True)
    lines = next((tmp_path / "i").glob("part-*")).read_text().splitlines()
    assert [x.split("\t")[0] for x in lines] == ["relevance_score", "0.9000", "0.5000", ""]
    sinks.write_indexes_by_review(rows, f"file://{tmp_path}/by")
    assert files.read_labelled_tsv(spark, f"file://{tmp_path}/by/high_value", "high_value").first().relevance_score == 0.5
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = sinks.nested(docs, {"m": (spark.createDataFrame([(1, "b"), (1, "a")], "doc_id long, p string"), ["p"])}).orderBy("doc_id").collect()
    assert [[x.p for x in r.m] for r in out] == [["a", "b"], []]


def test_index_lines_are_in_the_order_of_the_index(spark):
    scores = [None, *[(i * 37 % 101 - 50) / 60_000 for i in range(400)], float("-inf"), 0.5, -0.5]
    rows = [(s, "" if i % 3 else None, f"p{i:03}", f"u{i % 5}") for i, s in enumerate(scores)]
    own = spark.createDataFrame(rows, "relevance_score double, review_status string, local_path string, url string").repartition(7, "local_path")
    lines = sinks.index_lines(own.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("topic_similarity", "double"), ("entity_density", "double"), ("title", "string"))]))
    assert lines.columns == list(sinks.INDEX)
    got = lines.collect()
    assert [r.local_path for r in got] == [r[2] for r in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[3], r[2]))]
    assert {r.review_status for r in got} == {"new"} and got[-1].relevance_score == ""


def test_semantic_sorted_index_is_sorted(spark, sf_dir):
    from corpusieve.queries import QUERIES

    got = [float(r.relevance_score) for r in QUERIES["semantic_sorted_index"](spark, sf_dir).collect()]
    assert len(got) > 100 and got == sorted(got, reverse=True)


def test_settings(tmp_path):
    s = Settings(retries=7, keywords=("a",))
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")) == s
    assert Settings.load(str(tmp_path / "none")) == Settings()


# -- streams


def test_stream_equals_batch(spark, tmp_path):
    schema = "url string, status string, ts timestamp, seq long"
    rows = [(f"u{i % 5}", "done" if i % 3 else "retry", f"2024-01-01 0{i % 9}:00:00", i) for i in range(30)]
    log = spark.createDataFrame(rows, "url string, status string, t string, seq long").select("url", "status", F.to_timestamp("t").alias("ts"), "seq")
    for k in range(3):
        log.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    stream = attempts.source(spark, f"file://{tmp_path}/log", log.schema, files=1)
    attempts.keep_latest(stream, f"file://{tmp_path}/state", f"file://{tmp_path}/c1", "url", "ts", "seq").awaitTermination()
    assert sorted(map(tuple, attempts.current_state(spark, f"file://{tmp_path}/state").select("url", "seq").collect())) == sorted(map(tuple, state.latest(log, "url", "ts", "seq").select("url", "seq").collect()))
    assert schema.count(",") == 3
    counted = attempts.status_counts(attempts.source(spark, f"file://{tmp_path}/log", log.schema), "ts", "status", late="1 day")
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c2").start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, attempts.status_counts(log, "ts", "status").collect()))


def test_stream_new_documents_and_rates(spark, tmp_path):
    rows = spark.createDataFrame([("h", 503, "s1"), ("h", 503, "s1"), ("h", 200, "s2")], "host string, status int, sha256 string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = attempts.source(spark, f"file://{tmp_path}/in", rows.schema)
    seen: list[int] = []
    attempts.for_each(attempts.new_documents(stream, "ts"), f"file://{tmp_path}/c1", lambda b, n: seen.append(b.count())).awaitTermination()
    assert sum(seen) == 2
    rates: list[float] = []
    attempts.host_rates(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: rates.extend(r.rate for r in b.collect())).option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert rates[-1] == pytest.approx(0.25 * 1.05)


# -- rows that repeat, and what is stored


def test_long_page_numbers(spark):
    text = "[PAGE 99999999999] a@b.org [PAGE 2]\nc@d.org"
    assert [(r.page_no, r.text) for r in entities.extract(one(spark, doc_id=1, text=text)).orderBy("start").collect()] == [(None, "a@b.org"), (2, "c@d.org")]
    assert [r.page_no for r in entities.extract_by_page(one(spark, doc_id=1, text=text)).collect()] == [None, 2]
    hidden = "[PAGE 99999999999]\n[redacted]\n[PAGE 2]\n[REDACTED] redaction"
    assert [r.page_no for r in redaction.page_flags(one(spark, doc_id=1, text=hidden)).collect()] == [2]


def test_engines(spark):
    def make():
        return lambda t: [("PERSON", "Jane Roe", t.index("Jane Roe"))] if "Jane Roe" in t else []

    entities.ENGINES["names"] = lambda text: F.concat(entities.mentions(text), entities.tagged(text, make))

    def broken(text):
        raise ImportError("no such library")

    entities.ENGINES["broken"] = broken
    try:
        own = one(spark, doc_id=1, text="[PAGE 3] Jane Roe, j@r.org")
        assert {(r.label, r.text, r.page_no, r.start) for r in entities.extract(own, "names").collect()} == {("PERSON", "Jane Roe", 3, 9), ("EMAIL", "j@r.org", 3, 19)}
        for name in ("regex", "broken", "spacy", None):
            assert [r.label for r in entities.extract(own, name).collect()] == ["EMAIL"]
    finally:
        del entities.ENGINES["names"], entities.ENGINES["broken"]


def test_wide_letters_are_one_entity(spark):
    found = spark.createDataFrame([(1, "ORG", 4, "ＡＣＭＥ", 0, 1), (1, "ORG", 4, "acme", 9, 1)], "doc_id long, label string, label_order int, text string, start int, page_no int")
    (row,) = entities.merged(found).collect()
    assert (row.canonical, row["count"]) == ("acme", 2)


def test_repeated_incoming_rows(spark):
    schema = "url string, status string, discovered_at string, local_path string, sha256 string"
    have = spark.createDataFrame([("a", "done", "1", "p", "s")], schema)
    new = spark.createDataFrame([("a", "queued", "2"), ("a", "retry", "3"), ("b", "queued", "2"), ("b", "retry", "1")], "url string, status string, discovered_at string")
    assert sorted(tuple(r)[:3] for r in state.upsert_urls(have, new).collect()) == [("a", "done", "1"), ("b", "queued", "2")]
    assert sorted(tuple(r)[:3] for r in state.upsert_urls(have, new, preserve_done=False).collect()) == [("a", "retry", "3"), ("b", "queued", "2")]
    table = spark.createDataFrame([("k", 1, "old"), (None, 1, "x"), ("m", 1, "kept")], "key string, n int, v string")
    incoming = spark.createDataFrame([("k", 1, "new"), ("k", 2, "newer"), (None, 3, "y")], "key string, n int, v string")
    assert sorted(map(str, (tuple(r) for r in state.upsert(table, incoming, "key").collect()))) == sorted(map(str, [("k", 2, "newer"), (None, 3, "y"), ("m", 1, "kept")]))
    assert sorted(map(str, (tuple(r) for r in state.upsert(table, table, "key").collect()))) == sorted(map(str, (tuple(r) for r in table.collect())))


def test_metrics_of_other_documents_stay(spark):
    docs = spark.createDataFrame([(1, 0.1, "a"), (2, 0.2, "b"), (3, None, "c")], "doc_id long, relevance_score double, title string")
    new = spark.createDataFrame([(1, 0.9, 5), (3, None, 6)], "doc_id long, relevance_score double, n int")
    got = {r.doc_id: (r.relevance_score, r.title, r.n) for r in state.update_metrics(docs, new).collect()}
    assert got == {1: (0.9, "a", 5), 2: (0.2, "b", None), 3: (None, "c", 6)}


def test_last_row_of_a_snapshot_wins(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "url string, sha256 string, at int")
    diff = lambda a, b: {r.url: r.change for r in state.snapshot_diff(a, b, ("sha256",), order=("at",)).collect()}
    assert diff(rows(("u", "x", 2), ("u", "z", 1)), rows(("u", "x", 1))) == {}
    assert diff(rows(("u", "x", 1), ("u", "z", 2)), rows(("u", "x", 1), ("v", None, 1))) == {"u": "changed", "v": "added"}


def test_snapshots(spark, tmp_path):
    def urls(*rows):
        own = spark.createDataFrame(list(rows), "url string, status string, sha256 string")
        return own.withColumns({c: F.lit(None).cast("string") for c in state.COMPARED if c != "sha256"})

    store = state.Snapshots(spark, f"file://{tmp_path}/s")
    assert store.numbers() == [] and store.last_diff() is None
    assert store.take(urls(("a", "done", "1"), ("b", "abandoned", "1"), ("c", None, "1"))) == 0
    assert store.last_diff() is None and sorted(r.url for r in store.read(0).collect()) == ["a", "c"]
    urls().write.parquet(f"file://{tmp_path}/s/snapshot=1/urls")  # never finished
    assert store.take(urls(("a", "done", "2"), ("b", "queued", "1"))) == 1
    assert {r.url: r.change for r in store.last_diff().collect()} == {"a": "changed", "b": "added", "c": "removed"}


@pytest.mark.parametrize("scale", [False, True])
def test_folds_equal_the_walk(spark, scale):
    import random

    dice, rows = random.Random(4), []
    for n in range(3000):
        rows.append((f"h{dice.choice([0, 0, 0, 1, 2])}", n // 3, n, dice.choice([0.5, 1.05, 1.05, 1.3] if scale else [0.05, -0.03, 0.0, 0.2, -0.3])))
    want: dict[str, float] = {}
    for host, _, _, x in rows:
        at = want.get(host, 1.0 if scale else 0.0)
        want[host] = max(0.2, min(1.0, at * x)) if scale else max(0.0, min(0.6, at + x))
    dice.shuffle(rows)
    log = spark.createDataFrame(rows, "host string, ts long, seq long, x double")
    got = state.folded(log, "host", ["ts", "seq"], "x", "end", *((0.2, 1.0, 1.0, True) if scale else (0.0, 0.6, 0.0)))
    assert {r.host: r.end for r in got.collect()} == pytest.approx(want)
    assert state.folded(log.limit(0), "host", ["ts", "seq"], "x", "end", 0.0, 1.0, 0.0).count() == 0


def test_metrics_equal_counting(spark):
    import random

    dice = random.Random(2)
    rows = [(dice.randint(0, 1), dice.choice([0.1, 0.2, 0.5, 0.5, dice.random()])) for _ in range(400)]
    (got,) = learning.metrics(spark.createDataFrame(rows, "label int, score double")).collect()
    good, bad = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert (got.n, got.auc, got.accuracy) == (400, pytest.approx(auc), pytest.approx(sum((s >= 0.5) == y for y, s in rows) / 400))


def test_index_grows_by_segments(spark, tmp_path):
    docs = lambda *x: spark.createDataFrame(list(x), "doc_id long, title string, content string")
    root, first, more = f"file://{tmp_path}/i", docs((1, "a", "b c")), docs((1, "a", "b c"), (2, "x", "b d"))
    with pytest.raises(ValueError, match="no index"):
        search.Index.open(spark, root)
    assert search.Index.append(first, root) and search.Index.append(more, root) and not search.Index.append(more, root)
    whole, texts = search.search(search.Index.open(spark, root), "b"), search.search(more, "b")
    assert [tuple(r) for r in whole.collect()] == [tuple(r) for r in texts.collect()] != []
    first.limit(0).write.parquet(f"{root}/segment=lost/postings")  # no version names it
    assert len(search.Index.segments(spark, root)) == 2


@pytest.mark.parametrize("query", ["hello world", '"hello world"', "hel* NOT cafe", "NEAR(there world, 1)", "NEAR(hello world, 0)", "title:other OR content:cafe", "hello OR wor*", '"hello there" big', "title:hello"])
def test_search_with_and_without_an_index(spark, query):
    rows = [(1, "hello", "hello world of café"), (2, "", "hello there big world"), (3, "other", "nothing"), (4, None, None), (5, "hello world", "world hello world hello")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string")
    found = [[(r.doc_id, pytest.approx(r.bm25)) for r in search.search(source, query).collect()] for source in (docs, search.build_index(docs))]
    assert found[0] == found[1] != []


def test_lookup(spark):
    own = spark.createDataFrame([(1, "a", None), (1, "b", 2), (2, None, 3)], "id long, s string, n int")
    get = lambda v: tuple(state.lookup(own, "id", v, {"s": "none", "n": 0}).first())
    assert (get(1), get(2), get(9)) == ((1, "a", 0), (2, "none", 3), (9, "none", 0))


def test_links(spark):
    page = """<a href="/a">x</a><A class=y HREF='/b c'>y</a><a href=/d>z</a><a href="">e</a><a href="MAILTO:x@y">m</a><a name="n">n</a>"""
    assert one(spark, h=page).select(urls.links(F.col("h"))).first()[0] == ["/a", "/b c", "/d"]


def test_state_of_a_stream_rewrites_only_touched_buckets(spark, tmp_path):
    log = spark.range(200).select(F.concat(F.lit("u"), (F.col("id") % 40).cast("string")).alias("url"), F.col("id").alias("seq"))
    root = f"file://{tmp_path}/state"
    for k, part in enumerate((log.where("seq < 150"), log.where("seq = 150"), log.where("seq > 150"))):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
        stream = attempts.source(spark, f"file://{tmp_path}/log", log.schema, files=1)
        attempts.keep_latest(stream, root, f"file://{tmp_path}/c", "url", "seq", buckets=8).awaitTermination()
        versions = attempts._versions(spark, root)
        assert set(versions) == set(range(8)) and all(len(v) <= 2 for v in versions.values())
        if k == 1:
            assert sorted(map(len, versions.values())) == [1] * 7 + [2]
    got = {r.url: r.seq for r in attempts.current_state(spark, root).collect()}
    assert got == {f"u{i}": 160 + i for i in range(40)}


def test_labelled_source_takes_the_index_first(spark, tmp_path):
    for name in ("high_value/a.txt", "high_value/semantic_sorted.txt", "irrelevant/b.pdf", "irrelevant/c.exe", "irrelevant/semantic_sorted.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    head = "relevance_score\ttopic_similarity\tentity_density\treview_status\tlocal_path\turl\ttitle\n"
    (tmp_path / "high_value/semantic_sorted.txt").write_text(head + "0.5\tx\t\thigh_value\tp/1\tu\tt\n" + "0.1\t\t\tirrelevant\tp/2\tu\tt\n")
    (tmp_path / "irrelevant/semantic_sorted.txt").write_text(head)
    rows = files.read_labelled(spark, f"file://{tmp_path}", ("high_value", "irrelevant", "missing")).collect()
    assert sorted((r.review_status, r.local_path.rpartition("/")[2], r.relevance_score) for r in rows) == [("high_value", "1", 0.5), ("irrelevant", "b.pdf", None)]


def test_append_with_a_clock(spark, tmp_path):
    import datetime

    at, root = datetime.datetime(2024, 5, 1, 12), f"file://{tmp_path}"
    sinks.append(spark.createDataFrame([(1, "keyword", "a", 1.0, 9)], "doc_id long, method string, pattern string, score double, extra int"), "matches", root, at)
    sinks.append(spark.createDataFrame([(2, "query")], "doc_id int, method string"), "matches", root)
    rows = {r.doc_id: r for r in spark.read.parquet(f"{root}/matches").collect()}
    assert rows[1].created_at == at and rows[2].created_at > at and rows[2].pattern is None and "extra" not in rows[1]


def test_missing_provider_and_centroids(spark):
    from corpusieve.operators import embedding

    def broken():
        raise ImportError("no such library")

    assert embedding.available(broken) is None and embedding.available(None) is None
    assert embedding.available(embedding.HashingProvider) is embedding.HashingProvider
    have = spark.createDataFrame([("high_value", "m", [1.0], 1), ("irrelevant", "m", [2.0], 1)], "label string, model_name string, vector array<float>, count long")
    new = spark.createDataFrame([("high_value", "m", [3.0], 2), ("irrelevant", "m", None, 0)], have.schema)
    assert {r.label: r.vector for r in feedback.upsert_centroids(have, new).collect()} == {"high_value": [3.0], "irrelevant": [2.0]}


def test_repeated_updates_of_a_key_are_one(spark):
    docs = spark.createDataFrame([(1, "p", "s"), (2, "q", "t")], "doc_id long, local_path string, sha256 string")
    moved = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (1, "b", "x")], "doc_id long, local_path string, sha256 string")
    assert sorted(map(tuple, state.update_storage(docs, moved).select("doc_id", "local_path", "sha256").collect())) == [(1, "b", "x"), (2, "q", "t")]
    paths = spark.createDataFrame([(" S", "m"), ("s", "n"), ("t", None)], "sha256 string, path string")
    assert sorted(r.local_path for r in state.update_paths(docs, paths).collect()) == ["n", "q"]
    metrics = spark.createDataFrame([(1, 0.5, None), (1, 0.75, 1.0), (1, 0.75, 0.5)], "doc_id long, m double, n double")
    assert sorted((r.doc_id, r.m, r.n) for r in state.update_metrics(docs, metrics).collect()) == [(1, 0.75, 1.0), (2, None, None)]


def test_index_follows_its_documents(spark, tmp_path):
    """After each step scores are those of an index that was built anew."""
    schema = "doc_id long, title string, content string, segment int"
    made = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    store, state_of = search.Store(spark, f"file://{tmp_path}/i"), {}
    words = ["hello", "world", "café", "log", "x"]
    first = [(i, words[i % 5], " ".join(words[(i * k) % 5] for k in range(i % 7))) for i in range(30)]

    def same():
        fresh = search.build_index(made([(i, *t) for i, t in sorted(state_of.items())]))
        opened = search.Index.open(spark, store.root)
        assert (opened.documents, opened.lengths.count()) == (len(state_of), len(state_of))
        for query in ("hello", "log OR cafe", '"hello world"', "hello NOT x", "title:world"):
            a, b = ([(r.doc_id, pytest.approx(r.bm25)) for r in search.search(i, query).collect()] for i in (opened, fresh))
            assert a == b
        return opened

    with pytest.raises(ValueError, match="no index"):
        store.index()
    assert store.upsert(made([*first, (None, "no", "id"), (3, "a", "aa")]))  # of the two rows of 3 the greater one counts
    state_of.update({i: (t, c) for i, t, c in first})
    state_of[3] = max(state_of[3], ("a", "aa"))
    same()
    assert not store.upsert(made(first[4:9])) and len(store.now["segments"]) == 1
    for k in range(4):  # each changes some and adds one
        rows = [(i, "hello", f"changed {k} log") for i in range(k, 30, 6)] + [(100 + k, None, "hello world")]
        assert store.upsert(made(rows))
        state_of.update({i: (t, c) for i, t, c in rows})
    same()
    assert store.remove(made([(5, "", ""), (100, "", ""), (999, "", "")])) == 2 and store.remove(made([(5, "", "")])) == 0
    state_of.pop(5), state_of.pop(100)
    same()
    assert store.upsert(made([(5, "back", "hello")])) and not store.upsert(made([(5, "back", "hello")]))
    state_of[5] = ("back", "hello")
    before = len(store.now["segments"])
    assert store.merge() < before
    same()
    assert store.merge(everything=True) == 1 and store.now["dead"] == []
    assert store.vacuum() > 0 and store.vacuum() == 0
    opened = same()
    assert opened.dead is None and opened.postings.select("doc_id").distinct().count() <= len(state_of)


def test_index_writers_at_once(spark, tmp_path):
    made = lambda i: spark.createDataFrame([(i, "hello", "world")], "doc_id long, title string, content string")
    root = f"file://{tmp_path}/i"
    one, two = search.Store(spark, root), search.Store(spark, root)
    assert one.upsert(made(1))
    with pytest.raises(versions.Conflict):
        two.upsert(made(2))
    again = search.Store(spark, root)
    assert again.upsert(made(2)) and again.vacuum() == 1 and again.index().documents == 2
    assert [r.doc_id for r in search.search(again.index(), "hello").collect()] == [1, 2]
