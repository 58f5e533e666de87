"""Queries over the event log, read as a log of URL attempts and of reviews, and their SQL.

A user's event type is a URL, `error` is `retry`, and reviews go by users; this reading is our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.functions import http
from corpusieve.operators import feedback, state
from corpusieve.runtime import scratch, table
from corpusieve.streaming import attempts

_STATUS = {"error": "retry", "view": "queued", "click": "processing", "signup": "done"}
_LABEL = {"purchase": "high_value", "error": "irrelevant", "click": "reviewed", "signup": "new"}


def _mapped(column: str, names: dict[str, str], other: str):
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _sql_mapped(column: str, names: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{other}' END"


def log(spark: SparkSession, d: str) -> DataFrame:
    """url, status, ts, event_id, value and k of every attempt."""
    suffix = F.when(F.col("user_id") % 3 == 0, ".pdf").otherwise("")
    return table(spark, d, "events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"), suffix).alias("url"), _mapped("event_type", _STATUS, "abandoned").alias("status"), "ts", "event_id", "value", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


_LOG = f"SELECT event_type || ':' || user_id || CASE WHEN user_id % 3 = 0 THEN '.pdf' ELSE '' END AS url, {_sql_mapped('event_type', _STATUS, 'abandoned')} AS status, ts, event_id, value, TRY_CAST(props->>'$.k' AS INT) AS k FROM events"


def review_log(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), _mapped("event_type", _LABEL, "ignored").alias("label"), F.concat(F.lit("host"), (F.col("user_id") % 50).cast("string")).alias("host"), "ts", F.col("event_id").alias("seq"))


REVIEWS_SQL = f"SELECT user_id AS doc_id, {_sql_mapped('event_type', _LABEL, 'ignored')} AS label, 'host' || (user_id % 50) AS host, ts, event_id AS seq FROM events"


def url_latest_state(spark, d):
    return state.latest(log(spark, d), "url", "ts", "event_id").select("url", "status", "event_id", F.round("value", 6).alias("value"))


def url_last_known(spark, d):
    """As above, but of each column the last value that is not null."""
    own = log(spark, d).withColumn("k", F.when(F.col("k") % 2 == 0, F.col("k")))
    return state.latest_known(own, "url", ["ts", "event_id"], ["status", "k"])


def _state(attempts: DataFrame) -> DataFrame:
    own = state.latest(attempts, "url", "ts", "event_id")
    return own.select("url", "status", F.col("ts").alias("discovered_at"), F.when(F.col("event_id") % 4 == 0, "p").alias("local_path"), F.when(F.col("event_id") % 3 != 0, "s").alias("sha256"))


def _even(spark, d) -> DataFrame:
    """The state that the upserts start from: even events; odd ones are what comes in."""
    return _state(log(spark, d).where("event_id % 2 = 0"))


_LAST = "SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS rn FROM ({}) WHERE event_id % 2 = {}"
_STATE_OF = "SELECT url, status, ts AS discovered_at, CASE WHEN event_id % 4 = 0 THEN 'p' END AS local_path, CASE WHEN event_id % 3 <> 0 THEN 's' END AS sha256 FROM ({}) WHERE rn = 1"
_EVEN = _STATE_OF.format(_LAST.format(_LOG, 0))
_STATE = _STATE_OF.format(f"SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS rn FROM ({_LOG})")
_NEW = f"SELECT url, 'queued' AS status, ts AS discovered_at FROM ({_LAST.format(_LOG, 1)}) WHERE rn = 1"


def url_upsert_preserve_done(spark, d):
    new = state.latest(log(spark, d).where("event_id % 2 = 1"), "url", "ts", "event_id").select("url", F.lit("queued").alias("status"), F.col("ts").alias("discovered_at"))
    return state.upsert_urls(_even(spark, d), new)


def url_upsert_overwrite(spark, d):
    new = state.latest(log(spark, d).where("event_id % 2 = 1"), "url", "ts", "event_id").select("url", F.lit("queued").alias("status"), F.col("ts").alias("discovered_at"))
    return state.upsert_urls(_even(spark, d), new, preserve_done=False)


def url_upsert_repeated(spark, d):
    """All odd events come in, several of a URL: the last of each counts."""
    return state.upsert_urls(_even(spark, d), log(spark, d).where("event_id % 2 = 1").select("url", "status", F.col("ts").alias("discovered_at")))


def _fetches(spark, d, rest: int):
    return log(spark, d).where(f"event_id % 3 <> {rest}").select("url", "status", "k", "ts", "event_id")


def snapshot_diff_repeated(spark, d):
    """Logs as snapshots, in which a URL has many rows: the last of each counts."""
    return state.snapshot_diff(_fetches(spark, d, 0), _fetches(spark, d, 1), ("status", "k"), order=("ts", "event_id"))


def _urls(spark, d, where: str):
    own = state.latest(log(spark, d).where(where), "url", "ts", "event_id")
    nulls = {c: F.lit(None).cast("string") for c in ("etag", "last_modified", "final_url", "content_type")}
    return own.select("url", "status", F.col("k").cast("string").alias("sha256"), F.lit(200).alias("http_status"), F.col("ts").alias("discovered_at")).withColumns(nulls)


def snapshot_last_diff(spark, d):
    """What changed between the last two of three stored snapshots; abandoned URLs are in none."""
    store = state.Snapshots(spark, scratch(spark, "snapshots"))
    for where in ("event_id % 5 = 0", "event_id % 5 < 3", "true"):
        store.take(_urls(spark, d, where))
    return store.last_diff()


def request_headers(spark, d):
    """Conditions of the next request for each URL, and what an answer means."""
    own = _urls(spark, d, "true").withColumns({"etag": F.when(F.length("url") % 2 == 0, F.concat(F.lit("e"), F.col("sha256"))), "last_modified": F.when(F.length("url") % 3 == 0, "Mon, 01 Jan 2024 00:00:00 GMT"), "part": (F.length("url") % 4).cast("long")})
    asked = http.conditions(F.col("etag"), F.col("last_modified"), F.col("part"))
    code = F.get(F.array(*[F.lit(x) for x in (200, 206, 304, 404, 503)]), (F.col("sha256").cast("int") % 5).cast("int"))
    return own.select("url", *[asked[x].alias(x) for x in ("if_none_match", "if_modified_since", "range")], http.outcome(code, F.col("part")).alias("outcome"), http.whole_size(F.col("sha256"), code, F.col("part")).alias("size"))


def clear_pending(spark, d):
    return state.clear_pending(_state(log(spark, d))).groupBy("status").agg(F.count("*").alias("n"))


def review_latest(spark, d):
    return state.reviews(review_log(spark, d).withColumnRenamed("label", "status"))


def pending_queue(spark, d):
    return state.pending(_state(log(spark, d)), F.lower("url").endswith(".pdf")).select("url", "status", "discovered_at")


def diag_status_counts(spark, d):
    return log(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.lower("url").endswith(".pdf").cast("long")).alias("n_pdf"))


def diag_done_detail(spark, d):
    done = F.col("status") == "done"
    return _state(log(spark, d)).agg(F.sum(done.cast("long")).alias("done"), F.sum((done & F.col("local_path").isNull()).cast("long")).alias("done_no_path"), F.sum((done & F.col("sha256").isNull()).cast("long")).alias("done_no_sha"))


def url_penalty_fold(spark, d):
    return feedback.host_penalties(review_log(spark, d)).select("host", F.round("penalty", 6).alias("penalty"))


def host_throttle_fold(spark, d):
    own = table(spark, d, "events").select((F.col("user_id") % 50).alias("host"), "ts", "event_id", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("code"))
    steps = own.select("host", "ts", "event_id", state.throttle_factors(F.col("code")).alias("factor"))
    return state.folded(steps, "host", ["ts", "event_id"], "factor", "rate", 0.2, 1.0, 1.0, scale=True).select("host", F.round("rate", 6).alias("rate"))


def backoff_schedule(spark, d):
    own = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("attempt"))
    return own.select("attempt", F.round(state.backoff(F.col("attempt")), 6).alias("seconds"))


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("url"), "c_name", "c_acctbal", F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("n"))
    after = own.where("url % 11 <> 0").withColumn("c_acctbal", F.when(F.col("url") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("n", F.when(F.col("url") % 5 == 0, None).otherwise(F.col("n")))
    return own.where("url % 13 <> 0"), after


def release_diff(spark, d):
    return state.snapshot_diff(*_snapshots(spark, d), compared=("c_name", "c_acctbal", "n"))


def release_added_removed(spark, d):
    before, after = _snapshots(spark, d)
    only = lambda a, b, name: a.select("url").exceptAll(b.select("url")).withColumn("change", F.lit(name))
    return only(after, before, "added").unionByName(only(before, after, "removed"))


def merge_spans(spark, d):
    own = table(spark, d, "events").select("user_id", (F.col("event_id") % 1000).alias("a"), (F.col("event_id") % 1000 + F.col("event_id") % 37 + 1).alias("b"))
    return state.merged_spans(own, "user_id")


def json_props(spark, d):
    own = table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return own.groupBy("event_type").agg(F.sum(F.col("p.k").cast("long")).alias("k"), F.count("p.k").alias("n"))


def stream_status_counts(spark, d):
    """The batch form of the windowed counts; a test runs the same code on a stream."""
    return attempts.status_counts(log(spark, d), "ts", "status")


def kv_latest(spark, d):
    """A key-value table as the last write of each key."""
    own = table(spark, d, "events").select(F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("key"), F.col("props").alias("value"), "ts", "event_id")
    return state.latest(own, "key", "ts", "event_id").select("key", "value")


def attempts_by_status(spark, d):
    """The newest ten attempts of some statuses."""
    own = log(spark, d).where(F.col("status").isin("done", "retry"))
    return own.orderBy(F.desc("ts"), "event_id").limit(10).select("url", "status", "event_id")


QUERIES = {
    f.__name__: f
    for f in (url_latest_state, url_last_known, url_upsert_preserve_done, url_upsert_overwrite, url_upsert_repeated, snapshot_diff_repeated, snapshot_last_diff, request_headers, clear_pending, review_latest, pending_queue, diag_status_counts, diag_done_detail, url_penalty_fold, host_throttle_fold)
    + (backoff_schedule, release_diff, release_added_removed, merge_spans, json_props, stream_status_counts, kv_latest, attempts_by_status)
}

_BEFORE = "SELECT c_custkey AS url, c_name, c_acctbal, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS n FROM customer WHERE c_custkey % 13 <> 0"
_AFTER = "SELECT c_custkey AS url, c_name, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS c_acctbal, CASE WHEN c_custkey % 5 <> 0 AND c_nationkey > 3 THEN c_nationkey END AS n FROM customer WHERE c_custkey % 11 <> 0"
_FETCHED = f"SELECT url, status, k FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS rn FROM ({_LOG}) WHERE event_id % 3 <> {{}}) WHERE rn = 1"
_TAKEN = f"SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS rn FROM ({_LOG}) WHERE {{}}"
_FOLD = "list_reduce(list_prepend({start}::DOUBLE, list(x ORDER BY ts, seq)), lambda a, x: {step})"
ORACLES = {
    "kv_latest": "SELECT key, value FROM (SELECT 'k' || (user_id % 20) AS key, props AS value, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "attempts_by_status": f"SELECT url, status, event_id FROM ({_LOG}) WHERE status IN ('done', 'retry') ORDER BY ts DESC, event_id LIMIT 10",
    "url_latest_state": f"SELECT url, status, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS rn FROM ({_LOG})) WHERE rn = 1",
    "url_last_known": f"SELECT url, max_by(status, (ts, event_id)) AS status, max_by(k, (ts, event_id)) FILTER (WHERE k % 2 = 0) AS k FROM ({_LOG}) GROUP BY url",
    "url_upsert_preserve_done": f"""SELECT url, CASE WHEN n.status IS NULL THEN s.status WHEN s.status = 'done' AND (lower(url) NOT LIKE '%.pdf' OR (s.local_path IS NOT NULL AND s.sha256 IS NOT NULL)) THEN 'done' ELSE n.status END AS status,
        coalesce(s.discovered_at, n.discovered_at) AS discovered_at, local_path, sha256 FROM ({_EVEN}) s FULL JOIN ({_NEW}) n USING (url)""",
    "url_upsert_overwrite": f"SELECT url, coalesce(n.status, s.status) AS status, coalesce(n.discovered_at, s.discovered_at) AS discovered_at, local_path, sha256 FROM ({_EVEN}) s FULL JOIN ({_NEW}) n USING (url)",
    "url_upsert_repeated": f"""SELECT url, CASE WHEN n.status IS NULL THEN s.status WHEN s.status = 'done' AND (lower(url) NOT LIKE '%.pdf' OR (s.local_path IS NOT NULL AND s.sha256 IS NOT NULL)) THEN 'done' ELSE n.status END AS status,
        coalesce(s.discovered_at, n.discovered_at) AS discovered_at, local_path, sha256 FROM ({_EVEN}) s FULL JOIN (
        SELECT url, status, ts AS discovered_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, status DESC) AS rn FROM ({_LOG}) WHERE event_id % 2 = 1) WHERE rn = 1) n USING (url)""",
    "snapshot_diff_repeated": f"""SELECT * FROM (SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN a.status <> b.status OR a.k IS DISTINCT FROM b.k THEN 'changed' END AS change
        FROM ({_FETCHED.format(0)}) a FULL JOIN ({_FETCHED.format(1)}) b ON a.url = b.url) WHERE change IS NOT NULL""",
    "snapshot_last_diff": f"""SELECT * FROM (SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN a.k IS DISTINCT FROM b.k THEN 'changed' END AS change
        FROM (SELECT * FROM ({_TAKEN.format("event_id % 5 < 3")}) WHERE rn = 1 AND status <> 'abandoned') a FULL JOIN (SELECT * FROM ({_TAKEN.format("true")}) WHERE rn = 1 AND status <> 'abandoned') b ON a.url = b.url) WHERE change IS NOT NULL""",
    "request_headers": f"""SELECT url, CASE WHEN part = 0 AND length(url) % 2 = 0 THEN 'e' || k END AS if_none_match, CASE WHEN part = 0 AND length(url) % 3 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END AS if_modified_since,
        CASE WHEN part > 0 THEN 'bytes=' || part || '-' END AS range, CASE k % 5 WHEN 2 THEN 'unchanged' WHEN 3 THEN 'failed' WHEN 4 THEN 'failed' WHEN 1 THEN CASE WHEN part > 0 THEN 'continued' ELSE 'whole' END WHEN 0 THEN 'whole' END AS outcome,
        k::BIGINT + CASE WHEN k % 5 = 0 THEN 0 ELSE part END AS size FROM (SELECT *, (length(url) % 4)::BIGINT AS part FROM ({_TAKEN.format("true")}) WHERE rn = 1)""",
    "clear_pending": f"SELECT CASE WHEN status IN ('queued', 'retry', 'processing') THEN 'abandoned' ELSE status END AS status, count(*) AS n FROM ({_STATE}) GROUP BY 1",
    "review_latest": f"SELECT doc_id, label AS status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, seq DESC) AS rn FROM ({REVIEWS_SQL})) WHERE rn = 1 AND label <> 'new'",
    "pending_queue": f"SELECT url, status, discovered_at FROM ({_STATE}) WHERE status IN ('queued', 'retry') ORDER BY (lower(url) LIKE '%.pdf')::INT, discovered_at, url LIMIT 400",
    "diag_status_counts": f"SELECT status, count(*) AS n, sum((lower(url) LIKE '%.pdf')::INT)::BIGINT AS n_pdf FROM ({_LOG}) GROUP BY 1",
    "diag_done_detail": f"SELECT sum((status = 'done')::INT)::BIGINT AS done, sum((status = 'done' AND local_path IS NULL)::INT)::BIGINT AS done_no_path, sum((status = 'done' AND sha256 IS NULL)::INT)::BIGINT AS done_no_sha FROM ({_STATE})",
    "url_penalty_fold": f"SELECT host, round({_FOLD.format(start=0, step='greatest(0.0, least(0.6, a + x))')}, 6) AS penalty FROM (SELECT *, (CASE label WHEN 'irrelevant' THEN 0.05 WHEN 'high_value' THEN -0.03 ELSE 0 END)::DOUBLE AS x FROM ({REVIEWS_SQL})) GROUP BY host",
    "host_throttle_fold": f"SELECT host, round({_FOLD.format(start=1, step='greatest(0.2, least(1.0, a * x))')}, 6) AS rate FROM (SELECT user_id % 50 AS host, ts, event_id AS seq, (CASE WHEN event_type = 'error' THEN 0.5 ELSE 1.05 END)::DOUBLE AS x FROM events) GROUP BY host",
    "backoff_schedule": "SELECT r_regionkey::BIGINT AS attempt, round(least(30.0, 0.75 * pow(2, greatest(0, r_regionkey - 1)))::DOUBLE, 6) AS seconds FROM region",
    "release_diff": f"""SELECT * FROM (SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed'
        WHEN a.c_name IS DISTINCT FROM b.c_name OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.n IS DISTINCT FROM b.n THEN 'changed' END AS change FROM ({_BEFORE}) a FULL JOIN ({_AFTER}) b ON a.url = b.url) WHERE change IS NOT NULL""",
    "release_added_removed": f"SELECT url, 'added' AS change FROM (SELECT url FROM ({_AFTER}) EXCEPT SELECT url FROM ({_BEFORE})) UNION ALL SELECT url, 'removed' FROM (SELECT url FROM ({_BEFORE}) EXCEPT SELECT url FROM ({_AFTER}))",
    "merge_spans": """SELECT user_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM (SELECT user_id, event_id % 1000 AS a, event_id % 1000 + event_id % 37 + 1 AS b FROM events))) GROUP BY user_id, g""",
    "json_props": "SELECT event_type, sum((props->>'$.k')::INT)::BIGINT AS k, count(props->>'$.k') AS n FROM events GROUP BY 1",
    "stream_status_counts": f"SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, status, count(*) AS n FROM ({_LOG}) GROUP BY 1, 2",
}
