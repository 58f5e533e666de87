"""State kept as append-only logs and views of them: URLs, reviews, documents, snapshots, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusieve.functions.arrays import place_among
from corpusieve.runtime import written

PENDING = ("queued", "retry", "processing")
REVIEWS = ("new", "reviewed", "ignored", "irrelevant", "high_value")
#: Tables whose rows go with their document, and those that a reset of results empties.
DERIVED = ("fts_docs", "matches", "doc_tables", "doc_entities", "doc_embeddings", "doc_page_flags")
RESULTS = (*DERIVED, "documents", "doc_reviews")


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key. The rows themselves are compared inside the aggregate, so each
    task first keeps one for each key."""
    others = [c for c in log.columns if c not in (key, *order)]
    best = F.max(F.struct(*order, *others)).alias("_last")
    return log.groupBy(key).agg(best).select(key, *[F.col(f"_last.{c}").alias(c) for c in (*order, *others)])


def latest_known(log: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """For each key and column the last value that is not null."""
    place = F.struct(*order)
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def upsert_urls(state: DataFrame, incoming: DataFrame, preserve_done: bool = True) -> DataFrame:
    """url, status, discovered_at, local_path and sha256 after new discoveries.

    With ``preserve_done`` a URL that is done stays so, unless it is a PDF whose file or digest is
    missing, and keeps when it was discovered; otherwise what comes in wins. Of several incoming rows
    of a URL the last by discovered_at, then status, counts.
    """
    new = latest(incoming.select("url", "discovered_at", "status"), "url", "discovered_at", "status").select("url", F.col("status").alias("_status"), F.col("discovered_at").alias("_at"))
    both = state.join(new, "url", "full_outer")
    whole = ~F.lower("url").endswith(".pdf") | ((F.coalesce("local_path", F.lit("")) != "") & (F.coalesce("sha256", F.lit("")) != ""))
    if preserve_done:
        status = F.when(F.col("_status").isNull(), F.col("status")).when((F.col("status") == "done") & whole, "done").otherwise(F.col("_status"))
        at = F.coalesce("discovered_at", "_at")
    else:
        status, at = F.coalesce("_status", "status"), F.coalesce("_at", "discovered_at")
    return both.select("url", status.alias("status"), at.alias("discovered_at"), "local_path", "sha256")


def lookup(table: DataFrame, key: str, value: object, defaults: dict[str, object]) -> DataFrame:
    """One row: ``key`` and the columns of ``defaults`` of the row that has the key, the defaults where
    none has it or its column is null. Of several rows the least by these columns counts."""
    kind = dict(table.dtypes)
    found = table.where(F.col(key) == F.lit(value)).agg(F.min(F.struct(*defaults)).alias("_row"))
    return found.select(F.lit(value).cast(kind[key]).alias(key), *[F.coalesce(F.col(f"_row.{c}"), F.lit(v).cast(kind[c])).alias(c) for c, v in defaults.items()])


def clear_pending(state: DataFrame) -> DataFrame:
    return state.withColumn("status", F.when(F.col("status").isin(*PENDING), "abandoned").otherwise(F.col("status")))


def pending(state: DataFrame, is_document: Column, limit: int = 400) -> DataFrame:
    """What is fetched next: pages before documents, then the longest known; ties by URL."""
    return state.where(F.col("status").isin("queued", "retry")).orderBy(F.when(is_document, 1).otherwise(0), "discovered_at", "url").limit(limit)


def distinct_documents(docs: DataFrame, *order: str) -> DataFrame:
    """sha256 and the document that has it first, as doc_id."""
    return docs.groupBy("sha256").agg(F.min_by("doc_id", F.struct(*order)).alias("doc_id"), F.count("*").alias("copies"))


def update_storage(docs: DataFrame, moved: DataFrame) -> DataFrame:
    """local_path and sha256 replaced where ``moved``(doc_id, ...) has a value; of several rows of a
    document the greatest counts."""
    new = last_of_each(moved.select("doc_id", "local_path", "sha256"), "doc_id").select("doc_id", F.col("local_path").alias("_p"), F.col("sha256").alias("_s"))
    return docs.join(new, "doc_id", "left").withColumns({"local_path": F.coalesce("_p", "local_path"), "sha256": F.coalesce("_s", "sha256")}).drop("_p", "_s")


def update_paths(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """local_path replaced where the digest, without case and spaces, is in moved(sha256, path); of
    several paths of a digest the greatest counts."""
    new = last_of_each(moved.select(F.lower(F.trim("sha256")).alias("sha256"), F.col("path").alias("_p")), "sha256")
    return rows.join(new, "sha256", "left").withColumn("local_path", F.coalesce("_p", "local_path")).drop("_p")


def update_metrics(docs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Documents with the metric columns of ``metrics``(doc_id, ...) in place of their own; those that
    it has no row for keep theirs, null where they had none. Of several rows of a document the greatest by
    these columns, in their order, counts."""
    new = [c for c in metrics.columns if c != "doc_id"]
    given = last_of_each(metrics, "doc_id").select("doc_id", F.struct(*new).alias("_new"))
    own = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c) if c in docs.columns else F.lit(None)) for c in new}
    return docs.join(given, "doc_id", "left").withColumns(own).drop("_new")


def last_of_each(rows: DataFrame, *key: str) -> DataFrame:
    """One row for each key: the greatest by its other columns, in the order in which they stand."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*others)).alias("_last")).select(*[c if c in key else F.col(f"_last.{c}").alias(c) for c in rows.columns]) if others else rows.distinct()


def upsert(table: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """Rows of both; incoming ones replace those with their key. Of several incoming rows of a key
    one stays, the greatest by its other columns in their order."""
    new = last_of_each(incoming, *key)
    same = [table[k].eqNullSafe(new[k]) for k in key]
    return table.join(new.select(*key), same, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_entities(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities by document, label and canonical form: variants and pages sorted without repeats,
    a count of 0 or null is 1, rows without label or canonical form are left out."""
    clean = incoming.where("coalesce(label, '') <> '' and coalesce(canonical, '') <> ''").withColumns(
        {"variants": F.sort_array(F.array_distinct("variants")), "page_nos": F.sort_array(F.array_distinct("page_nos")), "count": F.when(F.coalesce("count", F.lit(0)) == 0, 1).otherwise(F.col("count"))}
    )
    return upsert(table, clean, "doc_id", "label", "canonical")


def upsert_embeddings(table: DataFrame, incoming: DataFrame) -> DataFrame:
    usable = incoming.where("vector is not null and coalesce(model_name, '') <> ''")
    return upsert(table, usable, "doc_id", "model_name", "chunk_index")


def valid_page_flags(flags: DataFrame) -> DataFrame:
    return flags.where("page_no > 0 and coalesce(flag, '') <> ''")


def reviews(log: DataFrame) -> DataFrame:
    """doc_id and status of each document's last review in log(doc_id, status, ts, seq); unknown
    ones count as new, and new is no review."""
    known = log.withColumn("status", F.when(F.col("status").isin(*REVIEWS), F.col("status")).otherwise("new"))
    return latest(known, "doc_id", "ts", "seq").where("status <> 'new'").select("doc_id", "status")


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Derived tables without the rows of documents in ``gone``(doc_id); reviews stay."""
    return {name: df.join(gone.select("doc_id"), "doc_id", "left_anti") if name in DERIVED else df for name, df in tables.items()}


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables, those of results emptied."""
    return {name: df.limit(0) if name in RESULTS else df for name, df in tables.items()}


COMPARED = ("sha256", "etag", "last_modified", "final_url", "content_type", "http_status")


def snapshot_diff(before: DataFrame, after: DataFrame, compared: tuple[str, ...] = COMPARED, key: str = "url", order: tuple[str, ...] = ()) -> DataFrame:
    """url and change (added, removed, changed) between two snapshots, nulls compared as values. Of
    several rows of a URL in one snapshot the last counts: by ``order``, then by the compared columns."""

    def own(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by(F.struct(*compared), F.struct(*order, *compared)).alias(name))

    a, b = own(before, "_a"), own(after, "_b")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def snapshot(state: DataFrame) -> DataFrame:
    """The rows of a URL table that a snapshot takes: all that are not abandoned."""
    return state.where(F.coalesce(F.col("status"), F.lit("")) != "abandoned").select("url", *COMPARED)


class Snapshots:
    """Snapshots of the URL table below ``root``, a folder for each, numbered; with each but the first
    the changes since the one before it. A folder without its last file was never finished and is not
    seen; taking a snapshot again after that goes on from the last whole one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Whole snapshots in order."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[9:]) for n in names if n.startswith("snapshot=") and self._fs.exists(self._path(f"{self.root}/{n}/changes/_SUCCESS")))

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshot={number}/urls")

    def take(self, state: DataFrame) -> int:
        """Stores what ``snapshot`` takes of ``state`` and how it differs from the last one."""
        done = self.numbers()
        number = done[-1] + 1 if done else 0
        at = f"{self.root}/snapshot={number}"
        snapshot(state).write.mode("overwrite").parquet(f"{at}/urls")
        now = self.read(number)
        before = self.read(done[-1]) if done else now.limit(0)
        snapshot_diff(before, now).write.mode("overwrite").parquet(f"{at}/changes")
        return number

    def last_diff(self) -> DataFrame | None:
        """url and change between the last two snapshots; None before there are two."""
        done = self.numbers()
        return self.spark.read.parquet(f"{self.root}/snapshot={done[-1]}/changes") if len(done) > 1 else None


def segmented(rows: DataFrame, by: str, name: str, segments: int | None = None) -> DataFrame:
    """``rows`` with the number of the range of ``by`` that each is in. Ranges are cut at quantiles, so
    no key has more rows in one of them than about a ``segments``-th of all, but for ties."""
    n = segments or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return rows.withColumn(name, F.lit(0))
    # quantiles depend on the order in which tasks end, so they are kept: wherever the rows are computed, ranges are the same
    cuts = written(rows.agg(F.percentile_approx(by, [k / n for k in range(1, n)], 100 * n).alias("_cuts")), "cuts")
    own = rows.join(F.broadcast(cuts), F.lit(True), "left")  # one row
    return own.withColumn(name, place_among(F.col("_cuts"), n - 1, F.col(by))).drop("_cuts")


def folded(log: DataFrame, key: str, order: list[str], value: str, name: str, low: float, high: float, start: float, scale: bool = False) -> DataFrame:
    """key and ``name``: where a walk ends that adds each value (``scale``: is multiplied by it), in
    order, and is held within bounds after each.

    A stretch of such a walk is itself one step with bounds of its own, whatever it starts from. So
    each key's rows are walked within ranges of the order first, side by side, and what they come to
    then: no task holds the whole log of a key.
    """
    move = (lambda a, x: a * x) if scale else (lambda a, x: a + x)
    none = F.lit(1.0) if scale else F.lit(0.0)
    # a longer way than from one bound to the other ends there too, so it is cut; no sum or product grows
    far = (high / low if low > 0 else float("inf")) if scale else high - low
    nearest, furthest = (1 / far if scale else -far), far

    def after(s: Column, by: Column, least: Column, most: Column) -> Column:
        held = lambda a: F.greatest(least, F.least(most, a))
        return F.struct(F.greatest(F.lit(nearest), F.least(F.lit(furthest), move(s["by"], by))).alias("by"), held(move(s["low"], by)).alias("low"), held(move(s["high"], by)).alias("high"))

    bounds, still = (F.lit(low), F.lit(high)), F.struct(none.alias("by"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    own = segmented(log.select(key, *order, F.col(value).cast("double").alias("_x")), order[0], "_range")
    steps = F.array_sort(F.collect_list(F.struct(*order, "_x")))
    parts = own.groupBy(key, "_range").agg(steps.alias("_steps")).select(key, "_range", F.aggregate("_steps", still, lambda s, x: after(s, x["_x"], *bounds)).alias("_part"))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("_range", "_part"))), still, lambda s, x: after(s, x["_part"]["by"], x["_part"]["low"], x["_part"]["high"]))
    end = parts.groupBy(key).agg(whole.alias("_all"))
    return end.select(key, F.greatest(F.col("_all.low"), F.least(F.col("_all.high"), move(F.lit(start), F.col("_all.by")))).alias(name))


def penalty_steps(label: Column) -> Column:
    """What a review does to its host's penalty (fixed values); it stays within 0 and 0.6."""
    return F.when(label == "irrelevant", 0.05).when(label == "high_value", -0.03).otherwise(0.0)


def throttle_factors(status: Column) -> Column:
    """What a response does to its host's rate (fixed values); it stays within 0.2 and 1."""
    return F.when(status.isin(429, 502, 503), 0.5).otherwise(1.05)


def backoff(attempt: Column, base: float = 0.75, most: float = 30.0) -> Column:
    """Seconds to wait before an attempt, doubled each time."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1).cast("double")))


def runs(spans: DataFrame, *by: str) -> DataFrame:
    """Overlapping or touching spans(a, b) of each group as one. A group is one task's."""
    order = Window.partitionBy(*by).orderBy("a", "b")
    seen = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(seen.isNull() | (F.col("a") > seen), 1).otherwise(0))
    group = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_g", group).groupBy(*by, "_g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_g")


def merged_spans(spans: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Overlapping or touching spans(key, a, b) of each key as one; those without a or b take no part.

    Spans are merged within ranges of a first, side by side, and joined at the seams then: what begins in a
    range within the reach of the ranges before it goes on with what was open there. So a key's spans lie in
    as many tasks as there are ranges, and what meets by key is a row for each range.
    """
    own = segmented(spans.select(key, "a", "b").where("a is not null and b is not null"), "a", "_range", ranges)
    parts = runs(own, key, "_range")
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reach = parts.groupBy(key, "_range").agg(F.max("b").alias("_b")).select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.max("_b").over(earlier).alias("_reach"))
    met = parts.join(reach, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at"))).drop("_key", "_at")
    begins = F.col("_reach").isNull() | (F.col("a") > F.col("_reach"))
    fresh = met.where(begins).select(key, F.col("a").alias("_start"), "b")
    # of each range: the last that begins in it, and how far those go that began before it
    seams = met.groupBy(key, "_range").agg(F.max(F.when(begins, F.col("a"))).alias("_open"), F.max(F.when(~begins, F.col("b"))).alias("_b"))
    carried = seams.select(key, F.last("_open", ignorenulls=True).over(earlier).alias("_start"), F.col("_b").alias("b")).where("b is not null")
    return fresh.unionByName(carried).groupBy(key, "_start").agg(F.max("b").alias("b")).select(key, F.col("_start").alias("a"), "b")
