"""Full-text search: a postings table, BM25, substring fallback and rank scores."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusieve.functions.arrays import once
from corpusieve.functions.text import first_line, search_terms
from corpusieve.operators.state import last_of_each
from corpusieve.operators.versions import Versions
from corpusieve.plans.fts import Phrase, Query, QueryError, parse
from corpusieve.runtime import discard, written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("title", "content")


#: Dead documents that are broadcast at most; segments of like size that are merged, and how much larger a
#: segment of the next tier is.
FEW_DEAD, RUN, FAN = 100_000, 4, 4
#: Documents of a segment that share a block of postings, on average.
BLOCK = 128


@dataclass
class Index:
    """``postings``(term, field, doc_id, tf, positions, length) and ``lengths``(doc_id, length). One that was
    opened also knows how many documents there are, their length together, which rows are dead, and for each
    block of postings of a term what its documents can score at most (``blocks``)."""

    postings: DataFrame
    lengths: DataFrame
    documents: int | None = None
    length: int | None = None
    dead: DataFrame | None = None
    few_dead: bool = True
    blocks: DataFrame | None = None
    alive: dict[str, float] = field(default_factory=dict)  # share of live documents, of segments that have dead

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` of documents that were neither changed nor removed since."""
        if self.dead is None:
            return rows
        return rows.join(F.broadcast(self.dead) if self.few_dead else self.dead, ["segment", "doc_id"], "left_anti")

    def write(self, root: str) -> None:
        """Adds both below ``root`` as a segment."""
        Store(self.postings.sparkSession, root).add(self.postings, self.lengths)

    @staticmethod
    def segments(spark: SparkSession, root: str) -> list[str]:
        """Names of the segments of the newest version."""
        return [s["name"] for s in Store(spark, root).now["segments"]]

    @staticmethod
    def open(spark: SparkSession, root: str) -> Index:
        return Store(spark, root).index()

    @staticmethod
    def append(docs: DataFrame, root: str) -> bool:
        """Indexes those of docs(doc_id, title, content) that are new or changed; False if none is."""
        return Store(docs.sparkSession, root).upsert(docs)


class Store:
    """An index in segments that are never rewritten, and the versions that name them.

    A segment has postings in order of their terms, so that a query reads few row groups. A document that
    changes or goes is dead in its old segment: (segment, doc_id) is noted, and queries leave it out. Merging
    makes one segment of several of like size, without their dead. Each step makes one version, so who reads
    sees all of it or nothing; files of a step that failed are in no version. A step that another writer
    was ahead of raises ``Conflict`` and is to be made again.
    """

    def __init__(self, spark: SparkSession, root: str, block: int = BLOCK) -> None:
        self.spark, self.root, self.versions, self.block = spark, root.rstrip("/"), Versions(spark, root), block
        self.number = self.versions.newest()
        self.now: dict = self.versions.read(self.number) if self.number else {"segments": [], "dead": []}

    def _commit(self, segments: list[dict], dead: list[dict]) -> None:
        self.versions.put(self.number + 1, {"segments": segments, "dead": dead})
        self.number, self.now = self.number + 1, {"segments": segments, "dead": dead}

    def index(self) -> Index:
        if not self.now["segments"]:
            raise ValueError(f"there is no index below {self.root}")
        dead, alive = self.now["dead"], {}
        for s in self.now["segments"]:
            if gone := sum(d["of"].get(s["name"], 0) for d in dead):
                alive[s["name"]] = 1 - gone / s["documents"]
        every = [s["name"] for s in self.now["segments"]]
        names = [n for n in every if alive.get(n, 1)] or every
        total = lambda k: sum(s[k] for s in self.now["segments"]) - sum(d[k] for d in dead)
        own = self._dead() if dead else None
        postings, lengths, blocks = (self.spark.read.parquet(*[f"{self.root}/{n}/{part}" for n in names]) for part in ("postings", "lengths", "blocks"))
        out = Index(postings, lengths, total("documents"), total("length"), own, sum(d["documents"] for d in dead) <= FEW_DEAD, blocks, alive)
        out.lengths = out.live(out.lengths)
        return out

    def _dead(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{d['name']}" for d in self.now["dead"]]).select("segment", "doc_id")

    def _segment(self, postings: DataFrame, lengths: DataFrame) -> dict:
        """Writes a segment that no version names yet; its entry."""
        name = f"segment={uuid.uuid4().hex}"
        at, own = f"{self.root}/{name}", F.lit(name).alias("segment")
        digest = [] if "digest" in lengths.columns else [F.lit(None).cast("string").alias("digest")]
        lengths.select("doc_id", "length", *(["digest"] if not digest else digest), own).write.parquet(f"{at}/lengths")
        sums = self._sums(f"{at}/lengths")
        block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, sums["documents"] // self.block))).alias("block")
        placed = postings.select("term", "field", "doc_id", "tf", "positions", "length", block, own)
        placed.repartitionByRange("term", "block").sortWithinPartitions("term", "block", "doc_id").write.parquet(f"{at}/postings")
        _bounds(self.spark.read.parquet(f"{at}/postings")).write.parquet(f"{at}/blocks")
        return {"name": name, **sums}

    def _sums(self, path: str) -> dict:
        row = self.spark.read.parquet(path).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"documents": row[0], "length": row[1]}

    def _bury(self, rows: DataFrame) -> dict | None:
        """Notes rows(segment, doc_id, length) as dead; the entry of that, None if there are none."""
        name = f"dead={uuid.uuid4().hex}"
        rows.select("segment", "doc_id", "length").write.parquet(f"{self.root}/{name}")
        sums = self._sums(f"{self.root}/{name}")
        if not sums["documents"]:
            self.versions.delete(name)
            return None
        of = {r[0]: r[1] for r in self.spark.read.parquet(f"{self.root}/{name}").groupBy("segment").count().collect()}  # as many as there are segments
        return {"name": name, **sums, "of": of}

    def add(self, postings: DataFrame, lengths: DataFrame) -> None:
        """A segment of documents that no other has."""
        self._commit([*self.now["segments"], self._segment(postings, lengths)], self.now["dead"])

    def upsert(self, docs: DataFrame) -> bool:
        """Indexes docs(doc_id, title, content), in place of what documents of these ids had before; those
        that did not change are left as they are. False if nothing is new. Rows without doc_id are left out; of
        rows that share one the greatest by title and content counts. Texts are cut into words once."""
        own = last_of_each(docs.where("doc_id is not null").select("doc_id", "title", "content"), "doc_id")
        digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(f, F.lit("")) for f in FIELDS]), 256)
        own = own.withColumn("digest", digest)
        if self.now["segments"]:
            before = self.index().lengths
            own = own.join(before.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
        terms = written(_terms(own, "digest"), "search-terms")
        lengths = _lengths(terms, "digest")
        if lengths.isEmpty():
            discard(terms)
            return False
        gone = self._bury(before.join(lengths.select("doc_id"), "doc_id", "left_semi")) if self.now["segments"] else None
        entry = self._segment(_postings(terms), lengths)
        discard(terms)
        self._commit([*self.now["segments"], entry], [*self.now["dead"], *([gone] if gone else [])])
        return True

    def remove(self, gone: DataFrame) -> int:
        """Takes the documents in gone(doc_id) out; returns how many there were."""
        entry = self._bury(self.index().lengths.join(gone.select("doc_id"), "doc_id", "left_semi"))
        if entry:
            self._commit(self.now["segments"], [*self.now["dead"], entry])
        return entry["documents"] if entry else 0

    def plan(self) -> list[list[dict]]:
        """Segments to merge: all of a tier that has RUN of them."""
        tiers: dict[int, list[dict]] = {}
        for s in self.now["segments"]:
            tiers.setdefault(math.ceil(math.log(max(s["documents"], 1), FAN)), []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= RUN]

    def merge(self, everything: bool = False) -> int:
        """Merges tiers that have enough segments (``everything``: all segments, so that no dead are left);
        returns how many segments there are. Postings are read, not texts."""
        while runs := ([self.now["segments"]] if everything and (len(self.now["segments"]) > 1 or self.now["dead"]) else [] if everything else self.plan()):
            names = [s["name"] for s in runs[0]]
            whole = self.index()
            of = lambda part: whole.live(self.spark.read.parquet(*[f"{self.root}/{n}/{part}" for n in names]))
            entry = self._segment(of("postings").drop("segment"), of("lengths").drop("segment"))
            rest = None
            if self.now["dead"]:
                dead = self.spark.read.parquet(*[f"{self.root}/{d['name']}" for d in self.now["dead"]])
                rest = self._bury(dead.where(~F.col("segment").isin(names)))
            self._commit([*(s for s in self.now["segments"] if s["name"] not in names), entry], [rest] if rest else [])
        return len(self.now["segments"])

    def vacuum(self) -> int:
        """Deletes the folders that the newest version does not name; returns how many. No one may write or
        read an older version meanwhile."""
        named = {x["name"] for x in (*self.now["segments"], *self.now["dead"])}
        gone = [n for n in (*self.versions.folders("segment="), *self.versions.folders("dead=")) if n not in named]
        for name in gone:
            self.versions.delete(name)
        return len(gone)


def with_title(docs: DataFrame) -> DataFrame:
    """doc_id, title (the first line) and content of documents."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", first_line(text).alias("title"), text.alias("content"))


def _terms(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", *more, *[search_terms(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS])


def _lengths(terms: DataFrame, *more: str) -> DataFrame:
    return terms.select("doc_id", (F.size("title") + F.size("content")).cast("long").alias("length"), *more)


def _postings(terms: DataFrame) -> DataFrame:
    """A row for each term of a field of a document. All words of a text are in one row, so they are grouped
    there, batch by batch; nothing is shuffled."""
    kind = terms.schema["doc_id"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = sum(batch.column(f).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in FIELDS)
            for field in FIELDS:
                lists = batch.column(field)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                if not len(flat):
                    continue
                words = flat.dictionary_encode()
                code, row = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
                position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                order = np.lexsort((code, row))  # stable, so places stay in order
                code, row, position = code[order], row[order], position[order]
                begin = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
                cuts = np.append(begin, len(row))
                places = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(position.astype(np.int32)))
                out = [words.dictionary.take(pa.array(code[begin])), pa.array([field] * len(begin)), batch.column("doc_id").take(pa.array(row[begin])), pa.array(np.diff(cuts)), places, pa.array(whole[row[begin]])]
                yield pa.RecordBatch.from_arrays(out, ["term", "field", "doc_id", "tf", "positions", "length"])

    return terms.select("doc_id", *FIELDS).mapInArrow(task, f"term string, field string, doc_id {kind.simpleString()}, tf long, positions array<int>, length long")


def _bounds(postings: DataFrame) -> DataFrame:
    """For each block of a term and each field: the greatest tf, the greatest share of a document's words, and
    how many documents have the term there (<field>_n) and at all (n). BM25 rises with tf and share, whatever the
    mean length will be. A term in a block has a few hundred rows."""
    of = lambda f, x: F.when(F.col("field") == f, x)
    most = lambda f, x: F.coalesce(F.max(of(f, x)), F.lit(0))
    own = [part for f in FIELDS for part in (most(f, F.col("tf")).alias(f"{f}_tf"), most(f, F.col("tf") / F.col("length")).alias(f"{f}_share"), F.count(of(f, F.lit(1))).alias(f"{f}_n"))]
    ranged = postings.select("segment", "term", "block", "field", "doc_id", "tf", "length").repartitionByRange("term", "block")
    return ranged.groupBy("term", "block", "segment").agg(*own, F.size(F.collect_set("doc_id")).cast("long").alias("n")).sortWithinPartitions("term", "block")


def build_index(docs: DataFrame) -> Index:
    """Postings and lengths of docs(doc_id, title, content), a row for each doc_id."""
    terms = _terms(docs)
    return Index(_postings(terms), _lengths(terms))


def _wanted(p: Phrase, word: str, last: bool) -> Column:
    hit = F.col("term").startswith(word) if p.prefix and last else F.col("term") == word
    return hit & (F.col("field") == p.field) if p.field else hit


def _starts(columns: list[str]) -> Column:
    """(field, place) where the words of a phrase follow each other, from their place arrays."""

    def followed(here: Column, name: str, by: int) -> Column:
        return F.filter(here, lambda x: F.array_contains(F.col(name), F.struct(x["field"].alias("field"), (x["position"] + by).alias("position"))))

    here = F.col(columns[0])
    for by, name in enumerate(columns[1:], 1):
        here = followed(here, name, by)
    return here


def _phrases(tree: Query) -> list[Phrase]:
    own = list(tree.phrases)
    for part in tree.parts:
        own += _phrases(part)
    return list(dict.fromkeys(own))


_PLACES = "array<struct<field:string,position:int>>"


def _from_index(index: Index, phrases: list[Phrase], within: DataFrame | None = None) -> DataFrame:
    """doc_id, length and for the i-th phrase p<i>, the places where it begins, of documents with any
    of their words (``within``: in these blocks only). Only postings of these words are read; they meet by
    document once."""
    names, wanted = {}, F.lit(False)
    for i, p in enumerate(phrases):
        for k, word in enumerate(p.words):
            names[i, k] = f"w{i}_{k}"
            wanted = wanted | _wanted(p, word, k == len(p.words) - 1)
    places = F.transform("positions", lambda x: F.struct(F.col("field").alias("field"), x.alias("position")))
    gathered = [F.flatten(F.collect_list(F.when(_wanted(phrases[i], phrases[i].words[k], k == len(phrases[i].words) - 1), places))).alias(name) for (i, k), name in names.items()]
    rows = index.postings.where(wanted)
    rows = rows.join(within.select("segment", "block"), ["segment", "block"], "left_semi") if within is not None else rows
    docs = index.live(rows).groupBy("doc_id").agg(F.max("length").alias("length"), *gathered)
    starts = [(_starts([names[i, k] for k in range(len(p.words))]) if p.words else F.array().cast(_PLACES)).alias(f"p{i}") for i, p in enumerate(phrases)]
    return docs.select("doc_id", "length", *starts)


def _from_texts(docs: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """The same of docs(doc_id, title, content) without an index, for every document: each is cut
    into words once, nothing is exploded or shuffled."""

    def begins(words: Column, p: Phrase, at: Column) -> Column:
        ok = F.lit(True)
        for k, word in enumerate(p.words):
            here = F.get(words, at + k)
            ok = ok & (here.startswith(word) if p.prefix and k == len(p.words) - 1 else here == word)
        return F.coalesce(ok, F.lit(False))

    def places(words: Column, p: Phrase, field: str) -> Column:
        every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(every, lambda at: begins(words, p, at)), lambda at: F.struct(F.lit(field).alias("field"), at.alias("position")))

    def of(both: Column) -> Column:
        found = []
        for i, p in enumerate(phrases):
            own = [places(both[field], p, field) for field in FIELDS if p.words and p.field in (None, field)]
            found.append((F.concat(*own) if own else F.array().cast(_PLACES)).alias(f"p{i}"))
        return F.struct((F.size(both["title"]) + F.size(both["content"])).cast("long").alias("length"), *found)

    words = F.struct(*[search_terms(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS])
    return docs.select("doc_id", once(words, of).alias("_f")).select("doc_id", "_f.*")


def _holds(q: Query, number: dict[Phrase, int]) -> Column:
    """Whether a document with the places p<i> of the phrases is found."""
    if q.kind == "phrase":
        return F.size(f"p{number[q.phrases[0]]}") > 0
    if q.kind == "near":
        size = len(q.phrases[0].words)

        def beside(x: Column, p: Phrase) -> Column:
            return F.exists(f"p{number[p]}", lambda y: (y["field"] == x["field"]) & (y["position"] - x["position"] - size <= q.distance) & (x["position"] - y["position"] - len(p.words) <= q.distance))

        def close(x: Column) -> Column:
            ok = F.lit(True)
            for p in q.phrases[1:]:
                ok = ok & beside(x, p)
            return ok

        return F.exists(f"p{number[q.phrases[0]]}", close)
    a, b = (_holds(p, number) for p in q.parts)
    return {"and": a & b, "or": a | b, "not": a & ~b}[q.kind]


def _score(tfs: dict[int, Column], lengths: dict[int, Column], d: dict[int, Column], n: Column, mean_length: Column) -> Column:
    """BM25, the less the better, from tf, length and number of documents by phrase. It falls with tf and rises
    with length."""
    score = F.lit(0.0)
    for i, tf in tfs.items():
        idf = F.greatest(F.log((n - d[i] + 0.5) / (d[i] + 0.5)), F.lit(LEAST_IDF))
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean_length))
    return score


@dataclass
class Bounded:
    """A query for whose words the index has bounds: ``blocks``(segment, block, bound, hope), where ``bound``
    is the best score that a document in there can have and ``hope`` a guess of how many come near it."""

    index: Index
    tree: Query
    phrases: list[Phrase]
    blocks: DataFrame
    frequencies: dict[int, Column]

    @staticmethod
    def of(index: Index, tree: Query) -> Bounded | None:
        """None for queries with phrases of several words or beginnings of words: in how many documents those
        are, only their places tell."""
        phrases = _phrases(tree)
        if index.blocks is None or not index.documents or any(len(p.words) != 1 or p.prefix for p in phrases):
            return None
        number = {p: i for i, p in enumerate(phrases)}
        rows = index.blocks.where(F.col("term").isin(sorted({p.words[0] for p in phrases})))
        most = lambda p, of: F.col(f"{p.field}_{of}") if p.field else F.col(f"title_{of}") + F.col(f"content_{of}")
        many = lambda p: F.col(f"{p.field}_n" if p.field else "n")
        mine = lambda p, x: F.when(F.col("term") == p.words[0], x)
        d = rows.agg(*[F.coalesce(F.sum(mine(p, many(p))), F.lit(0)) for p in phrases]).first()
        if index.dead is not None:  # who are dead are counted in blocks still
            wanted = [_wanted(p, p.words[0], True) for p in phrases]
            found = index.postings.where(F.col("term").isin(sorted({p.words[0] for p in phrases})))
            gone = found.join(index.dead, ["segment", "doc_id"], "left_semi").groupBy("segment", "doc_id").agg(*[F.max(w.cast("long")).alias(f"g{i}") for i, w in enumerate(wanted)])
            d = [x - y for x, y in zip(d, gone.agg(*[F.coalesce(F.sum(f"g{i}"), F.lit(0)) for i in range(len(phrases))]).first(), strict=True)]
        greatest = lambda p, x: F.coalesce(F.max(mine(p, x)), F.lit(0))
        parts = [x for p, i in number.items() for x in (greatest(p, most(p, "tf")).alias(f"t{i}"), greatest(p, most(p, "share")).alias(f"s{i}"), greatest(p, many(p)).alias(f"c{i}"))]
        frequencies = {i: F.lit(d[i]) for i in range(len(phrases))}

        def hope(q: Query) -> Column:
            if q.kind in ("phrase", "near"):
                own = [F.when(F.col(f"t{number[p]}") > 0, F.col(f"c{number[p]}")).otherwise(0) for p in q.phrases]
                return F.least(*own) if len(own) > 1 else own[0]
            a, b = (hope(p) for p in q.parts)
            either = F.when((a > 0) & (b > 0), F.least(a, b)).otherwise(F.greatest(a, b))  # the rarer word makes the bound
            return {"and": F.least(a, b), "or": either, "not": a}[q.kind]

        leaves = {number[p] for p in tree.leaves()}
        bound = _score({i: F.col(f"t{i}") for i in sorted(leaves)}, {i: F.when(F.col(f"s{i}") > 0, F.col(f"t{i}") / F.col(f"s{i}")).otherwise(0) for i in leaves}, frequencies, *_means(index))
        alive = F.lit(1.0)
        for name, share in index.alive.items():
            alive = F.when(F.col("segment") == name, share).otherwise(alive)
        blocks = rows.groupBy("segment", "block").agg(*parts).where(hope(tree) > 0).select("segment", "block", bound.alias("bound"), (hope(tree) * alive).alias("hope"))
        return Bounded(index, tree, phrases, blocks, frequencies)

    def scored(self, within: DataFrame) -> DataFrame:
        """doc_id and bm25 of what is found in these blocks."""
        number = {p: i for i, p in enumerate(self.phrases)}
        leaves = sorted({number[p] for p in self.tree.leaves()})
        docs = _from_index(self.index, self.phrases, within).where(_holds(self.tree, number))
        score = _score({i: F.size(f"p{i}") for i in leaves}, {i: F.col("length") for i in leaves}, self.frequencies, *_means(self.index))
        return docs.select("doc_id", score.alias("bm25"))

    def survivors(self, limit: int) -> DataFrame:
        """The blocks that can hold one of the best ``limit`` documents. Those of the best bounds are read
        first, about as many as hold twice so many documents; what is not better than the last of the best in
        them can't be among the best of all. Where too few are found, since the best blocks are of dead or the
        words don't meet, more are read, and after that all."""
        order = ("bound", "segment", "block")
        before = F.coalesce(F.sum("hope").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        for wanted in (2 * limit, 16 * limit, 128 * limit):
            first = self.blocks.orderBy(*order).limit(wanted)  # which bounds the window
            seeds = first.withColumn("_before", before).where(F.col("_before") < wanted)
            n, last = self.scored(seeds).orderBy("bm25", "doc_id").limit(limit).agg(F.count("*"), F.max("bm25")).first()
            if n >= limit:
                return self.blocks.where(F.col("bound") <= last + 1e-9 * (1 + abs(last)))
        return self.blocks


def _means(index: Index) -> tuple[Column, Column]:
    """Number of documents and their mean length, of an index that was opened."""
    return F.lit(index.documents), F.lit(index.length / max(index.documents, 1))


def search(source: Index | DataFrame, query: str, limit: int = 250) -> DataFrame:
    """doc_id and bm25 (the less the better) of the best ``limit`` documents, ties by doc_id.

    ``source`` is an index, or docs(doc_id, title, content), of which lengths and places are then
    written to the shared folder, so that texts are read once. An index that was opened shows by its bounds
    which blocks of postings can't have any of the best: these are left out before anything is shuffled.
    Raises QueryError for what is no query.
    """
    tree = parse(query)
    phrases = _phrases(tree)
    if isinstance(source, Index):
        if limit < 1 or not any(p.words for p in phrases):
            return source.lengths.select("doc_id", F.lit(0.0).alias("bm25")).limit(0)
        if bounded := Bounded.of(source, tree):
            return bounded.scored(bounded.survivors(limit)).orderBy("bm25", "doc_id").limit(limit)
        docs, lengths = _from_index(source, phrases), source.lengths
    else:
        docs = lengths = written(_from_texts(source, phrases), "search-places")
    number = {p: i for i, p in enumerate(phrases)}
    scored = list(dict.fromkeys(tree.leaves()))
    frequencies = docs.agg(*[F.sum((F.size(f"p{number[p]}") > 0).cast("long")).alias(f"d{number[p]}") for p in scored])
    found = docs.where(_holds(tree, number))
    if isinstance(source, Index) and source.documents is not None:
        n, mean_length = _means(source)
        whole = found.withColumns({"n": n, "mean_length": mean_length})
    else:
        corpus = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
        whole = found.join(F.broadcast(corpus), F.lit(True), "inner")  # one row
    own = whole.join(F.broadcast(frequencies), F.lit(True), "inner")  # one row
    every = [number[p] for p in scored]
    score = _score({i: F.size(f"p{i}") for i in every}, {i: F.col("length") for i in every}, {i: F.col(f"d{i}") for i in every}, F.col("n"), F.col("mean_length"))
    return own.select("doc_id", score.alias("bm25")).orderBy("bm25", "doc_id").limit(limit)


def like_search(docs: DataFrame, query: str, limit: int = 250, literal: bool = False) -> DataFrame:
    """doc_id and bm25 = 0 of documents whose title or content has the query as a substring, of
    either case; % and _ in it are wildcards unless ``literal``. In order of doc_id."""
    body = query.replace("\\", "\\\\")
    if literal:
        body = body.replace("%", "\\%").replace("_", "\\_")
    found = docs.where(F.col("title").ilike(f"%{body}%") | F.col("content").ilike(f"%{body}%"))
    return found.select("doc_id", F.lit(0.0).alias("bm25")).orderBy("doc_id").limit(limit)


def find(docs: DataFrame, query: str, limit: int = 250, mode: str = "ranked", index: Index | None = None) -> DataFrame:
    """Ranked search, or a substring search in ``mode`` like and for what is no query."""
    if not query.strip():
        return docs.select("doc_id", F.lit(0.0).alias("bm25")).limit(0)
    if mode == "ranked":
        try:
            return search(index or docs, query, limit)
        except QueryError:
            pass
    return like_search(docs, query, limit)


def rank_scores(found: DataFrame) -> DataFrame:
    """``found`` (a bounded list of candidates) with keyword_rank: 1 for the first, falling
    linearly."""
    place = F.row_number().over(Window.orderBy("bm25", "doc_id"))
    n = F.count("*").over(Window.partitionBy())
    return found.withColumn("keyword_rank", (n - place + 1) / n)
