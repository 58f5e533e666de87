"""Operator 6: n-gram Jaccard join by chosen paths.

A document is the set of its word shingles. In each run, a set chooses about 1/threshold of its
shingles by a hash that all sets share; each chosen one is a path, and sets that share a path share
a bucket. Buckets that are still large are split again on further shingles, chosen in the same
way. Two sets of at least the threshold's similarity stay together through all splits of one run with
a known probability, and runs are repeated until the target recall is reached. Buckets are searched by
brute force, with 128 one-bit MinHash values for each set.

A bucket tells which sets are connected, not all pairs of them: it gives a spanning star of each
group of likely partners. Sets that are connected so, by any bucket, are then compared exactly with
one another, each pair once, in blocks; so a pair is found wherever other pairs connect it too.
Partners are counted where they are compared: the pairs themselves are never rows.

Equal sets are one class from the start and are counted by weight. Most paths belong to one set
alone; a bitmap of those that two sets share drops all other rows where they are read, so that only
the rest is shuffled with what is needed for comparisons.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.llm.components import components
from corpusieve.llm.shingles import SIMILARITY, WORDS, OnePermutation, Shingler, mixed, odd_numbers
from corpusieve.llm.words import forget
from corpusieve.runtime import bound_batches, discard, table, written

RECALL = 0.99
DEPTH = 3
#: A bucket of more sets is split further, down to DEPTH.
SMALL = 32
#: Sets, and shingles in all, of a block; larger groups are compared block by block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
SKETCH = 128
#: Size of the bitmap that screens texts: 8 MB.
FILTER_BITS = 1 << 26


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair just at the threshold was kept together at ``depth`` at least once
    with probability ``recall``: it shares a Poisson number of chosen shingles, 1 on average."""
    stays = 1.0
    for _ in range(depth):
        stays = 1 - math.exp(-stays)
    return math.ceil(math.log(1 - recall) / math.log(1 - stays))


def furthest(threshold: float = SIMILARITY) -> np.ndarray:
    """For each set size up to SKETCH, how many of the one-bit values may differ: what is expected
    at the threshold and 4.5 standard deviations, for as many independent values as the set has."""
    share = (1 - threshold) / 2
    sizes = np.maximum(np.arange(SKETCH + 1), 1)
    return np.floor(SKETCH * (share + 4.5 * np.sqrt(share * (1 - share) / sizes))).astype(np.int64)


class Signer:
    """text -> what is needed of it to find its partners."""

    def __init__(self, words: int, threshold: float, runs: int) -> None:
        self.shingler, self.bins, self.threshold = Shingler(words), OnePermutation(SKETCH), threshold
        self.first = odd_numbers(1, runs)

    def shingles(self, text: str | None) -> np.ndarray:
        return np.unique(self.shingler(text))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((self.bins(x) & np.uint64(1)).astype(np.uint8)).view("<i8") if len(x) else np.zeros(2, "<i8")

    def chosen(self, x: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each factor the shingles that it chooses: (hash of both, number of the factor)."""
        most = min(float(1 << 64), (1 << 64) / (self.threshold * max(len(x), 1)))
        limit = np.uint64(min(int(most), (1 << 64) - 1))
        paths, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k in range(0, len(x), 1 << 15):
            part = x[k : k + (1 << 15)]
            row, factor = np.nonzero(part[:, None] * factors[None, :] <= limit)
            paths.append(mixed(part[row] ^ mixed(factors[factor])))
            of.append(factor)
        return np.concatenate(paths), np.concatenate(of)

    def paths(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(path, path before it) for each level; the first has no path before it."""
        path, _ = self.chosen(x, self.first)
        out = [(path, np.zeros(0, np.uint64))]
        for _ in range(DEPTH - 1):
            further, of = self.chosen(x, mixed(path) | np.uint64(1))
            out.append((further, path[of]))
            path = further
        return out


def key_of(x: np.ndarray) -> bytes:
    """16 bytes that stand for a set, equal for equal sets."""
    return xxhash.xxh3_128_digest(x.tobytes())


_LEVELS = ", ".join(f"path{k} array<long>, before{k} array<long>" for k in range(1, DEPTH + 1))


def _signed(docs: DataFrame, words: int, threshold: float, runs: int) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        signer = Signer(words, threshold, runs)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                x = signer.shingles(text)
                a, b = signer.sketch(x)
                rows.append((key_of(x), len(x), a, b, *(p.view(np.int64) for pair in signer.paths(x) for p in pair)))
            names = ["node", "n", "bits1", "bits2", *(x.split()[0] for x in _LEVELS.split(", "))]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "text_hash", batch["text_hash"].to_numpy())
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.mapInPandas(task, f"doc_id long, text_hash long, node binary, n int, bits1 long, bits2 long, {_LEVELS}")


def _paths(signed: DataFrame, level: int) -> DataFrame:
    """node, n, bits1, bits2, path and before (none at the first level) of all rows with words."""
    arrays = [F.col(f"path{level}").alias("path"), *([F.col(f"before{level}").alias("before")] if level > 1 else [])]
    return signed.where("n > 0").select("node", "n", "bits1", "bits2", F.inline(F.arrays_zip(*arrays)))


def _shared(rows: DataFrame) -> DataFrame:
    """path of those that two sets have. Sets are told apart by 32 bits of their keys, which miss one
    pair in four thousand million; what is shuffled is a path and two numbers."""
    tag = F.hash("node")
    return rows.select("path", tag.alias("tag")).groupBy("path").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a <> b").select("path")


def _buckets(signed: DataFrame, small: int) -> tuple[DataFrame, list[DataFrame]]:
    """path, size and node, n, bits1, bits2 of every bucket that needs no further split, and the
    tables that they are read from."""
    kept, made, large = [], [], None
    for level in range(1, DEPTH + 1):
        rows = _paths(signed, level)
        if large is None:
            rows = _perhaps_among(rows, "path", _shared(rows)).withColumn("before_size", F.lit(None).cast("long"))
        else:
            split = large.select(F.col("path").alias("before"), F.col("size").alias("before_size"))
            rows = _perhaps_among(rows, "before", split).join(split, "before")
        once = rows.groupBy("path", "node").agg(*[F.min(c).alias(c) for c in ("n", "bits1", "bits2", "before_size")])
        once = written(once, f"op6-paths{level}")
        sizes = once.groupBy("path").agg(F.count("*").alias("size"), F.max("before_size").alias("before_size")).where("size > 1")
        # a split that leaves most of a bucket together parts near copies, and would go on so
        whole = (F.col("size") <= small) | F.coalesce(2 * F.col("size") >= F.col("before_size"), F.lit(False)) | F.lit(level == DEPTH)
        sizes = written(sizes.withColumn("whole", whole), f"op6-sizes{level}")
        made += [once, sizes]
        kept.append(once.drop("before_size").join(sizes.where("whole").select("path", "size"), "path"))
        large = sizes.where("not whole")
        if level < DEPTH and large.isEmpty():
            break
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out, made


def _in_blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks (i <= j) of its group that its own block is in.
    ``blocks`` is SQL for the number of blocks of the group."""
    own = rows.withColumn("blocks", F.expr(blocks).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(node, 17L), blocks) as int)"))
    pairs = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return pairs.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of sorted rows in which every group is whole."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        new = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        last = int(new[-1]) if len(new) else 0
        if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held)
            held = []
        if last:
            yield pd.concat([*held, batch.iloc[:last]])
            held = []
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the least item that edges (a, b) connect it with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            break
    return label


def likely_pairs(group: np.ndarray, n: np.ndarray, bits: np.ndarray, block: np.ndarray, cross: np.ndarray, threshold: float, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs in a group that may be similar. Rows of a group are adjacent; where
    ``cross`` is set only pairs of different blocks are wanted."""
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        near = (low >= threshold * high) & (np.bitwise_count(bits[a] ^ bits[b]).sum(1) <= most[np.minimum(low, SKETCH)]) & ~(cross[a] & (block[a] == block[b]))
        first.append(a[near])
        second.append(b[near])

    starts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
    sizes = np.diff(starts)
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, min(SMALL, len(group))):
        a = np.flatnonzero(small[:-d] & (group[d:] == group[:-d]))
        if not len(a):
            break
        keep(a, a + d)
    for k in np.flatnonzero(sizes > SMALL):
        own = np.arange(starts[k], starts[k + 1])
        for x in own[:-1]:
            rest = np.arange(x + 1, starts[k + 1])
            keep(np.full(len(rest), x), rest)
    return np.concatenate(first), np.concatenate(second)


def _connected(buckets: DataFrame, threshold: float) -> DataFrame:
    """a, b: for each group of likely partners in a bucket, an edge from each to one of them."""
    most = furthest(threshold)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _grouped(batches, ["path", "i", "j"]):
            path, i, j = (rows[c].to_numpy() for c in ("path", "i", "j"))
            change = np.r_[False, (path[1:] != path[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            bits = rows[["bits1", "bits2"]].to_numpy().view(np.uint64)
            a, b = likely_pairs(np.cumsum(change), rows["n"].to_numpy(), bits, rows["block"].to_numpy(), i != j, threshold, most)
            label = least_labels(len(rows), a, b)
            node = rows["node"].to_numpy()
            out = label != np.arange(len(rows))
            yield pd.DataFrame({"a": node[out], "b": node[label[out]]})

    keys = ["path", "i", "j"]
    dealt = _in_blocks(buckets, f"ceil(size / {BLOCK})").select(*keys, "block", "node", "n", "bits1", "bits2")
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys, "block").mapInPandas(task, "a binary, b binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sorted, duplicate-free sets share."""
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1]
    sizes = np.diff(np.r_[starts, len(values)])
    each = np.repeat(sizes, sizes)
    out = np.zeros((n, n))
    few = each <= 8  # pairs of a rare element are counted one by one
    rare, of = values[few], owner[few]
    for d in range(1, 8):
        a = np.flatnonzero(rare[d:] == rare[:-d])
        if not len(a):
            break
        out += np.bincount(of[a] * n + of[a + d], minlength=n * n).reshape(n, n)
    out += out.T
    common = np.flatnonzero(sizes > 8)  # those of a common one by a product of 0/1 matrices
    for k in range(0, len(common), 4096):
        some = common[k : k + 4096]
        there = np.zeros((n, len(some)), np.float32)
        at = np.concatenate([np.arange(starts[c], starts[c] + sizes[c]) for c in some])
        there[owner[at], np.repeat(np.arange(len(some)), sizes[some])] = 1
        out += there @ there.T
    return out


def _marked(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: whether their key, a hash, may be in the first column of ``wanted``; never
    false where it is. A bitmap of FILTER_BITS bits tells, which is what is broadcast, however many are
    wanted; the more they are, the more rows are marked that are not among them."""
    at, bucket, bits = (f"{name}_{x}" for x in ("at", "bucket", "bits"))
    place = lambda c: F.pmod(c, F.lit(FILTER_BITS)) + 1
    own = wanted.select(place(F.col(wanted.columns[0])).alias(at))
    maps = own.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    met = rows.withColumn(at, F.bitmap_bit_position(place(key))).withColumn(bucket, F.bitmap_bucket_number(place(key))).join(F.broadcast(maps), bucket, "left")
    there = F.expr(f"(cast(conv(hex(substring({bits}, int({at} div 8) + 1, 1)), 16, 10) as int) >> int({at} % 8)) & 1 = 1")
    return met.withColumn(name, F.coalesce(there, F.lit(False))).drop(at, bucket, bits)


def _perhaps_among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` may be in the first column of ``wanted``; none that is there is missed."""
    return _marked(rows, F.col(column), wanted, "_perhaps").where("_perhaps").drop("_perhaps")


def _compared(groups: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """node, partner (one of a similar group, or itself), weight (documents that it is linked with)
    for each node and pair of blocks, from exact comparison within groups(root, ...)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(words, threshold, 1)
        for rows in _grouped(batches, ["root", "i", "j"]):
            for (_, i, j), own in rows.groupby(["root", "i", "j"], sort=False):
                own = own.drop_duplicates("node")
                sets = [signer.shingles(t) for t in own["text"]]
                size = np.array([len(s) for s in sets], float)
                both = shared_counts(sets)
                similar = both / (size[:, None] + size[None, :] - both) >= threshold
                np.fill_diagonal(similar, False)
                if i != j:
                    block = own["block"].to_numpy()
                    similar &= block[:, None] != block[None, :]
                node, copies = own["node"].to_numpy(), own["copies"].to_numpy()
                label = least_labels(len(own), *np.nonzero(np.triu(similar)))
                linked = similar.any(1)
                yield pd.DataFrame({"node": node, "partner": node[label], "weight": similar @ copies})[linked]

    keys = ["root", "i", "j"]
    # most texts have no likely partner and are dropped before the shuffle, as are copies of one that has
    key = lambda i, h: F.xxhash64(i, h).alias("_key")
    texts = _perhaps_among(docs.withColumn("_key", key("doc_id", "text_hash")), "_key", groups.select(key("first_id", "first_hash"))).select(F.col("doc_id").alias("first_id"), "text_hash", "text")
    blocks = f"greatest(ceil(members / {BLOCK}), ceil(shingles / {BLOCK_SHINGLES}))"
    dealt = _in_blocks(groups.join(texts, (groups["first_id"].eqNullSafe(texts["first_id"])) & (groups["first_hash"] == texts["text_hash"])).select("root", "members", "shingles", "node", "copies", "text"), blocks)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.select(*keys, "block", "node", "copies", "text").repartition(n, *keys).sortWithinPartitions(*keys, "block", "node")
    return ordered.mapInPandas(task, "node binary, partner binary, weight long")


def _linked(docs: DataFrame, threshold: float, words: int, recall: float, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows; for each node (a set's key) copies, n and least (of its rows: whether doc_id
    is null, doc_id, text_hash); for each node with links to others root (the same for all that
    links connect) and weight (linked rows)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = written(_signed(own, words, threshold, runs_needed(recall)), "op6-signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    classes = written(signed.groupBy("node").agg(F.count("*").alias("copies"), F.min("n").alias("n"), least), "op6-classes")

    buckets, made = _buckets(signed, small)
    likely = components(_connected(buckets, threshold), "op6-likely")
    firsts = classes.select("node", "copies", "n", F.col("least.doc_id").alias("first_id"), F.col("least.text_hash").alias("first_hash"))
    members = written(likely.join(firsts, "node"), "op6-members")
    discard(likely, *made)
    sizes = members.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    compared = written(_compared(members.join(sizes, "root"), own, words, threshold), "op6-compared")

    roots = components(compared.select(F.col("node").alias("a"), F.col("partner").alias("b")), "op6-linked")
    linked = written(roots.join(compared.groupBy("node").agg(F.sum("weight").alias("weight")), "node"), "op6-links")
    discard(members, compared, roots)
    return signed, classes, linked


def jaccard_join(docs: DataFrame, threshold: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, small: int = SMALL) -> DataFrame:
    """doc_id, class_id, copy_id and n_links for every row of docs(doc_id, text).

    Two documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of
    at least ``threshold``; n_links counts the other rows that a row is linked with. class_id is
    the least doc_id of all rows that links connect it with, copy_id the least of those with the same
    shingles. Texts without words (null too) have the same, empty set: they are copies of one
    another and linked with nothing else. Rows that share a doc_id are documents of their own.
    """
    signed, classes, linked = _linked(docs, threshold, words, recall, small)
    ids = linked.join(classes.select("node", "least"), "node").groupBy("root").agg(F.min("least.doc_id").alias("class_id"))
    own = signed.select("doc_id", "node").join(classes, "node").join(linked.join(ids, "root").select("node", "class_id", "weight"), "node", "left")
    return own.select("doc_id", F.coalesce("class_id", "least.doc_id").alias("class_id"), F.col("least.doc_id").alias("copy_id"), (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, small: int = SMALL) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group of linked documents stays:
    that with the least doc_id (nulls last), of equal ones that with the least hash of the text, and of
    rows equal in both that with the least hash of all columns."""
    signed, classes, linked = _linked(docs, threshold, words, recall, small)
    known = classes.join(linked, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    i, h, times, mark = (f"_{x}_{uuid.uuid4().hex}" for x in ("id", "hash", "times", "mark"))  # names that no column of docs has
    stays = known.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(i), F.col("least.text_hash").alias(h))
    rows = signed.groupBy(F.col("doc_id").alias(f"{i}_"), F.col("text_hash").alias(f"{h}_")).agg(F.count("*").alias(times))
    both = rows.join(stays.withColumn(mark, F.lit(True)), F.col(i).eqNullSafe(F.col(f"{i}_")) & (F.col(h) == F.col(f"{h}_")), "left")
    # what does not stay as it is: rows that go, and those that stay once of several
    changed = written(both.where(F.col(mark).isNull() | (F.col(times) > 1)).select(F.col(f"{i}_").alias(i), F.col(f"{h}_").alias(h), F.col(mark).isNotNull().alias(times)), "op6-changed")
    own = F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))))
    seen = _marked(docs, own, changed.select(F.xxhash64(i, h).alias(times)), mark)
    perhaps = seen.where(mark).drop(mark)  # all that is shuffled
    same = perhaps["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(perhaps["text"], F.lit(""))) == F.col(h))
    kept = seen.where(~F.col(mark)).drop(mark).unionByName(perhaps.join(changed, same, "left_anti"))
    if changed.where(times).isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = perhaps.join(changed.where(times), same, "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.struct(F.xxhash64(F.to_json(whole)), F.to_json(whole))).alias(mark))
    return kept.unionByName(repeated.select(f"{mark}.*"))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    bound_batches(spark)
    return jaccard_join(table(spark, sf_dir, "documents"))


#: The same by joining all shingles with all others and following links from every row.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(13)), '\s+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.8),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, min(root) AS class_id, least(doc_id, (SELECT min(b) FROM l WHERE a = doc_id AND same)) AS copy_id, (SELECT count(*) FROM l WHERE a = doc_id) AS n_links FROM r GROUP BY doc_id
"""
