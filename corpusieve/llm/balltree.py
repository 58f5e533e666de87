"""Operator 13: centroid clustering (k-means in whole numbers) with ball trees that filter centroids.

Vectors become whole numbers. Each task splits its rows, BLOCK at a time, into a metric tree: a ball has a
centre, a radius, the number of its vectors and their sum. Trees are built once and written. In each round
a ball takes the centroids that can be nearest to any vector in it: by the triangle inequality none whose
distance from the centre exceeds the least one by more than twice the radius. If one centroid is left, the
whole ball is its own, with count and sum; if not, the ball's halves go on with the centroids that are
left, down to leaves, whose vectors are compared exactly in whole numbers. Each task sends a row for each
centroid, which are summed; the driver holds only the centroids.

Vectors take part that have exactly DIMENSIONS components, none null or not finite, and no floor(256 x) of
2^27 or more in magnitude (distances of larger ones don't fit a long). With fewer vectors than centroids
each starts one. Rows that share a vec_id are told apart by their components; rows equal in both are as many
vectors, and equal centroids are allowed: the one of smaller number gets all. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusieve.runtime import bound_batches, discard, table, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of a tree and of a leaf, at most.
BLOCK, LEAF = 8192, 48
_LARGEST = 1 << 27
#: Components up to this have products and sums that doubles hold exactly.
_EXACT = 1 << 22


def whole(v: Column) -> Column:
    """Each component x as floor(SCALE x); null for a vector that takes no part."""
    own = F.transform(v.cast("array<double>"), lambda x: F.floor(x * SCALE))
    fits = F.forall(v.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LARGEST / SCALE))
    return F.when(v.isNotNull() & (F.size(v) == DIMENSIONS) & fits, own)


def kept(rows: DataFrame) -> DataFrame:
    """vec_id and v (whole numbers) of the rows(vec_id, embedding) that take part."""
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("v")).where("v is not null")


def first_centroids(vectors: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The vectors with the least digests of their ids, in that order, ties by components; null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, DIMENSIONS)


# -- trees

_TREE = "vectors binary, ids binary, known binary, bounds binary, halves binary, centres binary, radii binary, sums binary"


def tree_of(vectors: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the vectors, and the balls over stretches of it: bounds, halves (the number of the first
    of two, or -1 for a leaf), centres, radii (never too small) and sums."""
    order, bounds, halves, centres, radii, sums = np.arange(len(vectors)), [(0, len(vectors))], [], [], [], []
    at = 0
    while at < len(bounds):
        a, b = bounds[at]
        own = vectors[order[a:b]]
        total = own.sum(0)
        centre = total / (b - a)
        far = np.sqrt(((own - centre) ** 2).sum(1))
        radius = far.max()
        if b - a > LEAF and (own != own[0]).any():
            # two vectors far from each other; each row goes to the nearer one
            x = own[far.argmax()]
            y = own[((own - x).astype(np.float64) ** 2).sum(1).argmax()]
            towards = (own - (x + y) / 2) @ (y - x).astype(np.float64)
            right = towards > 0
            cut = int((~right).sum())
            if not 0 < cut < b - a:
                right, cut = np.arange(b - a) >= (b - a) // 2, (b - a) // 2
            order[a:b] = np.concatenate([order[a:b][~right], order[a:b][right]])
            halves.append(len(bounds))
            bounds += [(a, a + cut), (a + cut, b)]
        else:
            halves.append(-1)
        centres.append(centre)
        radii.append(radius * (1 + 1e-9) + 1e-6)
        sums.append(total)
        at += 1
    return order, {"bounds": np.array(bounds, np.int64), "halves": np.array(halves, np.int64), "centres": np.array(centres), "radii": np.array(radii), "sums": np.array(sums, np.int64)}


def forest(vectors: DataFrame) -> DataFrame:
    """A row for each tree of vectors(vec_id, v)."""

    def plant(ids: list, rows: list) -> pa.RecordBatch:
        own = np.concatenate(rows)
        own_ids, known = np.concatenate([x for x, _ in ids]), np.concatenate([x for _, x in ids])
        order, balls = tree_of(own)
        parts = [own[order], own_ids[order], known[order], *balls.values()]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], [x.split()[0] for x in _TREE.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0
        for batch in batches:
            column = batch.column("vec_id")
            own = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)
            own_ids, known = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
            for at in range(0, len(own), BLOCK):
                rows.append(own[at : at + BLOCK])
                ids.append((own_ids[at : at + BLOCK], known[at : at + BLOCK]))
                n += len(rows[-1])
                if n >= BLOCK - 1024:  # a batch has 1024 rows at most
                    yield plant(ids, rows)
                    ids, rows, n = [], [], 0
        if n:
            yield plant(ids, rows)

    return vectors.mapInArrow(task, _TREE)


class Tree:
    """A row of the forest; ``walk`` gives its balls and leaves to centroids."""

    def __init__(self, row: dict[str, bytes]) -> None:
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(-1, DIMENSIONS)
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.bounds, self.halves = np.frombuffer(row["bounds"], np.int64).reshape(-1, 2), np.frombuffer(row["halves"], np.int64)
        self.centres, self.radii = np.frombuffer(row["centres"]).reshape(-1, DIMENSIONS), np.frombuffer(row["radii"])
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, DIMENSIONS)

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None, int]]:
        """(ball, first and last vector, numbers, centroid): a whole ball is a centroid's (numbers is
        None), or each vector of a leaf has a number of its own."""
        away = np.sqrt(np.maximum(((self.centres[:, None, :] - centroids[None, :, :]) ** 2).sum(2), 0)) if len(self.radii) < 64 else _apart(self.centres, centroids)
        spare = 1e-7 * (away.max() + 1)  # doubles are not exact; a centroid too many does no harm
        todo = [(0, np.arange(len(centroids)))]
        while todo:
            ball, left = todo.pop()
            here = away[ball, left]
            left = left[here <= here.min() + 2 * self.radii[ball] + spare]
            a, b = self.bounds[ball]
            if len(left) == 1:
                yield ball, a, b, None, int(left[0])
            elif self.halves[ball] < 0:
                yield ball, a, b, left[nearest(self.vectors[a:b], centroids[left])], -1
            else:
                todo += [(int(self.halves[ball]) + 1, left), (int(self.halves[ball]), left)]


def _apart(centres: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances between centres and centroids, one centroid at a time."""
    return np.sqrt(np.stack([((centres - c) ** 2).sum(1) for c in centroids], 1))


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors from all centroids."""
    if max(abs(vectors).max(initial=0), abs(centroids).max(initial=0)) <= _EXACT:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return squares(vectors, centroids).argmin(1)  # of equal ones the first


def next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floor of the mean of each centroid's vectors; its own place if it has none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                for ball, a, b, each, cluster in tree.walk(centroids):
                    if each is None:
                        count[cluster] += b - a
                        total[cluster] += tree.sums[ball]
                    else:
                        np.add.at(count, each, 1)
                        np.add.at(total, each, tree.vectors[a:b])
        used = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * DIMENSIONS), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), sums], ["cluster", "n", "total"])

    parts = trees.mapInArrow(task, "cluster int, n long, total array<long>")
    exact = "decimal(38,0)"
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast(exact)).alias(f"s{i}") for i in range(DIMENSIONS)])
    out = centroids.copy()
    for r in sums.collect():  # a row for each centroid
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(DIMENSIONS)]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                cluster = np.empty(len(tree.ids), np.int32)
                for _, a, b, each, one in tree.walk(centroids):
                    cluster[a:b] = one if each is None else each
                distance = ((tree.vectors - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, mask=~tree.known), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(task, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of each of rows(vec_id, embedding) that takes part, as a written
    table, and the centroids."""
    vectors = kept(rows)
    centroids = first_centroids(vectors, k)
    trees = written(forest(vectors), "op13-trees")
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(trees, centroids)
    out = written(assigned(trees, centroids), "op13-assigned")
    discard(trees)
    return out, centroids


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings, how tight they are, and a digest of each centroid."""
    bound_batches(spark)
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))
    return found.join(F.broadcast(each), "cluster").join(F.broadcast(digests), "cluster").join(F.broadcast(whole), F.lit(True), "inner").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # 40 rows, 40, 1


def _sql() -> str:
    parts = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF isfinite(x) AND abs(x::DOUBLE) < {_LARGEST // SCALE}]) = {DIMENSIONS}),
parts AS (SELECT r, unnest(v) AS x, unnest(range(1, {DIMENSIONS + 1})) AS i FROM kept),
c0 AS (
  SELECT c, unnest(v) AS x, unnest(range(1, {DIMENSIONS + 1})) AS i
  FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {CLUSTERS}))"""
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"""d{k} AS (SELECT r, c, sum((p.x - q.x) * (p.x - q.x))::BIGINT AS d FROM parts p JOIN c{k} q USING (i) GROUP BY r, c),
a{k} AS (SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < ROUNDS:
            parts.append(f"""m{k} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{k} JOIN parts USING (r) GROUP BY c, i),
c{k + 1} AS (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{k} LEFT JOIN m{k} USING (c, i))""")
    last = ROUNDS
    parts.append(f"digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{last} GROUP BY c)")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN digests USING (c)
"""
    )


OP13_SQL = _sql()
