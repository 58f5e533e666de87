"""Operator 5: a sharded table with size-tiered compaction and a versioned manifest.

Arrivals are written as small immutable Parquet shards and become visible by a manifest, a JSON
file whose name is its version; it is written aside and renamed, which fails if another writer took
that version first. Who loses puts the same change on top of the version that won. Compaction takes
shards of one size tier (a tier spans a factor of ``FAN``) once there are enough of them, packs them
into files of the target size and commits a manifest that names these instead. Readers hold on to the
version that they opened; ``vacuum`` deletes files that only older versions name, and files that no
version names once they are so old that no writer can be about to commit them.

The rows themselves pass through Spark's readers and writers only. Files are packed by the scan,
which gives whole shards to tasks up to the target size, so compaction needs no shuffle.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusieve.runtime import scratch, table

TARGET_BYTES = 128 << 20
#: Shards of one tier differ in size by less than this factor.
FAN = 4
#: A tier is compacted once it has as many shards.
RUN = 4
#: Seconds after which a file that no version names is taken for one that a lost writer left.
GRACE = 7 * 24 * 3600
#: Times that a change is put on top of a version that another writer committed meanwhile.
TRIES = 100


@dataclass(frozen=True)
class Shard:
    path: str  # below the root
    bytes: int
    arrival: str


class ShardStore:
    """A table of Parquet shards below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN, run: int = RUN) -> None:
        if target_bytes < 1 or fan < 2 or run < 2:
            raise ValueError("target_bytes must be positive, fan and run at least 2")
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan, self.run = target_bytes, fan, run
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # rename without overwriting
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # -- manifests

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{v:010d}.json"))
        try:
            found = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if not found:
            raise ValueError(f"the files of version {v} were removed by a vacuum")
        return json.loads(found)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**x) for x in self.manifest(version)["shards"]]

    def _put(self, version: int, schema: dict, shards: list[Shard]) -> bool:
        """Makes the manifest of ``version``; False if there is one already."""
        final = self._path(f"{self.root}/manifest/v{version:010d}.json")
        aside = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        try:
            self._context.rename(aside, final, self._keep)
        except Py4JJavaError:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def _commit(self, change: Callable[[dict], tuple[dict, list[Shard]] | None]) -> int | None:
        """Makes the version that ``change`` makes of the newest; if another writer was first, of the
        one that is newest then. None if ``change`` gives None: there is nothing left to change."""
        for _ in range(TRIES):
            now = self.manifest()
            if (new := change(now)) is None:
                return None
            if self._put(now["version"] + 1, *new):
                return now["version"] + 1
        raise RuntimeError(f"other writers were first {TRIES} times")

    # -- writing

    def _files(self, folder: str) -> list[tuple[str, int]]:
        found = self._fs.listFiles(self._path(f"{self.root}/{folder}"), True)
        out = []
        while found.hasNext():
            f = found.next()
            path = f.getPath().toString()
            if path.endswith(".parquet"):
                out.append((path[path.index(f"/{folder}/") + 1 :], int(f.getLen())))
        return sorted(out)

    def append(self, df: DataFrame, arrival: str = "") -> int:
        """Adds ``df`` as new shards and commits; columns must be those of earlier arrivals."""
        self._same_columns(self.manifest()["schema"], json.loads(df.schema.json()))
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return self._add(df.schema, [Shard(path, size, arrival) for path, size in self._files(folder)])

    def append_each(self, df: DataFrame, arrival: str) -> list[int]:
        """Adds ``df`` as one arrival for each value of its column ``arrival``, in order of the
        values; a single pass writes the shards of all, each is committed by itself. The column
        is stored too."""
        folder, name = f"data/{uuid.uuid4().hex}", f"_arrival_{uuid.uuid4().hex}"
        df.withColumn(name, F.col(arrival)).write.partitionBy(name).parquet(f"{self.root}/{folder}")
        by: dict[str, list[Shard]] = {}
        for path, size in self._files(folder):
            value = path.split(f"{name}=")[1].split("/")[0]
            by.setdefault(value, []).append(Shard(path, size, value))
        in_order = sorted(by, key=lambda x: (0, int(x), "") if x.lstrip("-").isdigit() else (1, 0, x))
        return [self._add(df.schema, by[value]) for value in in_order] or [self._add(df.schema, [])]

    def _add(self, schema: StructType, new: list[Shard]) -> int:
        own = json.loads(schema.json())

        def added(now: dict) -> tuple[dict, list[Shard]]:
            self._same_columns(now["schema"], own)
            return now["schema"] or own, [*(Shard(**x) for x in now["shards"]), *new]

        return self._commit(added)

    @staticmethod
    def _same_columns(before: dict | None, own: dict) -> None:
        if before and _plain(before) != _plain(own):
            raise ValueError("the columns differ from those of earlier arrivals")

    def tier(self, size: int) -> int:
        """0 for the smallest shards; one more for each factor of ``fan``."""
        return max(0, math.ceil(math.log(max(size, 1) / 4096, self.fan)))

    def plan(self) -> list[list[Shard]]:
        """Runs to merge: all shards of a tier that has enough of them and is below the target."""
        tiers: dict[int, list[Shard]] = {}
        for shard in self.shards():
            if shard.bytes < self.target_bytes // 2:
                tiers.setdefault(self.tier(shard.bytes), []).append(shard)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.run]

    def compact(self) -> int:
        """Merges every run of similarly sized shards; returns the newest version.

        A run's shards are packed into files of about the target size. Each run is committed by
        itself, so a job that fails leaves the versions before it, and a run of larger shards
        that results is merged in turn.
        """
        while runs := self.plan():
            before = self.shards()
            for run in runs:
                self._merge(run)
            if len(self.shards()) >= len(before):
                break
        return self.version()

    def _merge(self, run: list[Shard]) -> None:
        now = self.manifest()
        folder = f"data/{uuid.uuid4().hex}"
        total = sum(s.bytes for s in run)
        parts = max(1, round(total / self.target_bytes))
        rows = self._read(now["schema"], run)
        # whole files go to as many tasks as there are target files; no row is shuffled
        rows.coalesce(parts).write.parquet(f"{self.root}/{folder}")
        merged = [Shard(path, size, "") for path, size in self._files(folder)]
        gone = {s.path for s in run}

        def replaced(now: dict) -> tuple[dict, list[Shard]] | None:
            if not gone <= {x["path"] for x in now["shards"]}:
                return None  # another compaction took some of them
            return now["schema"], [*(Shard(**x) for x in now["shards"] if x["path"] not in gone), *merged]

        if self._commit(replaced) is None:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def vacuum(self, grace: float = GRACE) -> int:
        """Deletes data files that only older versions name, and those of no version that were
        written more than ``grace`` seconds ago; returns how many. Readers of older versions must be
        done; writers need not be.

        The manifests of versions that lost files are emptied, not removed, so that no writer takes their
        numbers for free; later vacuums tell them by their size and read only those since the last one.
        """
        newest = self.version()
        named = {s.path for s in self.shards(newest)}
        manifests = {x.getPath().getName(): x.getLen() for x in self._fs.listStatus(self._path(f"{self.root}/manifest"))}
        before = [v for v in (int(n[1:-5]) for n, size in manifests.items() if n.startswith("v") and size) if v < newest]
        of = {v: {s.path for s in self.shards(v)} for v in before}
        older = set().union(*of.values())
        for v in before:
            if of[v] - named:
                self._fs.create(self._path(f"{self.root}/manifest/v{v:010d}.json"), True).close()
        gone = 0
        for path, _ in self._files("data"):
            at = self._path(f"{self.root}/{path}")
            if path not in named and (path in older or time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 > grace):
                self._fs.delete(at, False)
                gone += 1
        return gone

    # -- reading

    def _read(self, schema: dict, shards: list[Shard]) -> DataFrame:
        own = StructType.fromJson(schema)
        if not shards:
            return self.spark.createDataFrame([], own)
        return self.spark.read.schema(own).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        found = self.manifest(version)
        if not found["schema"]:
            raise ValueError("nothing was ever appended")
        return self._read(found["schema"], [Shard(**x) for x in found["shards"]])


def _plain(schema: dict) -> list:
    return [(f["name"], f["type"]) for f in schema["fields"]]


#: Arrivals that the query deals the documents to.
ARRIVALS = 8


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after eight arrivals, compaction and vacuum, read by the last manifest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    arrival = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % ARRIVALS, F.lit(0)).cast("int")
    store = ShardStore(spark, scratch(spark, "op5-shards"))
    store.append_each(docs.withColumn("arrival", arrival), "arrival")
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, lang, source, n_chars, length(text)::BIGINT AS text_chars, sha256(text) AS text_sha256 FROM documents
"""
