"""Sharding with size-tiered compaction.

A store is a folder of immutable Parquet shards and of manifests, numbered
JSON files that list the shards of a version.

* ``append`` writes arrivals as small shards, each task on its own (no
  shuffle), and commits a version with them.
* ``compact`` groups shards by size tier (each tier ``ratio`` times the one
  below).  Wherever a tier has ``runs`` shards or more, they are merged into
  files of about ``target`` bytes; a merge reads a few shards and writes one
  file, in one task of bounded size.  Up to ``SIDE_BY_SIDE`` merges are the
  tasks of one Spark job; the round is committed at once.  Rounds go on until
  no tier is full.  Shards of at least half the target are finished and never
  rewritten.
* A commit writes the manifest under a temporary name and renames it, which
  fails if that version exists already: readers see a version whole or not at
  all.  A writer that loses the race tries again on the new version: arrivals
  always can, a merge if its inputs are still listed, else the round is planned
  anew.  Folders have names of their own, so what lost drivers and executors
  leave behind is seen by nobody and in nobody's way.
* ``vacuum`` drops manifests but the newest ``keep``, the files that only those
  listed, and folders that no manifest ever listed once they are ``age`` old:
  readers of a kept version and writers that haven't committed yet lose nothing.

The driver holds the manifest, a row per shard.

Defined results: an empty table commits a version without shards; null and
repeated rows and extra columns are kept as they are; a column that later
arrivals bring is null in earlier rows, one of another type is an error; a
very long row is a shard of its own at worst.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataloom.llm.storage import new_folder, remove

TARGET = 32 << 20
ARRIVAL_ROWS = 500
RATIO = 4.0
RUNS = 4
#: Bytes of the lowest tier.
FLOOR = 64 << 10
#: Merges of one Spark job.
SIDE_BY_SIDE = 128
#: Waves in which ``shard_documents`` lets a table arrive.
WAVES = 5
#: Versions that vacuum leaves, and seconds after which uncommitted folders count as left behind.
KEEP, AGE = 8, 7 * 24 * 3600.0


class Outdated(Exception):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Shard:
    name: str  # below the store's folder
    bytes: int
    rows: int
    level: int  # merges behind it


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, *, target: int = TARGET, ratio: float = RATIO, runs: int = RUNS):
        self.spark, self.folder, self.target, self.ratio, self.runs = spark, folder.rstrip("/"), target, ratio, runs
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.folder}/manifest"))

    # manifests -----------------------------------------------------------------

    def version(self) -> int:
        """The newest committed version, 0 for none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifest"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (the newest unless given): shards, schema and parent."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "parent": None, "schema": None, "shards": []}
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifest/v{version:08d}.json"

    def commit(self, shards: list[Shard], after: int, schema: dict | None = None) -> int:
        """Make ``shards`` version ``after`` + 1; Outdated if somebody else has made that version."""
        version = after + 1
        body = json.dumps({"version": version, "parent": after, "schema": schema, "shards": [asdict(s) for s in shards]})
        draft = self._path(f"{self.folder}/manifest/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(self._manifest(version))), none)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Outdated(f"version {version} exists") from None
            raise
        return version

    def change(self, edit: Callable[[list[Shard]], list[Shard] | None], new: StructType | None = None) -> int | None:
        """Commit ``edit`` of the newest shards, again whenever another writer was faster; None if ``edit`` gives None."""
        while True:
            now = self.manifest()
            shards = edit([Shard(**s) for s in now["shards"]])
            if shards is None:
                return None
            try:
                return self.commit(shards, now["version"], self._grown(now["schema"], new))
            except Outdated:
                continue

    @staticmethod
    def _grown(have: dict | None, new: StructType | None) -> dict | None:
        """The schema with the columns of ``new`` that it lacks."""
        if have is None or new is None:
            return have if new is None else new.jsonValue()
        old = StructType.fromJson(have)
        types = {f.name: f.dataType for f in old.fields}
        for f in new.fields:
            if types.get(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name!r} is {types[f.name].simpleString()} in the store and {f.dataType.simpleString()} in the arrivals")
        return StructType(old.fields + [f for f in new.fields if f.name not in types]).jsonValue()

    def schema(self) -> StructType | None:
        have = self.manifest()["schema"]
        return None if have is None else StructType.fromJson(have)

    # data ----------------------------------------------------------------------

    def _written(self, part: str, level: Callable[[int], int]) -> list[Shard]:
        """The files below a data folder, with their row counts; ``level`` of the number of the task that wrote a file."""
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}")) if s.getPath().getName().endswith(".parquet")}
        rows = {}
        if files:
            name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
            rows = {r.f: r["count"] for r in self.spark.read.parquet(f"{self.folder}/{part}").groupBy(name.alias("f")).count().collect()}
        return [Shard(f"{part}/{f}", n, rows[f], level(int(f.split("-")[1]))) for f, n in sorted(files.items()) if rows.get(f)]

    def append(self, arrivals: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Commit arrivals as small shards."""
        new = StructType.fromJson(arrivals.schema.jsonValue())
        for f in new.fields:
            f.nullable = True
        self._grown(self.manifest()["schema"], new)
        part = f"data/a{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", rows).parquet(f"{self.folder}/{part}")
        made = self._written(part, lambda _: 0)
        return self.change(lambda shards: shards + made, new)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / FLOOR, self.ratio)) + 1) if size > FLOOR else 0

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The merges of one round: similarly sized shards, at most about a target together."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        merges: list[list[Shard]] = []
        for _, group in sorted(tiers.items()):
            if len(group) < self.runs:
                continue
            bin_: list[Shard] = []
            for s in sorted(group, key=lambda s: (s.bytes, s.name)):
                if bin_ and sum(x.bytes for x in bin_) + s.bytes > self.target:
                    merges.append(bin_)
                    bin_ = []
                bin_.append(s)
            if len(bin_) > 1:
                merges.append(bin_)
        return [m for m in merges if len(m) > 1]

    def compact(self) -> int:
        """Merge until no tier is full; the newest version."""
        while True:
            now = self.manifest()
            shards = [Shard(**s) for s in now["shards"]]
            merges = self.plan(shards)
            if not merges:
                return now["version"]
            schema = StructType.fromJson(now["schema"])
            made: list[Shard] = []
            for at in range(0, len(merges), SIDE_BY_SIDE):
                made += self._merge(merges[at : at + SIDE_BY_SIDE], schema)
            gone = {s.name for m in merges for s in m}

            def swap(newest: list[Shard], gone: set[str] = gone, made: list[Shard] = made) -> list[Shard] | None:
                if not gone <= {s.name for s in newest}:
                    return None  # another writer has merged some of them: plan anew
                return [s for s in newest if s.name not in gone] + made

            if self.change(swap) is None:
                for part in {s.name.rsplit("/", 1)[0] for s in made}:
                    remove(self.spark, f"{self.folder}/{part}")

    def _merge(self, merges: list[list[Shard]], schema: StructType) -> list[Shard]:
        """One job with a task per merge: the k-th task reads the shards of the k-th merge and writes one file."""
        part = f"data/m{uuid.uuid4().hex}"
        reads = [self.spark.read.schema(schema).parquet(*[f"{self.folder}/{s.name}" for s in group]).coalesce(1) for group in merges]
        reduce(DataFrame.union, reads).write.parquet(f"{self.folder}/{part}")
        levels = [max(s.level for s in group) + 1 for group in merges]
        return self._written(part, levels.__getitem__)

    def vacuum(self, keep: int = KEEP, age: float = AGE) -> None:
        """Drop what only versions before the newest ``keep`` listed, and folders ``age`` seconds old that no manifest lists."""
        newest = self.version()
        folder = self._path(f"{self.folder}/manifest")
        found = {int(s.getPath().getName()[1:-5]): s.getPath() for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("v")}
        live = {s.name for v in found if v > newest - keep for s in self.shards(v)}
        dead = {s.name for v in found if v <= newest - keep for s in self.shards(v)} - live
        for v in sorted(found):
            if v <= newest - keep:
                self._fs.delete(found[v], False)
        for name in dead:
            self._fs.delete(self._path(f"{self.folder}/{name}"), False)
        held = {n.rsplit("/", 1)[0] for n in live}
        emptied = {n.rsplit("/", 1)[0] for n in dead} - held
        data = self._path(f"{self.folder}/data")
        for part in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = f"data/{part.getPath().getName()}"
            if name in emptied or (name not in held and part.getModificationTime() / 1000.0 < time.time() - age):
                self._fs.delete(part.getPath(), True)

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """A version's rows (the newest unless given); with ``shard_col``, also the name of each row's shard under that name."""
        now = self.manifest(version)
        schema = StructType([]) if now["schema"] is None else StructType.fromJson(now["schema"])
        if shard_col in schema.names:
            raise ValueError(f"the data has a column {shard_col!r}")
        names = [f"{self.folder}/{s['name']}" for s in now["shards"]]
        if not names:
            rows = self.spark.createDataFrame([], schema)
            return rows if shard_col is None else rows.withColumn(shard_col, F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*names)
        if shard_col is None:
            return rows
        parts = F.split(F.col("_metadata.file_path"), "/")
        return rows.withColumn(shard_col, F.concat_ws("/", F.lit("data"), F.element_at(parts, -2), F.element_at(parts, -1)))


def shard_documents(docs: DataFrame, folder: str | None = None, waves: int = WAVES, rows: int = ARRIVAL_ROWS, **options) -> DataFrame:
    """Let ``docs`` arrive at a new store in ``waves`` (by hash of doc_id), compacting after each; where each document lies then.

    ``doc_id``, ``n_chars`` and ``text_sha256`` as read back, ``shard_no`` (in
    manifest order), ``shard_rows``, ``shard_bytes``, ``level`` and ``version``.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, folder or new_folder(spark, "shards"), **options)
    for wave in range(waves):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(waves)) == wave), rows)
        version = store.compact()
    found = [(s.name, i, s.rows, s.bytes, s.level) for i, s in enumerate(store.shards())]
    name = f"shard-{uuid.uuid4().hex}"
    shards = spark.createDataFrame(found, f"`{name}` string, shard_no int, shard_rows long, shard_bytes long, level int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = store.read(shard_col=name).select("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), name)
    return read.join(shards, name).drop(name).withColumn("version", F.lit(version).cast("long"))
