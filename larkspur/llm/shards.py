"""A sharded table with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable Parquet shards. Shards of one size tier
form a run; when a tier has ``fanout`` of them they are merged into files of
about the target size. Every change is one new manifest, which names the live
shards; it is written aside and renamed into place without overwriting, so a
reader sees the old version or the new one, and of two writers one has to
retry. That rename is atomic where the file system's is (HDFS and the like). On a
local disk or an object store it tests and then writes, so there one writer at a
time has to be seen to from outside. Rows move by DataFrame reads and writes
alone, without a shuffle: shards to be merged are dealt by size into files, and
one task writes each.

Merged shards stay until ``vacuum``, for readers of older versions. A writer that
dies leaves shards that no manifest names; they are never read, and ``vacuum``
removes them as well.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Shards below this size share the lowest tier.
SMALLEST_TIER_BYTES = 1 << 20


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class ShardStore:
    """A table of shards below ``path``, a folder that driver and executors share.

    Columns may have any names and nulls; rows, repeated ones too, are kept as
    they are. A store with no rows reads as an empty table of its schema, and
    appending an empty table commits a version without new shards.
    """

    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.path, self.target_bytes, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    # manifests

    def versions(self) -> list[int]:
        where = self._path("manifests")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The latest manifest, or that of one version; None for a store without any."""
        if version is None:
            if not (all_versions := self.versions()):
                return None
            version = all_versions[-1]
        stream = self._fs.open(self._path(f"manifests/v{version:09d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        said = json.loads(text)
        return Manifest(said["version"], said["schema"], tuple(Shard(**s) for s in said["shards"]))

    def _commit(self, manifest: Manifest) -> Manifest:
        """Put a manifest in place, or raise Conflict if its version is there."""
        text = json.dumps({"version": manifest.version, "schema": manifest.schema, "shards": [s.__dict__ for s in manifest.shards]})
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        no_overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(aside, self._path(f"manifests/v{manifest.version:09d}.json"), no_overwrite)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest.version} is taken") from e
            raise
        return manifest

    # shards

    def _write(self, df: DataFrame) -> tuple[Shard, ...]:
        where = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{where}")
        files = self._fs.listStatus(self._path(where))
        return tuple(sorted((Shard(f"{where}/{f.getPath().getName()}", f.getLen()) for f in files if f.getPath().getName().startswith("part-")), key=lambda s: s.path))

    def append(self, df: DataFrame, tries: int = 5) -> Manifest:
        """Commit one arrival as immutable shards, one for each of its partitions.

        Its columns must have the names and types of the store's, in their order;
        nothing is written where they don't.
        """
        self._same_columns(df.schema)
        new, schema = self._write(df), df.schema.json()
        for _ in range(tries):
            now = self._same_columns(df.schema)
            try:
                return self._commit(Manifest(now.version + 1 if now else 1, now.schema if now else schema, (now.shards if now else ()) + new))
            except Conflict:
                continue
        raise Conflict("no version could be committed")

    def _same_columns(self, schema: StructType) -> Manifest | None:
        """The latest manifest, if it agrees with these columns."""
        now = self.manifest()
        if now:
            own, its = ([(f.name, f.dataType.simpleString()) for f in x.fields] for x in (StructType.fromJson(json.loads(now.schema)), schema))
            if own != its:
                raise ValueError(f"the arrival's columns {its} are not the store's {own}")
        return now

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST_TIER_BYTES, self.fanout))) if size > SMALLEST_TIER_BYTES else 0

    def due(self, manifest: Manifest) -> list[Shard]:
        """The lowest run that is to be merged: ``fanout`` or more shards of a tier, none near the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in manifest.shards:
            if s.bytes < self.target_bytes / 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return next((run for _, run in sorted(tiers.items()) if len(run) >= self.fanout), [])

    def _merged(self, schema: str, run: list[Shard]) -> tuple[Shard, ...]:
        """A run's rows in files near the target: the largest shards are dealt first, each to the smallest file."""
        files: list[list[Shard]] = [[] for _ in range(max(1, round(sum(s.bytes for s in run) / self.target_bytes)))]
        for s in sorted(run, key=lambda s: (-s.bytes, s.path)):
            min(files, key=lambda f: sum(x.bytes for x in f)).append(s)
        return self._write(reduce(DataFrame.union, (self._read(schema, f).coalesce(1) for f in files if f)))

    def compact(self, vacuum: bool = False) -> Manifest | None:
        """Merge due runs until none is left, one commit for each. ``vacuum``: then drop all that the latest version doesn't name."""
        now = self.manifest()
        while now and (run := self.due(now)):
            merged, gone = self._merged(now.schema, run), {s.path for s in run}
            while True:
                if not gone <= {s.path for s in now.shards}:
                    raise Conflict("another writer has merged these shards")
                try:
                    now = self._commit(Manifest(now.version + 1, now.schema, tuple(s for s in now.shards if s.path not in gone) + merged))
                    break
                except Conflict:
                    now = self.manifest()
        if vacuum:
            self.vacuum(versions=1, older_than=0)
        return now

    def vacuum(self, versions: int = 10, older_than: float = 7 * 86_400) -> int:
        """Keep the last ``versions``; delete older manifests, and files that no version kept names. Returns how many files went.

        Nothing that is younger than ``older_than`` seconds goes, which has to be
        longer than any reader or writer takes. The kept versions' manifests are read
        after the list of files, so a commit in between loses nothing.
        """
        until = (time.time() - older_than) * 1000
        data = self._path("data")
        folders = list(self._fs.listStatus(data)) if self._fs.exists(data) else []
        listed = {f"data/{d.getPath().getName()}": [(f.getPath().getName(), f.getModificationTime()) for f in self._fs.listStatus(d.getPath())] for d in folders}
        numbers = self.versions()
        live = {s.path for v in numbers[-versions:] for s in self.manifest(v).shards}
        went = 0
        for folder, files in listed.items():
            old = [n for n, t in files if f"{folder}/{n}" not in live and t <= until]
            if len(old) == len(files):
                self._fs.delete(self._path(folder), True)
                went += len(old)
            else:
                for n in old:
                    went += not n.startswith(("_", ".")) and self._fs.delete(self._path(f"{folder}/{n}"), False)
        for v in numbers[:-versions]:
            where = self._path(f"manifests/v{v:09d}.json")
            if self._fs.getFileStatus(where).getModificationTime() <= until:
                self._fs.delete(where, False)
        return went

    def _read(self, schema: str, shards) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest version, or of an older one whose shards are still there."""
        now = self.manifest(version)
        if now is None:
            raise ValueError(f"no table at {self.path}")
        return self._read(now.schema, now.shards)


#: Parts in which ``arrive`` lets a table in: so many that runs are merged, whatever the table's size and files.
ARRIVALS = 2 * FANOUT


def arrive(store: ShardStore, rows: DataFrame, id_col: str, arrivals: int = ARRIVALS) -> None:
    """Append a table in ``arrivals`` parts, dealt by id, and compact after each; what merging leaves behind goes at once.

    An arrival has as many files as its share of the table's. Rows without an id arrive
    together; an empty table commits empty arrivals.
    """
    files = max(1, len(rows.inputFiles()) // arrivals)
    part = F.pmod(F.xxhash64(id_col), F.lit(arrivals))
    for k in range(arrivals):
        store.append(rows.where(part == k).coalesce(files))
        store.compact(vacuum=True)
