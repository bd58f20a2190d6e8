"""A table that a stream upserts, batch by batch, and a replayed batch leaves as it is.

Rows lie in buckets of their key. A batch rewrites the buckets that it touches in a
folder of its own and then commits a manifest, named after the batch, that says where
each bucket is. A batch whose manifest is there has been applied: what a query that
was killed does again after a restart changes nothing. A batch that was killed
before its commit leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import cascade

BUCKETS = 16


class VersionedTable:
    """Rows with one row for each key; ``newest``: where a column decides which of two rows of a key stays.

    One writer at a time, as a streaming query is; commits rename without
    overwriting, so that of two writers of one batch the second fails.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, *, newest: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.schema, self.newest, self.buckets = spark, path.rstrip("/"), keys, schema, newest, buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        """Batches that are committed."""
        where = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest(self, version: int) -> dict[str, str]:
        stream = self._fs.open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, where: dict[str, str]) -> None:
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(where).encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        no_overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        no_overwrite[0] = rename.NONE
        files.rename(aside, self._path(f"manifests/{version:012d}.json"), no_overwrite)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The table after its last batch, or after that of ``version``."""
        past = [v for v in self.versions() if version is None or v <= version]
        return self._read(sorted(self._manifest(past[-1]).values()) if past else [])

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Upsert a batch; false where it has been applied before. To the driver come the numbers of the buckets that it touches."""
        done = self.versions()
        if batch_id in done:
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state has to move on
            return False
        batch = batch.persist()  # read for its buckets and for its rows
        try:
            self._apply(batch, batch_id, done)
        finally:
            batch.unpersist()
        return True

    def _apply(self, batch: DataFrame, batch_id: int, done: list[int]) -> None:
        now = self._manifest(done[-1]) if done else {}
        rows = batch.select(*self.schema.names)
        rest = F.struct(*[c for c in self.schema.names if c not in self.keys])
        best = F.max_by(rest, self.newest) if self.newest else F.first(rest)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = rows.groupBy(*self.keys).agg(best.alias("__row")).select(*self.keys, "__row.*").select(*self.schema.names)
        touched = sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())
        old = self._read([now[str(b)] for b in touched if str(b) in now])
        if self.newest:
            is_new = F.col("__old").isNull() | (F.col(self.newest) > F.col("__old"))
            new = new.join(old.select(*self.keys, F.col(self.newest).alias("__old")), self.keys, "left").where(is_new).select(*self.schema.names)
        where = f"data/{batch_id:012d}-{uuid.uuid4().hex}"
        merged = cascade.upserted(old, new, self.keys).withColumn("__bucket", bucket).repartition("__bucket")
        merged.write.partitionBy("__bucket").parquet(f"{self.path}/{where}")
        self._commit(batch_id, now | {str(b): f"{where}/__bucket={b}" for b in touched})

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        self.apply(batch, batch_id)


def run_into(stream: DataFrame, target: VersionedTable, checkpoint: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there into a table, and read the table."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(target.sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return target.read()
