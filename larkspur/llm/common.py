"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch. Documents can be long, so batches are short.
TEXT_ROWS_PER_BATCH = 256
#: Bytes in one Arrow batch, where the Spark version has the setting.
BYTES_PER_BATCH = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a Python worker never holds many long texts; alike for all operators of a session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session has none (tests, a laptop) a temporary folder is set and
    removed when the interpreter ends. On a cluster such a folder would be another
    disk on every host, so there an error is raised.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    set_already = spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="larkspur-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that ``written`` makes while ``own_folders`` is open in this thread.
_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (for wide rows)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (folders := _FOLDERS.get()) is not None:
        folders.append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def own_folders(spark: SparkSession) -> Iterator[None]:
    """Delete what ``written`` makes inside, at the end; what other threads write stays."""
    mine = _FOLDERS.set([])
    try:
        yield
    finally:
        for path in _FOLDERS.get():
            remove(spark, path)
        _FOLDERS.reset(mine)


#: Rows of a table of group results (a few hundred bytes each) that may be broadcast.
BROADCAST_ROWS = 50_000


def is_small(df: DataFrame) -> bool:
    """Whether a checkpointed table of group results is small enough for a broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def sized(df: DataFrame, small: bool) -> DataFrame:
    """With a broadcast hint where the size check allowed it; else Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if small else df


#: Row numbers (16 bytes each) that may be broadcast.
NUMBERS = 250_000


def numbered(df: DataFrame) -> DataFrame:
    """A checkpointed table of row numbers for a join with whole rows: broadcast where it is short, else the hashed side of a shuffle."""
    return df.hint("broadcast" if df.limit(NUMBERS + 1).count() <= NUMBERS else "shuffle_hash")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
