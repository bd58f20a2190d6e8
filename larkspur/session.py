"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session has none, a temporary one. On a cluster there has to be one."""
    if where := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="larkspur-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder as a table and read back, so that plans over them begin there."""
    where = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(where)
    return rows.sparkSession.read.parquet(where)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt to all cores by ``keys`` before they grow: a small file is read by one task or two, however many rows it holds."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """What runs inside broadcasts a side of a join by the size that it was found to have, and not by that of its files.

    The files of short, repetitive rows are small, and a table that is broadcast is built by the driver.
    """
    least, found = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (least, found)}
    spark.conf.set(found, before[found] or spark.conf.get(least))
    spark.conf.set(least, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
