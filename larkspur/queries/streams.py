"""Streams over ``events`` (SS, ST): the table as a stream, run until all of it is read, into a table that is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir
from ..streaming import results, upserts
from .common import query

KINDS = ["view", "click", "signup", "purchase", "error"]
DAY_MS = 24 * 3600 * 1000


def _streamed(spark, d, name):
    # as a pattern, since the path of a stream is a folder or a pattern
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def _into(stream, keys, newest=None):
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    target = upserts.VersionedTable(spark, f"{where}/table", keys, StructType.fromJson(stream.schema.jsonValue()), newest=newest)
    return upserts.run_into(stream, target, f"{where}/checkpoint")


@query("SS-03_streamed", """
    SELECT user_id AS job_id, event_type AS website, max(event_id) AS seq, max_by(value, event_id) AS value,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type)) - 1 AS INTEGER) AS place
    FROM events GROUP BY 1, 2""")
def ss03_streamed(spark, d):
    """Each user is a job and each kind of event a store of it, whose newest value is its row."""
    e = _streamed(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("website"), F.lit("site_finished").alias("kind"), "value")
    return _into(results.streamed_rows(e, KINDS), ["job_id", "website"], "version").select("job_id", "website", "seq", "value", "place")


@query("SS-04_streamed", f"""
    WITH e AS (SELECT user_id, event_type, event_id, epoch_ms(ts) AS ms, value, value >= 10 AS starts FROM events),
    s AS (SELECT user_id, event_type, min_by(ms, event_id) AS began, min(event_id) AS opened FROM e WHERE starts GROUP BY 1, 2),
    f AS (SELECT e.user_id, e.event_type, max(e.event_id) FILTER (began IS NULL OR e.event_id < opened) AS early, min(e.event_id) FILTER (e.event_id > opened) AS later FROM e LEFT JOIN s USING (user_id, event_type) WHERE NOT starts GROUP BY 1, 2),
    r AS (
        SELECT coalesce(s.user_id, f.user_id) AS job_id, coalesce(s.event_type, f.event_type) AS website, began, early, (SELECT ms FROM e WHERE event_id = f.later) AS ended
        FROM s FULL JOIN f ON f.user_id = s.user_id AND f.event_type = s.event_type)
    SELECT job_id, website, CASE WHEN early IS NOT NULL OR ended <= began + {DAY_MS} THEN 'Success' ELSE 'Failed' END AS status
    FROM r WHERE early IS NOT NULL OR ended IS NOT NULL OR began + {DAY_MS} <= (SELECT max(ms) FROM e)""")
def ss04_streamed(spark, d):
    """Events of a value of ten or more start a store, others are its rows; a store has a day."""
    e = _streamed(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("website"), results.kinds(F.col("value") >= 10).alias("kind"), "value")
    return _into(results.streamed_rows(e, KINDS, DAY_MS), ["job_id", "website"], "version").select("job_id", "website", "status")


@query("ST-04_streamed_upsert", "SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def st04_streamed(spark, d):
    """Each batch of events upserts the rows of its users."""
    e = _streamed(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return _into(e, ["user_id", "event_type"], "event_id")
