"""Jobs as a table: their state from their events, look-ups by id, and what a client sees that polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import progress

#: Kinds of events that end a job.
ENDS = ("done", "error")
#: Fixed value: milliseconds between two polls.
POLL_MS = 800
# Fixed value: what is said about a job that isn't known.
GONE = "This search has expired. Please start again."


def states(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each job: ``status`` (running, done or error), ``percent``, ``n_events``. Jobs without events run at 0."""
    last = F.max_by(F.struct("kind", "percent"), "seq")
    now = progress.progress(events).groupBy("job_id").agg(last.alias("__last"), F.count(F.lit(1)).alias("n_events"))
    kind = F.col("__last.kind")
    status = F.when(kind.isin(*ENDS), kind).otherwise("running")
    out = jobs.join(now, "job_id", "left")
    return out.select(*jobs.columns, status.alias("status"), F.coalesce("__last.percent", F.lit(0)).alias("percent"), F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"))


def looked_up(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Every asked ``job_id`` with its state, or 404 and why."""
    rest = [c for c in known.columns if c != "job_id"]
    found = asked.join(known.withColumn("__known", F.lit(True)), "job_id", "left")
    code = F.when(F.col("__known"), 200).otherwise(404)
    return found.select(*asked.columns, code.alias("http_status"), F.when(F.col("__known").isNull(), GONE).alias("detail"), *rest)


def polled(events: DataFrame, every_ms: int = POLL_MS) -> DataFrame:
    """What each poll of a client sees that begins with a job's first event and stops at the first poll after its end.

    Returns ``job_id, seq, first_poll, n_polls`` for each event that some poll
    finds to be the latest: a run of polls as one row, so that a long wait costs
    no more than a short one. One window sort for each job, no join. Events without
    a time come last and have no number of a poll.
    """
    job = Window.partitionBy("job_id")
    by_job = job.orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("seq"))
    ended = F.count_if(F.col("kind").isin(*ENDS)).over(by_job.rowsBetween(Window.unboundedPreceding, -1))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    at = F.ceil((ms - F.min(ms).over(job)) / every_ms)
    live = events.withColumn("__ended", ended).withColumn("first_poll", at).where("__ended = 0")
    n = F.coalesce(F.lead("first_poll").over(by_job) - F.col("first_poll"), F.lit(1))
    return live.select("job_id", "seq", "first_poll", n.alias("n_polls")).where("n_polls > 0")
