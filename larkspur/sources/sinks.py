"""Files that a run leaves behind: dumps of captured pages and a log for each job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cascade


def dump_pages(captures: DataFrame, path: str) -> None:
    """Write captures below a folder for each retailer and kind of page."""
    captures.withColumn("site", text.site_slug("website")).write.partitionBy("site", "kind").parquet(path)


def response_json(rows: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One JSON document for each query: its rows in site order, how many have a price, of how many, and which checks were skipped.

    ``rows`` are final rows; ``skipped`` has ``component, consequence, cause,
    component_order`` of the whole run, a handful that every response repeats.
    """
    out = cascade.responses(rows)
    checks = F.array().cast("array<struct<component:string,consequence:string,cause:string>>")
    if skipped is not None:
        listed = F.array_sort(F.collect_list(F.struct("component_order", "component", "consequence", "cause")))
        every = skipped.agg(F.transform(listed, lambda x: F.struct(x["component"], x["consequence"], x["cause"])).alias("__skipped"))
        out, checks = out.crossJoin(F.broadcast(every)), F.col("__skipped")
    body = F.to_json(F.struct("rows", "success_count", "total_sites", checks.alias("checks_skipped")))
    return out.select("query_id", body.alias("body"))


def job_logs(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Log lines ``job_id, folder, seq, line`` of jobs ``(job_id, query)`` from their events ``(job_id, seq, ts, kind)``.

    A job's folder is named by its start, the head of its id and its query.
    Starts come from one aggregate that combines on the map side.
    """
    started = events.groupBy("job_id").agg(F.min("ts").alias("__start"))
    folder = F.concat_ws("_", F.date_format("__start", "yyyyMMdd-HHmmss"), F.substring(F.col("job_id").cast("string"), 1, 8), text.log_slug("query"))
    named = jobs.join(started, "job_id").select("job_id", folder.alias("folder"))
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("INFO"), "kind")
    return events.join(named, "job_id").select("job_id", "folder", "seq", line.alias("line"))
