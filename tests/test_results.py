"""Rows of jobs and upserts as streams: several batches, restarts, replays, and limits by a clock of events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.streaming import results, upserts

BEGAN = datetime(2024, 5, 1, 12)
EVENTS = "job_id bigint, seq bigint, ts timestamp, website string, kind string, value double"
ORDER = ["Amazon.com", "BestBuy.com", "Walmart.com", "Newegg.com"]


def written(spark, path, batches):
    """One file for each batch, in this order."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(j, s, BEGAN + timedelta(seconds=at), w, kind, v) for j, s, at, w, kind, v in rows], EVENTS)
        df.coalesce(1).write.parquet(f"{path}/{k:03d}")


def stream(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def rows_table(spark, path):
    return upserts.VersionedTable(spark, path, ["job_id", "website"], spark.createDataFrame([], results.ROWS).schema, newest=None)


def run(spark, tmp_path, target, timeout_ms=None, sink=None):
    out = results.streamed_rows(stream(spark, tmp_path / "in"), ORDER, timeout_ms)
    query = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(sink or target.sink).trigger(availableNow=True).start()
    query.awaitTermination()


def test_rows_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(1)
    events = [(rng.randint(0, 4), k, k, rng.choice([*ORDER, "Other.com"]), rng.choice(["site_finished", "recheck_site", "start"]), rng.choice([None, 1.0, 2.5])) for k in range(120)]
    rng.shuffle(events)  # later batches bring earlier events too
    seen = []
    target = rows_table(spark, f"{tmp_path}/table")

    def sink(batch, k):
        seen.append((k, batch.collect()))
        target.sink(batch, k)

    written(spark, tmp_path / "in", [events[:30], events[30:60]])
    run(spark, tmp_path, target, sink=sink)
    for k, some in enumerate((events[60:90], events[90:])):
        df = spark.createDataFrame([(j, s, BEGAN + timedelta(seconds=at), w, kind, v) for j, s, at, w, kind, v in some], EVENTS)
        df.coalesce(1).write.parquet(f"{tmp_path}/in/9{k}")
    run(spark, tmp_path, target, sink=sink)  # from the checkpoint
    assert len(seen) >= 4
    want = {}
    for j, s, _, w, kind, v in sorted(events):
        if kind != "start":
            want[j, w] = (s, v)
    assert {(r.job_id, r.website): (r.seq, r.value) for r in target.read().collect()} == want
    for _, rows in seen:  # a job's rows come all together, in the order of stores
        by_job = {}
        for r in rows:
            by_job.setdefault(r.job_id, []).append(r)
        for some in by_job.values():
            assert [r.place for r in sorted(some, key=lambda r: r.place)] == list(range(len(some)))
            names = [r.website for r in sorted(some, key=lambda r: r.place)]
            assert names == sorted(names, key=lambda w: ([*ORDER, "Other.com"].index(w)))
            assert len({r.version for r in some}) == 1


def test_late_stores_fail_while_others_go_on(spark, tmp_path):
    start, done = "site_started", "site_finished"
    batches = [
        [(1, 0, 0, "Amazon.com", start, None), (1, 1, 1, "Walmart.com", start, None), (2, 2, 2, "Amazon.com", start, None)],
        [(1, 3, 100, "Amazon.com", done, 9.0), (2, 4, 242, "Amazon.com", done, 7.0)],  # the last moment
        [(3, 5, 300, "Newegg.com", start, None)],  # the clock passes Walmart's limit of 241 s
        [(1, 6, 301, "Walmart.com", done, 5.0), (1, 7, 302, "BestBuy.com", done, 6.0)],  # too late; another store goes on
        [(1, 8, 303, "Walmart.com", "recheck_site", 4.5), (3, 9, 900, "Newegg.com", done, 1.0)],  # a second look counts; late in its own batch
    ]
    seen, target = [], rows_table(spark, f"{tmp_path}/table")

    def sink(batch, k):
        seen.extend((r.job_id, r.website, r.status, r.value) for r in batch.collect())
        target.sink(batch, k)

    written(spark, tmp_path / "in", batches)
    run(spark, tmp_path, target, 240_000, sink)
    assert (1, "Walmart.com", "Failed", None) in seen and (1, "Walmart.com", "Success", 5.0) not in seen
    rows = {(r.job_id, r.website): (r.status, r.value) for r in target.read().collect()}
    assert rows == {(1, "Amazon.com"): ("Success", 9.0), (2, "Amazon.com"): ("Success", 7.0), (1, "Walmart.com"): ("Success", 4.5), (1, "BestBuy.com"): ("Success", 6.0), (3, "Newegg.com"): ("Failed", None)}


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_killed_batch_is_replayed_once(spark, tmp_path, when):
    events = [(k % 3, k, k, ORDER[k % 4], "site_finished", float(k)) for k in range(60)]
    written(spark, tmp_path / "in", [events[:20], events[20:40], events[40:]])
    target, calls = rows_table(spark, f"{tmp_path}/table"), []

    def killed(batch, k):
        calls.append(k)
        if k == 1 and when == "before":
            raise RuntimeError("killed")
        target.apply(batch, k)
        if k == 1:
            raise RuntimeError("killed")  # the batch is in the table, the query doesn't know

    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, target, sink=killed)
    before = target.read().collect()
    again = []
    run(spark, tmp_path, target, sink=lambda batch, k: again.append((k, target.apply(batch, k))))
    assert calls == [0, 1] and again[0] == (1, when == "before")
    assert target.versions() == [0, 1, 2]
    assert sorted(target.read(1).collect()) == sorted(before) or when == "before"
    assert {(r.job_id, r.website): r.value for r in target.read().collect()} == {(k % 3, ORDER[k % 4]): float(k) for k in range(60)}


def test_upserts_keep_the_newest_and_old_versions(spark, tmp_path):
    schema = "k bigint, seq bigint, v string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    table = upserts.VersionedTable(spark, f"{tmp_path}/t", ["k"], make([]).schema, newest="seq", buckets=3)
    assert table.read().count() == 0
    assert table.apply(make([(1, 5, "a"), (2, 1, "b"), (1, 4, "old")]), 0)
    assert table.apply(make([(1, 3, "older"), (2, 2, "c"), (3, 1, None), (None, 1, "no key")]), 7)
    assert not table.apply(make([(1, 99, "replayed")]), 7)
    assert table.apply(make([]), 8)
    assert sorted((r.k or 0, r.v) for r in table.read().collect()) == [(0, "no key"), (1, "a"), (2, "c"), (3, None)]
    assert sorted((r.k, r.v) for r in table.read(0).collect()) == [(1, "a"), (2, "b")]
    assert table.read().where(F.col("k") == 1).count() == 1
