"""What queries cost that grow with small files of many rows, and with many events of a job."""

from collections import Counter

import pandas as pd

from larkspur import session
from larkspur.queries import pages
from larkspur.streaming import results


def test_pages_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    rows = [(i, f"name {i}", "b", "t", 1.0 + i) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert pages.part_pages(spark, str(tmp_path)).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_small_files_are_not_broadcast_unmeasured(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    table = session.stored(spark.range(100), "small")
    with session.measured_joins(spark):
        plan = table.join(session.stored(spark.range(50), "small"), "id")._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {k: spark.conf.get(k) for k in before} == before


class Handle:
    """State of one job that counts how often it is asked."""

    def __init__(self):
        self.rows, self.calls = {}, Counter()

    def getMapState(self, *_):
        return self

    def iterator(self):
        self.calls["iterator"] += 1
        return iter(self.rows.items())

    def containsKey(self, key):
        self.calls["containsKey"] += 1
        return key in self.rows

    def getValue(self, key):
        self.calls["getValue"] += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls["updateValue"] += 1
        self.rows[key] = value

    def registerTimer(self, at):
        self.calls["registerTimer"] += 1


def test_state_is_read_once_and_written_once_a_store():
    n = 500
    events = pd.DataFrame({"job_id": 1, "seq": range(n), "ts": pd.to_datetime(range(n), unit="s"), "website": ["a", "b"] * (n // 2), "kind": "site_finished", "value": [float(i) for i in range(n)]})
    events.loc[n - 1, ["website", "kind"]] = ["c", "site_started"]
    job, handle = results.JobRows(["a", "b", "c"], 1000), Handle()
    job.init(handle)
    (out,) = job.handleInputRows((1,), iter([events]), None)
    assert out[["website", "seq", "value"]].values.tolist() == [["a", n - 2, n - 2.0], ["b", n - 3, n - 3.0]]
    assert handle.rows[("c",)] == (n - 1, "Running", None, (n - 1) * 1000 + 1000)
    assert handle.calls == {"iterator": 1, "updateValue": 3, "registerTimer": 1}
