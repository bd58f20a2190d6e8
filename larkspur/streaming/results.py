"""Rows of running jobs as streams: what each store has given so far, and what came too late.

Events are ``job_id, seq, ts, website, kind, value``; kinds are site_started,
site_finished and recheck_site, others are passed over. State is a map for each job,
store to its newest row, and a timer for each store that has started and not
finished.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed

ROWS = "job_id bigint, version bigint, place int, website string, seq bigint, status string, value double"
_NAMES = ["job_id", "version", "place", "website", "seq", "status", "value"]
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNNING, SUCCESS, FAILED = "Running", "Success", "Failed"


@dataclass
class Site:
    """What is known of one store of a job."""

    seq: int
    status: str
    value: float | None
    deadline: int  # milliseconds; 0 where no limit is known

    def started(self, seq: int, deadline: int) -> Site:
        """A start counts once, before the store has given anything; the earliest one sets the limit."""
        if self.status == RUNNING and seq < self.seq:
            return Site(seq, RUNNING, None, deadline)
        return self

    def given(self, seq: int, value: float | None, at: int, again: bool) -> Site:
        """A row: the newest counts. One beyond the limit failed, and after that only a second look counts."""
        late = self.status == RUNNING and bool(self.deadline) and at > self.deadline and not again
        if self.status == FAILED and not again or self.status != RUNNING and seq <= self.seq:
            return self
        return Site(seq, FAILED if late else SUCCESS, None if late else value, self.deadline)


class JobRows(StatefulProcessor):
    """The rows of one job in the order of its stores, all of them whenever one changes."""

    def __init__(self, order: list[str], timeout_ms: int | None):
        self.order, self.timeout_ms = {w: k for k, w in enumerate(order)}, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sites = handle.getMapState("sites", "website string", "seq bigint, status string, value double, deadline bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Events are folded in memory: a job's state is read once and what has changed in it is written once."""
        events = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        before = self._known()
        sites, changed = dict(before), False
        times = events["ts"].astype("datetime64[us]").astype("int64") // 1000
        for website, seq, kind, value, at in zip(*(events[c].tolist() for c in ("website", "seq", "kind", "value")), times.tolist(), strict=True):
            now, value = sites.get(website), None if pd.isna(value) else float(value)
            if kind == "site_started":
                deadline = at + self.timeout_ms if self.timeout_ms else 0
                new = now.started(int(seq), deadline) if now else Site(int(seq), RUNNING, None, deadline)
            elif kind in ("site_finished", "recheck_site"):
                new = (now or Site(-1, RUNNING, None, 0)).given(int(seq), value, at, kind == "recheck_site")
            else:
                continue
            if new != now:
                sites[website] = new
                changed |= new.status != RUNNING
        for website, new in sites.items():
            if new != before.get(website):
                self.sites.updateValue((website,), (new.seq, new.status, new.value, new.deadline))
        # only a store that is still waited for needs its timer
        waiting = {s.deadline for w, s in sites.items() if s.status == RUNNING and s.deadline and s != before.get(w)}
        for deadline in sorted(waiting):
            self.handle.registerTimer(deadline)
        yield self._rows(key, sites) if changed else pd.DataFrame(columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Stores that had until now and gave nothing failed; the job's others go on."""
        until = expiredTimerInfo.getExpiryTimeInMs()
        sites = self._known()
        late = [(w, s) for w, s in sites.items() if s.status == RUNNING and s.deadline <= until]
        for w, s in late:
            sites[w] = Site(s.seq, FAILED, None, s.deadline)
            self.sites.updateValue((w,), (s.seq, FAILED, None, s.deadline))
        yield self._rows(key, sites) if late else pd.DataFrame(columns=_NAMES)

    def _known(self) -> dict[str, Site]:
        return {k[0]: Site(*v) for k, v in self.sites.iterator()}

    def _rows(self, key, sites: dict[str, Site]) -> pd.DataFrame:
        known = sorted(((w, s) for w, s in sites.items() if s.status != RUNNING), key=lambda x: (self.order.get(x[0], len(self.order)), x[0]))
        version = max(s.seq for _, s in known)
        rows = [(int(key[0]), version, k, w, s.seq, s.status, s.value) for k, (w, s) in enumerate(known)]
        return pd.DataFrame(rows, columns=_NAMES).astype({"value": "float64"})

    def close(self) -> None:
        pass


def with_state_in_files(spark: SparkSession) -> None:
    """Keep the state of streams in files, which maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def streamed_rows(events: DataFrame, order: list[str] | None = None, timeout_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Rows ``job_id, version, place, website, seq, status, value`` of every job that a batch changes, in update mode.

    ``version`` is the newest event that counts, ``place`` the store's position among
    those that have given a row. With ``timeout_ms``, a store whose first start was so
    long ago without a row fails when the event time, less ``delay``, passes its
    limit; a row that comes later, in whichever batch, does not count, unless it is of a second look.
    Results do not depend on how events fall into batches.
    """
    with_state_in_files(events.sparkSession)
    order = order or [r[1] for r in fixed.RETAILERS]
    events = events.select("job_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "website", "kind", "value")
    if timeout_ms:
        events = events.withWatermark("ts", delay)
    return events.groupBy("job_id").transformWithStateInPandas(JobRows(order, timeout_ms), ROWS, "Update", "EventTime" if timeout_ms else "None")


def kinds(started: Column) -> Column:
    return F.when(started, "site_started").otherwise("site_finished")
