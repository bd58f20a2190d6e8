"""Progress of search jobs from their events, as a stream and in batch.

Events are ``job_id, seq, ts, website, kind, got_price``; kinds are start,
site_started, site_finished, recheck, recheck_site, wrapping_up and done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..functions.text import C, col

# Percent of stages that do not depend on stores.
STAGE_PERCENT = {"start": 0, "recheck": 82, "recheck_site": 88, "wrapping_up": 95, "done": 100, "error": 100}
# Percent with which a store's stages begin.
STORE_BASE = {"site_started": 5, "site_finished": 10}
# How stores are called.
STORE_NAMES = {"Amazon.com": "Amazon", "Walmart.com": "Walmart", "BestBuy.com": "Best Buy", "Newegg.com": "Newegg"}


def percent(kind: C, done: C, total: C) -> Column:
    share = F.floor(col(done) * 70 / F.greatest(col(total), F.lit(1)))
    p = F.when(col(kind) == "site_started", STORE_BASE["site_started"] + share).when(col(kind) == "site_finished", STORE_BASE["site_finished"] + share)
    for k, v in STAGE_PERCENT.items():
        p = p.when(col(kind) == k, v)
    return F.greatest(F.lit(0), F.least(F.lit(100), p)).cast("int")


def store(website: C) -> Column:
    names = F.create_map(*(F.lit(x) for pair in STORE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, col(website)), F.replace(col(website), F.lit(".com"), F.lit("")))


def message(kind: C, website: C, got_price: C, success: C, total: C) -> Column:
    name = store(website)
    k = col(kind)
    done = F.when(col(success) == 0, "Search finished, but we couldn't find prices on any store.").when(col(success) == col(total), "All done! Here is your comparison.")
    done = done.otherwise(F.format_string("All done! We found prices on %d of %d stores.", col(success), col(total)))
    return (
        F.when(k == "start", "Starting your search…")
        .when(k == "all_started", "Checking prices on Amazon, Walmart, Best Buy, and Newegg…")
        .when(k == "site_started", F.concat(F.lit("Checking "), name, F.lit("…")))
        .when(k == "site_finished", F.concat(F.lit("Finished with "), name, F.when(col(got_price), " — found a price.").otherwise(" — no price found this time.")))
        .when(k == "recheck", F.concat(F.lit("Some prices look very different. Checking again: "), name, F.lit(".")))
        .when(k == "recheck_site", F.concat(F.lit("Checking "), name, F.lit(" again…")))
        .when(k == "wrapping_up", "Putting your table together…")
        .when(k == "done", done)
    )


def progress(events: DataFrame, total: int = len(fixed.RETAILERS)) -> DataFrame:
    """Percent after each event, in batch: a running count of finished stores for each job."""
    so_far = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    done = F.sum((F.col("kind") == "site_finished").cast("int")).over(so_far)
    return events.withColumn("done", done).withColumn("percent", percent("kind", "done", F.lit(total)))


def latest(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")


def revealed(events: DataFrame, keys: list[str], order: str, until) -> DataFrame:
    """The events of all keys whose first one came by ``until``, as a recorded run shows them at that time."""
    shown = events.groupBy(*keys).agg(F.min(order).alias("__at")).where(F.col("__at") <= until)
    return events.join(shown, keys, "left_semi")


def joined_names(rows: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """The names of each key in one line, in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, name)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x[name]), ", ").alias("names"))


def timed_out(elapsed: C, limit_s: int = fixed.SITE_TIMEOUT_S) -> Column:
    return F.when(col(elapsed) > limit_s, "Failed").otherwise("Success")


def streamed_progress(events: DataFrame, total: int = len(fixed.RETAILERS), timeout_ms: int = fixed.SITE_TIMEOUT_S * 1000) -> DataFrame:
    """Percent of each job as its events arrive: state is the count of finished stores, dropped when a job ends or stalls."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (done,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "seq": [-1], "done": [done], "percent": [100]})
            return
        (done,) = state.get if state.exists else (0,)
        seq = pct = 0
        for batch in batches:
            kinds = batch.sort_values("seq")["kind"]
            finished = done + (kinds == "site_finished").cumsum()
            telling = kinds[kinds.isin([*STAGE_PERCENT, *STORE_BASE])]
            if len(telling):
                kind, so_far = telling.iloc[-1], int(finished[telling.index[-1]])
                pct = STAGE_PERCENT[kind] if kind in STAGE_PERCENT else min(100, STORE_BASE[kind] + so_far * 70 // max(total, 1))
            done, seq = int(finished.iloc[-1]), max(seq, int(batch["seq"].max()))
        if pct >= 100:
            if state.exists:
                state.remove()
        else:
            state.update((int(done),))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"job_id": [key[0]], "seq": [seq], "done": [int(done)], "percent": [int(pct)]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, seq bigint, done int, percent int", "done int", "update", GroupStateTimeout.ProcessingTimeTimeout)
