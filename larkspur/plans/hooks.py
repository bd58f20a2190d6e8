"""What a run does as it does it: counts of each stage without another pass, and callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

METRICS = "position int, stage string, metric string, value bigint"


class Hooks:
    """Counts that are taken while a plan's stages run.

    ``watch`` marks a stage; its counts are there once an action has run over it.
    ``table`` waits for them, so it is read after the plan's last action.
    """

    def __init__(self) -> None:
        self._stages: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """``df`` with the number of its rows, and of those for which each further metric holds, taken on the way."""
        seen = Observation()
        self._stages.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in metrics.items()))

    def counts(self) -> dict[str, dict[str, int]]:
        return {stage: seen.get for stage, seen in self._stages}

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each metric of each stage, in the order of the plan."""
        rows = [(k, stage, metric, int(value or 0)) for k, (stage, found) in enumerate(self.counts().items()) for metric, value in found.items()]
        return spark.createDataFrame(rows, METRICS)


def watched(hooks: Hooks | None, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
    return hooks.watch(df, stage, **metrics) if hooks else df


class BatchHooks(StreamingQueryListener):
    """Calls ``on_batch(batch_id, rows, observed)`` after each batch of a stream, and ``on_end(error)``; ``observed`` has the counts of ``watch`` by name."""

    def __init__(self, on_batch: Callable[[int, int, dict], None], on_end: Callable[[str | None], None] = lambda error: None):
        self.on_batch, self.on_end = on_batch, on_end

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        now = event.progress
        self.on_batch(now.batchId, now.numInputRows, {k: v.asDict() for k, v in (now.observedMetrics or {}).items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.on_end(event.exception)
