"""Counts of stages and callbacks of streams."""

from pyspark.sql import functions as F

from larkspur.plans.hooks import BatchHooks, Hooks


def test_counts_are_taken_on_the_way(spark):
    seen = Hooks()
    rows = seen.watch(spark.range(10), "read", odd=F.col("id") % 2 == 1)
    few = seen.watch(rows.where("id > 6"), "kept")
    assert few.count() == 3
    assert seen.counts() == {"read": {"rows": 10, "odd": 5}, "kept": {"rows": 3}}
    table = [tuple(r) for r in seen.table(spark).collect()]
    assert table == [(0, "read", "rows", 10), (0, "read", "odd", 5), (1, "kept", "rows", 3)]


def test_callbacks_after_each_batch(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 5 + k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    batches, ends = [], []
    hooks = BatchHooks(lambda k, rows, seen: batches.append((k, rows, seen)), ends.append)
    spark.streams.addListener(hooks)
    try:
        rows = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = rows.observe("store", F.count_if(F.col("id") >= 10).alias("late"))
        query = out.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(hooks)
    some = [b for b in batches if b[1]]
    assert sorted(n for _, n, _ in some) == [5, 6] and sorted(s["store"]["late"] for _, _, s in some) == [0, 6]
    assert ends == [None]
