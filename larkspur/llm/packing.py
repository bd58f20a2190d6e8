"""Batches of similar length: optimal buckets from the global histogram of lengths.

Lengths are counted over all rows. Dynamic programming over that histogram
chooses the bucket tops that minimise padding in total, and batches within a
token budget form inside each bucket.

The histogram is exact: one entry for each length that occurs, so it has no more
entries than the longest text has words, whatever the number of texts. The
program takes one step for each entry and bucket. Batches are dealt by position
within the bucket. Positions come from per-chunk row numbers and the chunks'
running counts, so no task holds a bucket, whatever share of the rows it has.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Rows of a bucket that are numbered together.
CHUNK_ROWS = 50_000
WORD = "[^\\x20\\x09-\\x0D]+"


def n_tokens(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def optimal_tops(tops: list[int], counts: list[int], buckets: int) -> list[int]:
    """The bucket tops, a subset of ``tops``, with the least padding in total.

    ``tops`` ascend, each with the count (1 or more) of rows of that length.
    Padding is the bucket's top less a row's own length; as the own lengths sum
    to the same whatever the tops are, the sum of the tops over all rows is
    minimised. The cost of a last bucket that begins after ``i`` lengths is a line
    in its top, with a slope that falls with ``i``; tops ascend, so the least line
    is found on the lower hull by a pointer that only moves on.
    """
    n = len(tops)
    if n <= buckets:
        return list(tops)
    before = [0, *accumulate(counts)]
    best: list[int | None] = [0] + [None] * n
    choice = np.zeros((buckets + 1, n + 1), np.int32)
    for b in range(1, buckets + 1):
        now: list[int | None] = [None] * (n + 1)
        hull: list[int] = []
        at = 0
        for j in range(b, n + 1):
            if (new := j - 1) == 0 or b > 1:  # the first bucket begins with the first length
                while len(hull) - at >= 2 and (best[new] - best[hull[-2]]) * (before[hull[-1]] - before[hull[-2]]) <= (best[hull[-1]] - best[hull[-2]]) * (before[new] - before[hull[-2]]):
                    hull.pop()
                hull.append(new)
            top = tops[j - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] - top * before[hull[at + 1]] < best[hull[at]] - top * before[hull[at]]:
                at += 1
            now[j], choice[b, j] = best[hull[at]] + top * (before[j] - before[hull[at]]), hull[at]
        best = now
    out, j = [], n
    for b in range(buckets, 0, -1):
        out.append(tops[j - 1])
        j = int(choice[b, j])
    return out[::-1]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Deal every row into a batch.

    Returns ``id_col, n_tokens, bucket`` (from 0), ``padded_to, batch`` (within
    the bucket, from 0) and ``slot`` (within the batch, from 0). A batch has
    ``token_budget div padded_to`` rows, at least one, so a row beyond the budget
    is alone. Null and empty texts have length 0. Null ids, repeated rows and rows
    of one length are dealt like others; an empty table gives an empty table;
    other columns are dropped. Which rows share a batch follows the input's order;
    bucket and batch sizes don't. To the driver come the lengths that occur.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), n_tokens(text_col).alias("n"), F.monotonically_increasing_id().alias("row")))
    cells = sorted((c["n"], c["rows"]) for c in rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect())
    tops = optimal_tops([t for t, _ in cells], [c for _, c in cells], buckets) or [0]
    totals = [0] * len(tops)
    for t, c in cells:
        totals[int(np.searchsorted(tops, t))] += c
    array = lambda xs: F.array(*(F.lit(int(x)).cast("bigint") for x in xs))
    bucket = F.size(F.filter(array(tops), lambda t: t < F.col("n")))
    chunks = array([-(-t // CHUNK_ROWS) or 1 for t in totals])
    dealt = rows.withColumn("bucket", bucket).withColumn("chunk", F.pmod(F.xxhash64("row"), F.get(chunks, F.col("bucket"))))
    offsets = dealt.groupBy("bucket", "chunk").count()
    until = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("bucket", "chunk", F.coalesce(F.sum("count").over(until), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("row")) - 1
    placed = dealt.withColumn("within", within).join(offsets, ["bucket", "chunk"])
    placed = placed.withColumn("padded_to", F.get(array(tops), F.col("bucket"))).withColumn("at", F.col("offset") + F.col("within"))
    size = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("bigint")
    return placed.withColumn("size", size).select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "bucket", "padded_to", F.floor(F.col("at") / F.col("size")).alias("batch"), (F.col("at") % F.col("size")).alias("slot")
    )
