"""How filters interact: what each removes, by the filters applied before it.

Five filters in any order are 120 ways from the empty set to the set of all of
them, 600 steps in all, but they share the edges of a lattice: 80 pairs of a set
of filters already applied and the filter applied next. Documents are counted by
which filters they fail (32 masks for each part), the masks' counts go onto the
80 edges, and each way takes its five edges from the aggregated ones. So the
number of orders costs nothing for a document.

Four filters look at one text. The fifth asks for an earlier copy of it anywhere
in the table: texts are known by their SHA-256, and rows are added up by digest,
part and labels before they meet, so that a text with a third of all rows is a
few rows when its group is settled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Per cent of the words that are distinct, at least, and of the code points that are capitals, at most.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Rows without an id are dealt by their text into so many parts where ids are joined.
NULL_PARTS = 256


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failed_by_text(text: str) -> int:
    """The filters A to D that a text fails, as bits."""
    raw = text.encode()
    words = raw.split()  # at the six ASCII blanks
    short, repeated = len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return short * _bit("A") | repeated * _bit("B") | loud * _bit("C") | marked * _bit("D")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, part, text`` to ``id, part, mask, digest``."""
    for b in batches:
        texts = b.column(2).to_pylist()
        digests = [sha256(t.encode()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(failed_by_text, texts), pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])


def masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask`` (failed filters as bits, A the lowest) with ``docs``, ``good`` and ``toxic`` documents.

    A null text is empty, a null part the empty string. Rows that repeat an id are
    documents of their own. E fails where the text is that of a smaller id; a null id
    is smaller than none and none is smaller than it. A label counts where any row of
    its id has it; ids without a label count as neither. Empty in, empty out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    bounded_batches(docs.sparkSession)
    read = read.mapInArrow(_read, f"id {read.schema['id'].dataType.simpleString()}, part string, mask int, digest binary")
    rows = read.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    known = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL")
    known = known.groupBy("id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic"))).withColumn("deal", F.lit(0))
    # rows without an id find no label; the second key only spreads them
    rows = rows.withColumn("deal", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_PARTS)).cast("int")).otherwise(0))
    rows = rows.join(known, ["id", "deal"], "left").na.fill(False, ["good", "toxic"])
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id")
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("originals", F.col("without_id") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("originals").alias("docs")),
        F.struct(F.col("mask").bitwiseOR(F.lit(_bit("E"))).alias("mask"), (F.col("n") - F.col("originals")).alias("docs")),
    )
    counted = groups.select("part", "good", "toxic", F.inline(both)).where("docs > 0")
    labelled = lambda c: F.sum(F.when(F.col(c), F.col("docs")).otherwise(0)).alias(c)
    return counted.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), labelled("good"), labelled("toxic"))


def _edge_list() -> Column:
    """The 80 edges: the filters applied already (bits) and the next one."""
    sets = [(f, sum(map(_bit, s))) for f in FILTERS for k in range(len(FILTERS)) for s in combinations(FILTERS.replace(f, ""), k)]
    return F.array(*(F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter"), F.lit(_bit(f)).alias("bit")) for f, s in sets))


def _step_list(spark: SparkSession) -> DataFrame:
    """The 600 steps of all orders, each an edge."""
    rows = [("".join(p), k + 1, sum(map(_bit, p[:k])), p[k]) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter string")


def edges(counts: DataFrame) -> DataFrame:
    """Counts of each part on the 80 edges, from ``masks``: ``part, before, filter`` and what happens to documents there."""
    every = counts.select("*", F.inline(_edge_list()))  # a part has 32 masks at most
    arrives, here = F.col("mask").bitwiseAND(F.col("before")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).alias
    return every.groupBy("part", "before", "filter").agg(
        total("docs", arrives & ~here)("kept"),
        total("docs", arrives & here)("removed"),
        total("docs", ~arrives & here)("redundant"),
        total("docs", F.col("mask") == F.col("bit"))("unique_fails"),
        total("good", arrives & here)("good_lost"),
        total("toxic", arrives & here)("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step; see ``masks`` for what rows count as.

    Columns: ``part`` (string), ``filter_order, step`` (from 1), and counts within the
    part: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``
    (what the step's filter removes, summed over all orders). An empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    part = fresh(docs, "part")
    counts = masks(docs.withColumn(part, F.col(part_col).cast("string")), labels, id_col=id_col, text_col=text_col, part_col=part)
    steps = edges(counts).join(F.broadcast(_step_list(docs.sparkSession)), ["before", "filter"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))
