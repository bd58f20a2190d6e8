"""Near-duplicate documents by SimHash fingerprints and pigeonring filtering.

A fingerprint has 64 bits in a ring of four segments of 16. Two fingerprints
that differ in at most three bits have a segment from which every chain of
consecutive segments stays within its proportional budget: no difference in
the first segment, at most one in the first two, two in the first three and
three in all. The two segments after the first, which differ in two bits at
most, are cut into three parts, of which one is equal then. So each distinct
fingerprint goes into twelve buckets, of a ring position, its segment and one of
the parts after it (2^26 values or more), and pairs of a bucket meet the chain
test, which grows by one segment at a time and drops pairs before the whole
distance is taken.

Copies with the same fingerprint are one node. A bucket gives a spanning forest
of its links, never all of its pairs, and a bucket of more than ``BLOCK``
fingerprints is compared block by block in as many tasks as it has pairs of
blocks, so that neither a task nor the output grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlap
from .common import bounded_batches, cut, fresh, is_small, numbered, sized, written
from .graph import components

WORDS_PER_SHINGLE = 3
MOST_DIFFERENT_BITS = 3
SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Bits of the parts that the two segments after the first are cut into, and where a bucket's number has its ring position.
PARTS, START_SHIFT = (11, 11, 10), 30
#: Fingerprints of a bucket that are compared in one task.
BLOCK = 4096
#: Groups up to this size are compared together, many groups at a time.
SMALL = 32
#: Hashes whose bits are counted at a time, for bounded memory.
HASHES_AT_ONCE = 1 << 15


def fingerprint(text: bytes, words_per_shingle: int = WORDS_PER_SHINGLE, seed: int = SEED) -> int:
    """The SimHash of UTF-8 text as a signed 64-bit integer; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        spans = [(0, len(joined))]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        spans = list(zip((ends - sizes)[: 1 - words_per_shingle].tolist(), ends[words_per_shingle - 1 :].tolist(), strict=True))
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(spans), HASHES_AT_ONCE):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in spans[i : i + HASHES_AT_ONCE]])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big", signed=True)


def set_fingerprint(hashes: np.ndarray) -> int | None:
    """The SimHash of a set of 64-bit hashes (uint64) as a signed 64-bit integer; none for the empty set."""
    if not len(hashes):
        return None
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        ones += np.unpackbits(hashes[i : i + HASHES_AT_ONCE].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (bigint) for each row; a null text counts as one without words."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary")).mapInArrow(run, f"`{id_col}` {id_type}, fp bigint")


def _within_chain(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which differences ``x`` (uint64) pass all chains that begin at the segments ``first``."""
    at, total = np.arange(len(x)), np.zeros(len(x), np.uint8)
    for step in range(SEGMENTS):
        shift = ((first[at] + step) % SEGMENTS * SEGMENT_BITS).astype(np.uint64)
        total = total + np.bitwise_count((x[at] >> shift) & np.uint64((1 << SEGMENT_BITS) - 1))
        keep = total <= (step + 1) * MOST_DIFFERENT_BITS // SEGMENTS
        at, total = at[keep], total[keep]
    return at


def _small_groups(group: np.ndarray, first: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal ``group``, all runs at a time, by growing distance in the order."""
    for lag in range(1, SMALL):
        i = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(i):
            return
        i = i[_within_chain(fp[i] ^ fp[i + lag], first[i])]
        if len(i):
            yield fp[i], fp[i + lag]


def _large_group(first: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one group."""
    label, out = np.arange(len(fp)), []
    for i in range(len(fp) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1  # pairs already connected need no check
        if not len(rest):
            continue
        x = fp[rest] ^ fp[i]
        near = rest[_within_chain(x, np.full(len(rest), first))]
        if len(near):
            others, where = np.unique(label[near], return_index=True)
            out += [(i, j) for j in near[where].tolist()]
            label[np.isin(label, others)] = label[i]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return fp[pairs[:, 0]], fp[pairs[:, 1]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to links; a cell that a batch cuts off waits for the next batch."""

    def links(cell: np.ndarray, first: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
        sizes = np.diff(np.r_[starts, len(cell)])
        group = np.repeat(np.arange(len(starts)), sizes)
        small = (sizes <= SMALL)[group]
        found = list(_small_groups(group[small], first[small], fp[small]))
        found += [_large_group(int(first[s]), fp[s : s + n]) for s, n in zip(starts, sizes, strict=True) if n > SMALL]
        for u, v in found:
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    rest = np.empty((0, 4), np.int64)
    for b in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)])
        if not len(rows):
            continue
        same = (rows[:, :3] == rows[-1, :3]).all(1)
        n = len(rows) if not same.any() else int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        rest = rows[n:]
        if n:
            yield from links(rows[:n, :3], rows[:n, 0] >> START_SHIFT, np.ascontiguousarray(rows[:n, 3]).view(np.uint64))
    if len(rest):
        yield from links(rest[:, :3], rest[:, 0] >> START_SHIFT, np.ascontiguousarray(rest[:, 3]).view(np.uint64))


def _keys() -> list[Column]:
    """The buckets of ``fp``: a ring position, its segment, and one of three parts of the two segments that follow."""
    keys = []
    for i in range(SEGMENTS):
        low, high = F.shiftrightunsigned("fp", i * SEGMENT_BITS), F.shiftleft("fp", 64 - i * SEGMENT_BITS)
        turned = low.bitwiseOR(high) if i else F.col("fp")
        own, at = turned.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)), SEGMENT_BITS
        for k, bits in enumerate(PARTS):
            part = F.shiftrightunsigned(turned, at).bitwiseAND(F.lit((1 << bits) - 1))
            keys.append(F.lit(i << START_SHIFT | k << START_SHIFT - 2).bitwiseOR(F.shiftleft(part, SEGMENT_BITS)).bitwiseOR(own))
            at += bits
    return keys


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints ``(fp bigint)`` to links ``(u, v)`` with the same components as all links."""
    rows = fps.select("fp", F.explode(F.array(*_keys())).alias("bucket"))
    blocks = cut(rows.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    cells = rows.join(sized(blocks, is_small(blocks)), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = cells.select("bucket", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    dealt = cells.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "fp")
    return dealt.select("bucket", F.col("a").cast("bigint"), F.col("b").cast("bigint"), "fp").mapInArrow(_forests, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and near-duplicate group of every row.

    Returns ``id_col``, ``fp`` (bigint) and ``component`` (the smallest id
    reachable through links, the row's own included). Null and empty texts have
    fingerprint zero and link like any other. A row with a null id takes part
    and has its group's smallest other id, or null where there is none.
    Repeated rows are all returned; texts of any length count as a whole; an
    empty table gives an empty table; other columns are dropped.
    """
    own = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    nodes = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    label = components(links(own.select("fp").distinct()))
    nodes = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = nodes.groupBy("label").agg(F.min("least").alias("component"))
    return own.join(nodes.join(smallest, "label").select("fp", "component"), "fp").select(id_col, "fp", "component")


def near_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes(node, fp)``, null for no fingerprint, to links ``(u, v)`` of nodes whose fingerprints link or are equal."""
    named = nodes.where("fp IS NOT NULL").select("node", "fp")
    own = cut(named.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")))
    one, two = (own.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "uv")
    apart = links(own.select("fp")).join(one, "u").join(two, "v").select(F.col("least_u").alias("u"), F.col("least_v").alias("v"))
    same = named.join(own.where("least <> most"), "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return apart.unionByName(same)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less all but one row of each near-duplicate group.

    Texts get the SimHash of their set of five-word shingles; pigeonring filtering
    links fingerprints as in ``near_duplicates``, and what is linked are candidates.
    Pairs of similarity 0.8 may differ in more bits than that, so min-hash bands add
    candidates. Groups are those of ``overlap``: candidates whose sets have
    a Jaccard similarity of 0.8 or more, and what they reach. Null and empty texts
    have no words and are one group. The row with the group's smallest id stays
    (one with a null id only where the group has no other); of repeated rows of
    that id, one. An empty table gives an empty table; columns may have any names;
    texts of any length count as a whole.

    Rows are numbered and written once; what stays is settled on numbers. Texts
    of candidates are fetched, and other rows dropped, by their numbers: from a
    broadcast of the numbers where these are few (``NUMBERS``), else through one
    shuffle, where the numbers are the side that is held in memory.
    """
    bounded_batches(docs.sparkSession)
    at, node, fp, bands, row = docs.columns.index(text_col), *(fresh(docs, f"__{c}") for c in ("node", "fp", "bands", "row"))
    marked = docs.withColumn(node, F.lit(0).cast("bigint")).withColumn(fp, F.lit(None).cast("bigint")).withColumn(bands, F.array().cast("array<bigint>")).schema
    columns = marked.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, fps, keys = [], [], []
            for t in b.column(at):
                own = overlap.shingles((t.as_py() or "").encode())
                names.append(overlap.node(own))
                fps.append(set_fingerprint(own))
                keys.append(overlap.bands(own))
            offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64()), pa.array(fps, pa.int64()), lists], names=columns)

    own = written(docs.mapInArrow(run, marked).withColumn(row, F.monotonically_increasing_id()), "marked")
    ids = own.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(node).alias("node"), F.col(fp).alias("fp"), F.col(bands).alias("bands"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    nodes = cut(ids.groupBy("node").agg(first, F.min("fp").alias("fp")))
    texts = own.select(F.col(row).alias("row"), F.col(text_col).cast("binary").alias("text"))
    groups = components(overlap.links(ids.select("node", "bands"), nodes.select("node", "first.row"), texts, near_nodes(nodes)))
    label = nodes.join(groups, "node", "left").select("first", F.coalesce("label", "node").alias("label"))
    stays = label.groupBy("label").agg(F.min("first").alias("first")).select("first.row")
    goes = cut(own.select(F.col(row).alias("row")).join(stays, "row", "left_anti"))
    return own.join(numbered(goes), own[row] == goes["row"], "left_anti").select(*docs.columns)
