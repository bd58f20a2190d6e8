"""Documents whose sets of five-word shingles have a Jaccard similarity of at least four fifths.

Texts with the same set are one node. Links by SimHash, where given, and min-hash
bands propose candidates: nodes that share a band are linked to the least node of it, and the components of
those links are clusters that hold all candidate pairs. A cluster's texts meet
once. There pigeonring filtering prunes pairs: shingles fall into a ring of
segments by their hashes, similar sets differ in at most a ninth of their sizes'
sum, and some segment begins chains of consecutive ones that all differ in no
more than their proportional share. The exact distance of sets decides on what passes. A pair of similarity 0.8
shares one of the ``BANDS`` bands but in 5 of 100,000 cases, a closer pair more
seldom.

A cluster of more than ``BLOCK`` nodes is compared block by block in as many
tasks as it has pairs of blocks, and a cell gives a spanning forest of its
links, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered
from .graph import components

WORDS_PER_SHINGLE = 5
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, BAND_ROWS = 25, 5
#: Nodes of a cluster that are compared in one task.
BLOCK = 512
#: Segments of the ring that shingles fall into by their hashes; a power of two.
SEGMENTS = 16
#: Shingles that are hashed at a time, for bounded memory.
SHINGLES_AT_ONCE = 1 << 11

_rng = np.random.default_rng(42)
_FACTORS, _SHIFTS, _MIX = (_rng.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) for _ in range(3))
_FACTORS, _MIX = _FACTORS | np.uint64(1), _MIX | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes (uint64, sorted) of a text's shingles; a shorter text is one, none has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, k = b" ".join(words), min(WORDS_PER_SHINGLE, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_digest
    spans = zip((ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b]) for a, b in spans]), ">u8").astype(np.uint64))


def node(own: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles; zero for the empty one."""
    return int.from_bytes(xxhash.xxh64_digest(own.tobytes()), "big", signed=True) if len(own) else 0


def bands(own: np.ndarray) -> np.ndarray:
    """The keys (int64) of a set's min-hash bands; none for the empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for i in range(0, len(own), SHINGLES_AT_ONCE):
        least = np.minimum(least, (own[i : i + SHINGLES_AT_ONCE] * _FACTORS[:, None] + _SHIFTS[:, None]).min(1))
    return (least * _MIX).reshape(BANDS, BAND_ROWS).sum(1, dtype=np.uint64).view(np.int64)


def _within_chain(difference: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which rows of differences by segment have a segment all of whose chains stay within their share of ``most``.

    Whatever the order of the segments, a row that sums to ``most`` at most has one.
    """
    ring = np.concatenate([difference, difference[:, :-1]], 1) * SEGMENTS - most[:, None]
    sums = np.concatenate([np.zeros((len(ring), 1), np.int64), np.cumsum(ring, 1)], 1)
    ends = np.lib.stride_tricks.sliding_window_view(sums[:, 1:], SEGMENTS, 1)
    return (ends.max(2) <= sums[:, :SEGMENTS]).any(1)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links between non-empty sets.

    Similar sets differ in a bounded number of shingles. By segment of their
    hashes they differ in as many as their counts do, or more; pairs whose counts
    fail the chain test are dropped before sets are compared.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    everything = np.concatenate(sets)
    tokens = np.unique(everything, return_inverse=True)[1]
    segment = (everything >> np.uint64(64 - SEGMENTS.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(sets)), sizes) * SEGMENTS + segment, minlength=len(sets) * SEGMENTS).reshape(-1, SEGMENTS)
    label, has, out = np.arange(len(sets)), np.zeros(len(tokens), bool), []
    # i / (a + b - i) >= p / q where i * (p + q) >= p * (a + b), and where a + b - 2 * i <= (a + b) * (q - p) / (q + p)
    p, q = LEAST
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        both = sizes[i] + sizes[rest]
        rest = rest[_within_chain(np.abs(counts[rest] - counts[i]), both * (q - p) // (q + p))]
        if not len(rest):
            continue
        has[tokens[starts[i] : starts[i] + sizes[i]]] = True
        common = np.array([np.count_nonzero(has[tokens[starts[j] : starts[j] + sizes[j]]]) for j in rest.tolist()])
        has[tokens[starts[i] : starts[i] + sizes[i]]] = False
        near = rest[(p + q) * common >= p * (sizes[i] + sizes[rest])]
        if len(near):
            others, where = np.unique(label[near], return_index=True)
            out += [(i, j) for j in near[where].tolist()]
            label[np.isin(label, others)] = label[i]
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``label, a, b, node, text`` sorted by cell to links of nodes."""
    cell, nodes, sets = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        found = [(nodes[i], nodes[j]) for i, j in forest(sets)] if len(sets) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    for batch in batches:
        for *at, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != cell:
                yield from links()
                cell, nodes, sets = at, [], []
            nodes.append(name)
            sets.append(shingles(text))
    yield from links()


def links(bands: DataFrame, nodes: DataFrame, texts: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Links ``(u, v)`` with the same components as all links of nodes.

    ``bands(node, bands)`` has any rows; ``nodes(node, row)`` one for each node,
    with the row whose text stands for it in ``texts(row, text binary)``. ``near(u, v)``
    has more candidates: nodes that another method links.
    """
    rows = bands.select("node", F.explode("bands").alias("band")).distinct()
    shared = rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "least")
    candidates = rows.join(shared, "band").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    if near is not None:
        candidates = candidates.unionByName(near)
    clusters = components(candidates)
    # more than one block is rare, so this table is short
    blocks = clusters.groupBy("label").count().where(F.col("count") > BLOCK).select("label", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    chosen = cut(clusters.join(nodes, "node").join(blocks, "label", "left").select("row", "node", "label", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    met = texts.join(numbered(chosen), "row").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = met.select("label", "own", "node", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("label", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "text")
    dealt = cells.repartition("label", "a", "b").sortWithinPartitions("label", "a", "b", "node")
    return dealt.mapInArrow(_forests, "u bigint, v bigint")
