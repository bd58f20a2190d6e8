"""Approximate nearest neighbours by low-dimensional stable projections.

Largest inner product becomes least distance by one more coordinate,
``sqrt(M^2 - |x|^2)`` with M the largest norm (0 for queries). Vectors are
projected by a Gaussian matrix to ``PROJECTED`` dimensions. As the Gaussian is
2-stable, the squared projected distance over the squared distance is
chi-square with that many degrees of freedom, so once neighbours have been
verified by growing projected distance up to r, a vector nearer than the k-th
best d found so far has been missed with a chance of ``1 - F(r^2 / d^2)`` at
most. The search stops where that falls to ``MISS``.

The projected space is split by a kd-tree. Its upper levels deal all vectors to
cells: up to ``MOST_CELLS`` by a bounded sample, each of which is split again by
a sample of its own where there are more vectors than these hold. A cell of more
than ``BLOCK_ROWS`` vectors (copies of one vector, say) is dealt on into blocks.
In a block, a kd-tree with leaves of ``LEAF_ROWS`` gives projected neighbours
incrementally.

A query first searches one block of its own cell. The k-th distance found there
bounds, by the same test, which blocks can matter at all; it then goes to
those, and their results are merged. All blocks are indexed, and none is
skipped but by the test. A block is sent to one task, and to another for every
further ``QUERY_ROWS`` queries that visit it.

Vectors are scaled by a power of two to components of one at most, which changes
no product but in its exponent, so that large ones don't overflow on the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chisquare import quantile
from .common import bounded_batches, cut, is_small, sized

PROJECTED = 8
#: Chance for each true neighbour to be missed, at most.
MISS = 0.02
NEAREST = 20
BLOCK_ROWS = 8192
LEAF_ROWS = 64
#: Projected vectors from which a tree of cells is built: the least by hash of the id, at most, and about so many in each cell.
SAMPLE_ROWS = 20_000
#: Cells of a tree, at most. There are two levels of trees, so MOST_CELLS squared cells in all.
MOST_CELLS = 1024
#: Queries that meet a block in one task.
QUERY_ROWS = 4096
SEED = 7
#: Error of a product in single precision, at most, as a share of dimensions times norms.
ROUGH_ERROR = 2.0**-22


def _matrix(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimensions + 1, PROJECTED))


def _split(points: np.ndarray, most_rows: int) -> list[np.ndarray]:
    """Leaves of a kd-tree, as positions: the widest dimension is halved at its median until a leaf is small."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= most_rows:
            leaves.append(at)
            continue
        inside = points[at]
        order = at[np.argsort(inside[:, int(np.argmax(np.ptp(inside, 0)))], kind="stable")]
        todo += [order[len(at) // 2 :], order[: len(at) // 2]]
    return leaves


def _planes(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """An upper tree as nodes (dimension, split, left, right); children below 0 are cell ``-1 - child``."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(at: np.ndarray, share: int) -> int:
        nonlocal made
        inside = points[at]
        if share < 2 or len(at) < 2 or not np.ptp(inside, 0).any():
            made += 1
            return -made
        d = int(np.argmax(np.ptp(inside, 0)))
        split = float(np.median(inside[:, d]))
        low = inside[:, d] < split
        if not low.any():
            split = float(np.min(inside[:, d][inside[:, d] > split]))
            low = inside[:, d] < split
        node = len(nodes)
        nodes.append((d, split, 0, 0))
        left = grow(at[low], share // 2)
        right = grow(at[~low], share - share // 2)
        nodes[node] = (d, split, left, right)
        return node

    grow(np.arange(len(points)), cells)
    return nodes


def _cells(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        node, at = todo.pop()
        d, split, left, right = nodes[node]
        low = points[at, d] < split
        for child, rows in ((left, at[low]), (right, at[~low])):
            if child < 0:
                out[rows] = -1 - child
            elif len(rows):
                todo.append((child, rows))
    return out


def _array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class Block:
    """The vectors of one block under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, largest: float):
        leaves = _split(projected, LEAF_ROWS)
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.rough = self.vectors.astype(np.float32)
        self.ends = np.cumsum([len(x) for x in leaves])
        self.low = np.array([projected[x].min(0) for x in leaves])
        self.high = np.array([projected[x].max(0) for x in leaves])
        self.largest = largest

    def search(self, own: int, query: np.ndarray, projected: np.ndarray, k: int, ratio: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best found; ``bound``: a distance, squared, that is no better than the k-th.

        Products in single precision, with a margin above their error, tell
        which vectors can be among the best; only those are verified in double.
        """
        gap = np.maximum(np.maximum(self.low - projected, projected - self.high), 0)
        near = (gap * gap).sum(1)
        order = np.argsort(near, kind="stable")
        norm = math.sqrt(float(query @ query)) or 1.0
        # rough products are those with the query's direction, which can't underflow
        base, rough, margin = norm**2 + self.largest**2, (query / norm).astype(np.float32), len(query) * (ROUGH_ERROR * self.largest + 1e-38)
        ids, scores, done, least = np.empty(0, np.int64), np.empty(0), 0, -np.inf
        step = 4 if math.isinf(bound) else 32  # a bound from an earlier search needs fewer rounds to tighten
        while done < len(order) and near[order[done]] <= ratio * bound:
            leaves = order[done : done + step]
            leaves = leaves[near[leaves] <= ratio * bound]
            done, step = done + step, step * 4
            at = np.concatenate([np.arange(self.ends[x - 1] if x else 0, self.ends[x]) for x in leaves])
            about = self.rough[at] @ rough
            if len(at) > k + 1:
                least = max(least, float(np.partition(about, -k - 1)[-k - 1]) - margin)
            at = at[~(about < least - margin)]
            found = (self.vectors[at] * query).sum(1)
            other = self.ids[at] != own
            ids, scores = np.concatenate([ids, self.ids[at][other]]), np.concatenate([scores, found[other]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                least = max(least, float(scores.min()) / norm)
                bound = min(bound, base - 2 * float(scores.min()))
        return ids, scores


def _search(k: int, ratio: float, largest: float, width: int, unit: float):
    """Rows sorted by (cell, block, part): the block's vectors (query false) first, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, held = None, None, []
        for b in batches:
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            is_query = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            ids = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            vectors, projected = _array(b.column(5), width), _array(b.column(6), PROJECTED)
            bounds = b.column(7).to_numpy(zero_copy_only=False).astype(np.float64)
            out: list[tuple] = []
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (is_query[1:] != is_query[:-1])) + 1).tolist()] if len(ids) else []
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                if tuple(keys[s]) != key:
                    key, block, held = tuple(keys[s]), None, []
                if not is_query[s]:
                    held.append((ids[s:e], vectors[s:e], projected[s:e]))
                    continue
                if block is None and held:
                    block = Block(*(np.concatenate(x) for x in zip(*held, strict=True)), largest)
                if block is not None:
                    out += [(int(ids[i]), *block.search(int(ids[i]), vectors[i], projected[i], k, ratio, float(bounds[i]))) for i in range(s, e)]
            queries = np.repeat([q for q, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int64)
            found = np.concatenate([x for _, x, _ in out]) if out else np.empty(0, np.int64)
            scores = np.concatenate([x for _, _, x in out]) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(found), pa.array(scores / unit)], ["query_id", "vec_id", "score"])

    return run


def _upper_trees(projected: DataFrame, total: int) -> tuple[list[tuple], dict[int, list[tuple]]]:
    """The tree of cells and, where it has too few, the trees of its cells."""
    sample = projected.select("p").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    wanted = max(1, math.ceil(total / BLOCK_ROWS))
    top = _planes(np.array([r["p"] for r in sample]), min(MOST_CELLS, wanted))
    if wanted <= MOST_CELLS:
        return top, {}

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_cells(_array(b.column(1), PROJECTED), top)), b.column(0), b.column(1)], ["cell", "id", "p"])

    rows = cut(projected.select("id", "p").mapInArrow(celled, "cell bigint, id bigint, p array<double>"))
    sizes = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("of")))

    def split(sample: pd.DataFrame) -> pd.DataFrame:
        nodes = _planes(np.stack(sample.sort_values("id")["p"].to_list()), min(MOST_CELLS, math.ceil(sample["of"].iloc[0] / BLOCK_ROWS)))
        return pd.DataFrame({"cell": sample["cell"].iloc[:1], "nodes": [[list(map(float, n)) for n in nodes]]})

    # there are MOST_CELLS sizes at most; a share by hash, so that no task has to rank a cell
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / F.lit(1 << 30)
    some = rows.join(F.broadcast(sizes), "cell").where((F.col("of") > BLOCK_ROWS) & (place * F.col("of") < SAMPLE_ROWS))
    found = some.groupBy("cell").applyInPandas(split, "cell bigint, nodes array<array<double>>").collect()
    return top, {r["cell"]: [(int(d), x, int(a), int(b)) for d, x, a, b in r["nodes"]] for r in found}


def _dealt(points: np.ndarray, top: list[tuple], lower: dict[int, list[tuple]]) -> np.ndarray:
    """The cell of each projected vector; ``MOST_CELLS`` numbers belong to each cell of the top tree."""
    cells = _cells(points, top)
    out = cells * MOST_CELLS
    for c in np.unique(cells).tolist() if lower else ():
        if c in lower:
            here = np.flatnonzero(cells == c)
            out[here] += _cells(points[here], lower[c])
    return out


def _power(peak: float) -> float:
    """The power of two that brings components of ``peak`` at most to one at most."""
    return 2.0 ** -max(-500, min(500, math.frexp(peak)[1]))


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, miss: float = MISS) -> DataFrame:
    """The ``k`` nearest found of every query among all vectors but its own id.

    Returns ``query_id, rank`` (from 1), ``vec_id, score`` (inner product in
    double precision of the vectors as given), ties to the smaller id. Rows with
    a null id, or with a vector that is null, empty, zero, of another length than
    most, or with null or non-finite components take no part. Repeated rows of
    an id count once, where their vectors differ the largest. Finite vectors of
    any size take part; components below 2^-500 of the largest may count as zero.
    Without queries or vectors the result is empty; other columns are dropped.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    value = F.col(vector_col).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    taking_part = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite

    def measured(df: DataFrame) -> DataFrame:
        peak = F.max(F.array_max(F.transform(value, F.abs))).alias("peak")
        return df.where(taking_part).groupBy(F.size(vector_col).alias("n")).agg(F.count(F.lit(1)).alias("rows"), peak)

    def clean(df: DataFrame, scale: float) -> DataFrame:
        rows = df.where(taking_part).select(F.col(id_col).cast("bigint").alias("id"), value.alias("v")).where(F.size("v") == width)
        return rows.groupBy("id").agg(F.max("v").alias("v")).select("id", F.transform("v", lambda x: x * F.lit(scale)).alias("v"))

    lengths = measured(vectors).orderBy(F.desc("rows"), "n").limit(1).collect()
    width = lengths[0]["n"] if lengths else 0
    asking = measured(queries).where(F.col("n") == width).collect()
    if not lengths or not asking:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    scale, query_scale = _power(lengths[0]["peak"]), _power(asking[0]["peak"])
    points, asked = cut(clean(vectors, scale)), clean(queries, query_scale)
    total, largest = points.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    matrix = _matrix(width)

    def project(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _array(b.column(1), width)
                last = np.zeros(len(v)) if query else np.sqrt(np.maximum(largest**2 - (v * v).sum(1), 0))
                p = np.concatenate([v, last[:, None]], 1) @ matrix
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(p), pa.list_(pa.float64()))], ["id", "v", "p"])

        return run

    ddl = "id bigint, v array<double>, p array<double>"
    projected = points.mapInArrow(project(False), ddl)
    top, lower = _upper_trees(projected, total)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_dealt(_array(b.column(2), PROJECTED), top, lower))], ["id", "v", "p", "cell"])

    ddl += ", cell bigint"
    points = cut(projected.mapInArrow(celled, ddl))
    asked = cut(asked.mapInArrow(project(True), "id bigint, v array<double>, p array<double>").mapInArrow(celled, ddl))
    # a row for each cell, of which there are MOST_CELLS squared at most
    size = lambda side, f: [f(F.col("p")[i]).alias(f"{side}{i}") for i in range(PROJECTED)]
    boxes = cut(points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), *size("low", F.min), *size("high", F.max)))
    few = is_small(boxes)
    found = boxes.orderBy("cell").toArrow().to_pandas()
    cells, blocks = found["cell"].to_numpy(np.int64), found["blocks"].to_numpy(np.int64)
    low, high = (found[[f"{side}{i}" for i in range(PROJECTED)]].to_numpy(float) for side in ("low", "high"))
    tops, starts = np.unique(cells // MOST_CELLS, return_index=True)
    ends = np.append(starts[1:], len(cells))
    top_low, top_high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    ratio = quantile(1 - miss, PROJECTED)

    def in_blocks(df: DataFrame, salt: int) -> DataFrame:
        """Rows of cells that have vectors, each with a block of its cell."""
        return df.join(sized(boxes.select("cell", "blocks"), few), "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")))

    indexed = in_blocks(points, 1).select("cell", "block", F.lit(False).alias("query"), "id", "v", "p", F.lit(0.0).alias("bound"))
    rows = ["cell", "block", "part", "query", "id", "v", "p", "bound"]

    def searched(visits: DataFrame) -> DataFrame:
        loads = visits.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
        loads = cut(loads)
        few = is_small(loads)
        asking = visits.join(sized(loads, few), ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(4)), F.col("parts")).cast("int"))
        sent = loads.select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = indexed.join(sized(sent, few), ["cell", "block"]).select(*rows).unionByName(asking.select(*rows))
        dealt = met.repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "query", "id")
        return dealt.mapInArrow(_search(k, ratio, largest, width, scale * query_scale), "query_id bigint, vec_id bigint, score double")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks whose box is within the reach that the first search leaves."""
        for b in batches:
            p, kth, v = _array(b.column(2), PROJECTED), b.column(3).to_numpy(zero_copy_only=False).astype(float) * (scale * query_scale), _array(b.column(1), width)
            bound = np.where(np.isnan(kth), np.inf, np.maximum((v * v).sum(1) + largest**2 - 2 * kth, 0)) * (1 + 1e-9)
            who, cell, block = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(len(p)):
                near = lambda low, high: (np.maximum(np.maximum(low - p[i], p[i] - high), 0) ** 2).sum(1) <= ratio * bound[i]  # noqa: B023, E731
                at = np.concatenate([np.arange(starts[t], ends[t]) for t in np.flatnonzero(near(top_low, top_high))] or [np.empty(0, np.int64)])
                at = at[near(low[at], high[at])]
                n = blocks[at]
                who.append(np.full(n.sum(), i))
                cell.append(np.repeat(cells[at], n))
                block.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            who, cell, block = map(np.concatenate, (who, cell, block))
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(bound[who]), pa.array(cell), pa.array(block)], ["id", "v", "p", "bound", "cell", "block"])

    query, far = F.lit(True).alias("query"), F.lit(float("inf")).alias("bound")
    first = searched(in_blocks(asked, 2).select("cell", "block", query, "id", "v", "p", far))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    bounded = asked.join(kth, "id", "left").select("id", "v", "p", "kth")
    visits = cut(bounded.mapInArrow(routed, "id bigint, v array<double>, p array<double>, bound double, cell bigint, block bigint").withColumn("query", query))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = searched(visits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
