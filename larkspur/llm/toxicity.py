"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded, class-balanced sample of labelled texts gives the examples, and all of
their words are terms. A term weighs its frequency in the text, its inverse
document frequency over all texts and its association with the label: the square
root of its chi-square statistic, which is near zero for most words but leaves none
out. (Without it neighbours share subject and language, not tone.) Copies among
the examples say nothing new about a term, so association counts clusters of
examples whose MinHash signatures agree, not examples.

The examples' vectors form a block-max inverted index. Terms of few examples have
lists of postings, which a query reads as a whole. Terms of many have a weight for
every example, and the largest weight in each block of examples. What the lists
add up to and those largest weights bound a block's cosines; a query visits
blocks by falling bound and stops when no bound reaches its k-th best cosine, so
what it returns is exact. An example whose text is the query's own is left out.

Neighbours vote by their cosine; isotonic regression on left-out votes of the
examples, weighted to the labels' real frequency, turns votes into scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

#: Labelled texts of each class that the classifier is fitted on, at most; the least by hash.
EXAMPLES_PER_CLASS = 1000
#: MinHash signatures of examples: their length, and the equal places from which two are copies (about 0.5 similar).
SIGNATURE, ALIKE = 16, 8
_MULTIPLIERS = [2 * int.from_bytes(xxhash.xxh64_digest(bytes([i])), "big") % (1 << 64) | 1 for i in range(SIGNATURE)]
BLOCK = 64
NEIGHBOURS = 15
#: Weight of the average when a share is estimated from few examples.
PRIOR_WEIGHT = 2.0

#: Share of the examples from which a term's weights are kept by block.
MANY = 1 / 16

_BREAKS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words_of(text: str) -> list[bytes]:
    """Lower-case words of letters, digits and characters beyond ASCII."""
    return text.lower().encode().translate(_BREAKS).split()


class Spotter:
    """Counts the terms of a vocabulary in texts."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary

    def __call__(self, text: str) -> dict[int, int]:
        return self.count(words_of(text))

    def count(self, words: list[bytes]) -> dict[int, int]:
        get, out = self.vocabulary.get, {}
        for w, n in Counter(words).items():
            if (t := get(w)) is not None:
                out[t] = n
        return out


@dataclass
class Index:
    """Block-max inverted index over unit vectors of examples."""

    vocabulary: dict[bytes, int]
    #: Weight of each term: inverse document frequency times association.
    weight: np.ndarray
    examples: list
    labels: np.ndarray
    #: Postings by term: where each term's list begins, the examples, their weights.
    lists: np.ndarray
    owners: np.ndarray
    posted: np.ndarray
    #: Terms of many examples: their row (or -1) by term, the weights by row, block and place in it, and the largest of each block.
    row: np.ndarray
    wide: np.ndarray
    most: np.ndarray

    @classmethod
    def build(cls, vocabulary: dict[bytes, int], weight: np.ndarray, examples: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        n, empty = len(vectors), np.zeros(0)
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in vectors])
        term, w = (np.concatenate([v[k] for v in vectors]) if n else empty for k in (0, 1))
        term = term.astype(np.int64)
        many = np.bincount(term, minlength=len(weight)) > max(1, MANY * n)
        row = np.where(many, np.cumsum(many) - 1, -1)
        wide, some = np.zeros((int(many.sum()), -(-n // BLOCK), BLOCK)), many[term]
        wide[row[term[some]], owner[some] // BLOCK, owner[some] % BLOCK] = w[some]
        order = np.flatnonzero(~many[term])[np.argsort(term[~many[term]], kind="stable")]
        lists = np.r_[0, np.cumsum(np.bincount(term[order], minlength=len(weight)))]
        return cls(vocabulary, weight, examples, labels, lists, owner[order], w[order], row, wide, wide.max(2))

    @property
    def vectors(self) -> list[dict[int, float]]:
        out: list[dict[int, float]] = [{} for _ in self.examples]
        for t, r in enumerate(self.row.tolist()):
            if r >= 0:
                for i, w in enumerate(self.wide[r].ravel().tolist()):
                    if w:
                        out[i][t] = w
            for k in range(self.lists[t], self.lists[t + 1]):
                out[self.owners[k]][t] = float(self.posted[k])
        return out

    def _vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        return _unit(counts, self.weight)

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        at, v = self._vector(counts)
        return dict(zip(at.tolist(), v.tolist(), strict=True))

    def _nearest(self, at: np.ndarray, v: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        n = len(self.examples)
        if not len(at) or not n:
            return []
        begin, sizes = self.lists[at], self.lists[at + 1] - self.lists[at]
        place = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        cosines = np.bincount(self.owners[place], self.posted[place] * np.repeat(v, sizes), self.most.shape[1] * BLOCK).astype(float).reshape(-1, BLOCK)
        if without >= 0:
            cosines[without // BLOCK, without % BLOCK] = -np.inf
        rows = self.row[at]
        rows, v = rows[rows >= 0], v[rows >= 0]
        bounds = cosines.max(1) + v @ self.most[rows]
        order, least = np.argsort(-bounds, kind="stable"), 0.0
        owners, scores, done, step = np.empty(0, np.int64), np.empty(0), 0, 2
        while done < len(order) and bounds[order[done]] > 0 and bounds[order[done]] >= least - 1e-12:
            some = order[done : done + step]
            some = np.sort(some[bounds[some] >= least - 1e-12])
            done, step = done + step, len(order)
            who = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = cosines[some].ravel() + v @ self.wide[rows[:, None], some].reshape(len(rows), len(who))
            hit = np.flatnonzero(found > max(least - 1e-12, 0))
            owners, scores = np.concatenate([owners, who[hit]]), np.concatenate([scores, found[hit]])
            best = np.lexsort((owners, -scores))[:k]
            owners, scores = owners[best], scores[best]
            least = float(scores[-1]) if len(scores) == k else 0.0
        return list(zip(scores.tolist(), owners.tolist(), strict=True))

    def nearest(self, query: dict[int, float], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of largest positive cosine, ties to the earlier one: (cosine, example)."""
        at = np.array(sorted(query), np.int64)
        return self._nearest(at, np.array([query[t] for t in at.tolist()], float), k, without)

    def nearest_to(self, counts: dict[int, int], without: int = -1) -> list[tuple[float, int]]:
        return self._nearest(*self._vector(counts), NEIGHBOURS, without)


def _unit(counts: dict[int, int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms, ascending, and their share in the unit vector of a text."""
    at, n = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
    order = np.argsort(at)
    return _scaled(at[order], n[order], weight)


def _scaled(at: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = (1 + np.log(n)) * weight[at]
    norm = math.sqrt(float(v @ v))
    return (at, v / norm) if norm else (at[:0], v[:0])


def text_hash(words: list[bytes]) -> int:
    """Names a text for the purpose of leaving it out as its own neighbour."""
    return xxhash.xxh64_intdigest(b" ".join(words))


@dataclass
class Model:
    index: Index
    #: Votes and the share of toxic texts at each; rising.
    votes: np.ndarray
    shares: np.ndarray
    #: Share among texts without any term of weight.
    silent: float
    #: The first example of each text, by ``text_hash``.
    own: dict[int, int]

    def neighbours(self, text: str, spot: Spotter) -> list[tuple[float, int]]:
        words = words_of(text)
        return self.index.nearest_to(spot.count(words), self.own.get(text_hash(words), -1))

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.silent
        vote = _vote(near, self.index.labels)
        return float(0.999 * np.interp(vote, self.votes, self.shares) + 0.001 * vote)


def _signature(words: set[bytes]) -> list[int]:
    """Minima of ``SIGNATURE`` hash functions over a text's words."""
    if not words:
        return [0] * SIGNATURE
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    return [int((hashes * np.uint64(m) >> np.uint64(1)).min()) for m in _MULTIPLIERS]


def _clusters(signatures: dict) -> dict:
    """Ids to cluster numbers; ids whose signatures agree in ``ALIKE`` places share one."""
    ids, parent = sorted(signatures), {}
    table = np.array([signatures[i] for i in ids], np.int64).reshape(-1, SIGNATURE)

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for k in range(len(ids)):
        for j in (np.flatnonzero((table[k + 1 :] == table[k]).sum(1) >= ALIKE) + k + 1).tolist():
            a, b = root(k), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(k) for k, i in enumerate(ids)}


def _vote(near: list[tuple[float, int]], labels: np.ndarray) -> float:
    return sum(s * labels[i] for s, i in near) / sum(s for s, _ in near)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted shares of ``y`` that rise with ``x``, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value in np.unique(x):
        here = x == value
        pools.append([value, value, float((y * w)[here].sum()), float(w[here].sum())])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return np.array([v for p in pools for v in p[:2]]), np.array([p[2] / p[3] for p in pools for _ in (0, 1)])


def learnable(doc_id: Column) -> Column:
    """Whether a row's label may be learned from: crc32 of its id as text is no multiple of 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples_per_class: int = EXAMPLES_PER_CLASS) -> Model:
    """Fit on labelled rows that may be learned from; an id with several labels counts as its largest.

    Null ids and labels are left out, and labels of ids that ``docs`` lacks; of
    several rows of an id a word's largest count is taken; a null text is empty.
    Without examples all scores are equal. Document frequencies cover all of
    ``docs``. To the driver come the ids, labels and words of
    ``2 * examples_per_class`` texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learnable(F.col(id_col)))
    known = cut(known.groupBy(id_col).agg(F.max((F.col(label_col) == 1).cast("int")).alias("label")))
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64(id_col), id_col).limit(examples_per_class) for c in (0, 1)]
    label_of = {r[0]: r["label"] for r in chosen[0].unionByName(chosen[1]).collect()}
    id_type = known.schema[id_col].dataType.simpleString()
    table = spark.createDataFrame(list(label_of.items()), f"id {id_type}, label int")

    def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Counter(all_words := words_of(text))
                marks = [*_signature(set(words)), text_hash(all_words) - (1 << 63)]
                columns = [pa.array([i] * (len(words) + 1), b.column(0).type), pa.array(["", *(w.decode() for w in words)], pa.string()), pa.array([0, *words.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([marks, *[None] * len(words)], pa.list_(pa.int64()))], ["id", "term", "n", "marks"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the chosen ids are bounded by examples_per_class, so their table may be broadcast
    labelled = texts.join(F.broadcast(table), "id", "left_semi").select("id", "text")
    found = cut(labelled.mapInArrow(counted_words, f"id {id_type}, term string, n bigint, marks array<bigint>").groupBy("id", "term").agg(F.max("n").alias("n"), F.max("marks").alias("marks")))
    marks = {r["id"]: r["marks"] for r in found.where("term = ''").select("id", "marks").collect()}
    examples = sorted(marks)
    # words stay in arrays, so that the driver holds them once and gives them back
    words = found.where("term <> ''").select("id", "term", "n").toArrow().combine_chunks()
    owner = pc.index_in(words["id"], pa.array(examples, words["id"].type)).to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(words["term"]).combine_chunks()
    coded = coded if isinstance(coded, pa.DictionaryArray) else pa.array([], pa.string()).dictionary_encode()
    spelled = pc.sort_indices(coded.dictionary).to_numpy()
    number = np.empty(len(spelled), np.int64)
    number[spelled] = np.arange(len(spelled))
    vocabulary = {t.encode(): i for i, t in enumerate(coded.dictionary.take(pa.array(spelled)).to_pylist())}
    term, n = number[coded.indices.to_numpy()], words["n"].to_numpy().astype(float)
    del words, coded
    order = np.lexsort((term, owner))
    owner, term, n = owner[order], term[order], n[order]
    label = np.array([label_of[i] for i in examples], np.int64)
    clustered = _clusters({i: m[:-1] for i, m in marks.items()})
    cluster = np.array([clustered[i] for i in examples], np.int64)
    kind = [np.unique((term * len(examples) + cluster[owner])[label[owner] == c]) // max(1, len(examples)) for c in (0, 1)]
    b, a = (np.bincount(k, minlength=len(vocabulary)).astype(float) for k in kind)
    n0, n1 = (len(set(cluster[label == c].tolist())) for c in (0, 1))
    association = np.sqrt((n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(1e-9, n1 * n0 * (a + b) * (n1 + n0 - a - b)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = Counter(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                total.update(vocabulary.keys() & set(words_of(text)))
                texts += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *map(vocabulary.__getitem__, total)], pa.int32()), pa.array([texts, *total.values()], pa.int64())], ["term", "n"])

    counted = texts.select("text").mapInArrow(frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * association
    cuts = np.searchsorted(owner, np.arange(len(examples) + 1)).tolist()
    rows = [(*_scaled(term[x:y], n[x:y], weight), label_of[i], i) for i, x, y in zip(examples, cuts[:-1], cuts[1:], strict=True)]
    # examples of alike strongest terms share a block, which makes block bounds tight
    rows.sort(key=lambda r: (int(r[0][np.argmax(r[1])]) if len(r[0]) else -1, r[2]))
    spoken = [r for r in rows if len(r[0])]
    index = Index.build(vocabulary, weight, [r[3] for r in spoken], np.array([r[2] for r in spoken], float), [r[:2] for r in spoken])
    totals = Counter(label_of[i] for i in examples)
    share_of = {c: size.get(c, 0) / max(1, totals[c]) for c in (0, 1)}
    base = size.get(1, 0) / max(1, sum(size.values()))
    silent = [r[2] for r in rows if not len(r[0])]
    share = (sum(share_of[1] for x in silent if x == 1) + PRIOR_WEIGHT * base) / (sum(share_of[x] for x in silent) + PRIOR_WEIGHT)
    votes = [(_vote(near, index.labels), r[2]) for i, r in enumerate(spoken) if (near := index._nearest(r[0], r[1], NEIGHBOURS, i))]
    if votes:
        x, y = np.array([v for v, _ in votes]), np.array([float(c) for _, c in votes])
        at, shares = _isotonic(x, y, np.array([share_of[c] for _, c in votes]))
    else:
        at, shares = np.array([0.0, 1.0]), np.array([base, base])
    own: dict[int, int] = {}
    for k, i in enumerate(index.examples):
        own.setdefault(marks[i][-1] + (1 << 63), k)
    return Model(index, at, shares, min(share, 1.0), own)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` and ``evidence`` of each row.

    ``evidence`` lists the neighbours: their id, label and cosine. A text
    without terms of weight (a null or empty one too) has no neighbours and the
    score of such labelled texts. Neither id nor other columns affect a score.
    Repeated rows and equal texts score alike; texts of any length are read as a
    whole; an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    evidence = pa.list_(pa.struct([("example", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, spot = model.index.examples, model.index.labels, Spotter(model.index.vocabulary)
        for b in batches:
            near = [model.neighbours(t, spot) for t in b.column(1).to_pylist()]
            shown = [[{"example": str(ids[i]), "label": int(labels[i]), "cosine": s} for s, i in n] for n in near]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(model.score, near)), pa.float64()), pa.array(shown, evidence)], [id_col, "score", "evidence"])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, f"`{id_col}` {id_type}, score double, evidence array<struct<example:string,label:int,cosine:double>>")


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``most``.

    Null, empty, repeated and very long texts are scored as ``score`` does; an
    empty table gives an empty table; columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = Spotter(model.index.vocabulary)
        for b in batches:
            yield b.filter(pa.array([model.score(model.neighbours(t or "", spot)) < most for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
