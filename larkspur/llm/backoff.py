"""Log probabilities of texts by a weighted backoff automaton.

Tokens are the words of a text in lower case and one end. Counts of all n-grams of
the texts that are learned from give a hierarchical Dirichlet model: with a
context's count ``c(h)`` and a weight ``mu``,

    p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu),   h' = h without its first token,

down to single tokens, which are counted with one added to each and to one unknown.
As an automaton, a context that occurs is a state, an n-gram that occurs is an arc
from its context with that probability, and what has no arc goes by the failure arc
to the state of ``h'`` at the price of ``mu / (c(h) + mu)``. A text is read once,
from left to right, by a walk that carries its state (``Automaton.walk``).

The automaton of a corpus grows with it and is never in one place. Texts are dealt
into blocks, tokenised once and written. A block asks for the counts of its distinct
n-grams and gets back what other blocks add to its own; asks are met by hash, each
n-gram once per block, so that no n-gram is hot. With the answers a block has all
arcs and states that its texts can reach, and its walks are those over the whole
automaton. An n-gram of three or more is asked for only where both of its parts are
met in other blocks too.

Words are met by themselves. Longer n-grams are met by 64-bit numbers: among a
billion distinct ones, 0.03 pairs share theirs by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Tokens of the longest n-grams, and the weight of the shorter context in the estimate of the longer.
ORDER, MU = 2, 256.0
#: One in so many ids is held out: those with this remainder.
FOLDS, HELD_OUT = 7, 2
#: Tokens in a block; a longer text is a block of its own.
BLOCK_TOKENS = 1 << 20
#: The end of a text: no word has a blank in it.
END = b" "
#: Parts that asks are dealt into, at least; there are as many as blocks.
LEAST_PARTS = 16

_BLOCK = "block bigint, ids array<bigint>, learned array<boolean>, ends binary, tokens binary, words binary"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("learned", pa.list_(pa.bool_())), ("ends", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary())])
_ASK = "n int, part int, block bigint, keys binary, own binary"
_ASK_ARROW = pa.schema([("n", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("own", pa.binary())])
_ANSWER = "n int, part int, block bigint, more binary, learned bigint, distinct bigint"
_ANSWER_ARROW = pa.schema([("n", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("more", pa.binary()), ("learned", pa.int64()), ("distinct", pa.int64())])


def held_out(id_col: Column) -> Column:
    """Whether an id is held out; null for null."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT


class _Numbers(dict):
    """Numbers of words, in the order in which they come; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, learned, text`` to blocks. ``tokens`` begin with an end, and every text adds its words and an end."""
    task, made = TaskContext.get().partitionId(), 0
    ids, learned, tokens, lengths, numbers = [], [], [], [], _Numbers({END: 0})
    held = 0

    def out() -> pa.RecordBatch:
        row = {
            "block": (task << 32) + made, "ids": ids, "learned": learned, "ends": np.cumsum(lengths, dtype=np.int64).tobytes(),
            "tokens": np.concatenate([np.zeros(1, np.int32), *tokens]).tobytes(), "words": b"\n".join(numbers),
        }
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

    for b in batches:
        for id_, learn, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = text.lower().split()
            tokens.append(np.fromiter(map(numbers.__getitem__, [*words, END]), np.int32, len(words) + 1))
            ids.append(id_)
            learned.append(learn)
            lengths.append(len(words) + 1)
            held += len(words) + 1
            if held >= BLOCK_TOKENS:
                yield out()
                made, held = made + 1, 0
                ids, learned, tokens, lengths, numbers = [], [], [], [], _Numbers({END: 0})
    if ids:
        yield out()


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with all bits mixed."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _packed(counts: np.ndarray) -> bytes:
    """Counts from 0 as integers of the least width that holds them, after one byte that says which."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


@dataclass
class _Grams:
    """The distinct n-grams of one length in a block."""

    at: np.ndarray  #: for each position, the n-gram that ends there, or -1
    first: np.ndarray  #: for each n-gram, a position at which it ends
    key: np.ndarray  #: for each n-gram, its number among all n-grams
    own: np.ndarray  #: for each n-gram, how often texts of the block that are learned from have it


class Block:
    """One block: its texts' tokens and the n-grams in them, numbered alike at every reading."""

    def __init__(self, row: dict):
        self.row, self.words = row, row["words"].split(b"\n")
        self.tokens = np.frombuffer(row["tokens"], np.int32).astype(np.int64)
        self.ends = np.frombuffer(row["ends"], np.int64)  # the position of each text's end
        lengths = np.diff(self.ends, prepend=0)
        self.learned = np.concatenate([[False], np.repeat(np.array(row["learned"], bool), lengths)])
        key = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        at = self.tokens.copy()
        at[0] = -1  # the first end only begins a text
        first = np.zeros(len(self.words), np.int64)
        first[self.tokens[::-1]] = np.arange(len(self.tokens))[::-1]
        self.grams = {1: _Grams(at, first, key, self._own(at, len(key)))}

    def _own(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(at[self.learned & (at >= 0)], minlength=n)

    def gram(self, n: int) -> _Grams:
        """n-grams may begin with an end, as the start of a text, and end with one, but don't run on over it."""
        if n not in self.grams:
            below, at = self.gram(n - 1), np.full(len(self.tokens), -1, np.int64)
            if n == 2:
                pos = np.arange(1, len(self.tokens))
                before = self.tokens[:-1]
            else:
                pos = np.flatnonzero((below.at[:-1] >= 0) & (self.tokens[:-1] != 0)) + 1
                before = below.at[pos - 1]
            _, first, at[pos] = np.unique(before * len(self.words) + self.tokens[pos], return_index=True, return_inverse=True)
            first = pos[first]
            context = below.key[self.tokens[first - 1] if n == 2 else below.at[first - 1]]
            with np.errstate(over="ignore"):
                key = _mixed(context * np.uint64(0x9E3779B97F4A7C15) + self.grams[1].key[self.tokens[first]])
            self.grams[n] = _Grams(at, first, key, self._own(at, len(key)))
        return self.grams[n]

    def contexts(self, n: int) -> np.ndarray:
        """For each n-gram, the number of its first n - 1 tokens."""
        first = self.gram(n).first
        return self.tokens[first - 1] if n == 2 else self.gram(n - 1).at[first - 1]

    def suffixes(self, n: int) -> np.ndarray:
        """For each n-gram, the number of its last n - 1 tokens."""
        g = self.gram(n)
        return self.tokens[g.first] if n == 2 else self.gram(n - 1).at[g.first]

    def dealt(self, n: int, shared: np.ndarray | None, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """The n-grams to ask for by the part that answers; all, unless it is known which of the shorter ones other blocks have too."""
        ask = np.arange(len(self.gram(n).key)) if shared is None else np.flatnonzero(shared[self.contexts(n)] & shared[self.suffixes(n)])
        part = (self.gram(n).key[ask] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, ask = part[order], ask[order]
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(part[a]), ask[a:b]

    def asks(self, n: int, parts: int, shared: np.ndarray | None = None) -> Iterator[dict]:
        g = self.gram(n)
        for part, which in self.dealt(n, shared, parts):
            keys = b"\n".join([self.words[i] for i in which]) if n == 1 else g.key[which].tobytes()
            yield {"n": n, "part": part, "block": self.row["block"], "keys": keys, "own": _packed(g.own[which])}

    def counts(self, answers: list[dict], parts: int, order: int) -> tuple[dict[int, np.ndarray], np.ndarray | None]:
        """Counts over all blocks up to ``order``, and which of the longest n-grams other blocks have too."""
        more, out, shared = {(a["n"], a["part"]): a["more"] for a in answers}, {}, None
        for n in range(1, order + 1):
            out[n], others = self.gram(n).own.copy(), np.zeros(len(self.gram(n).key), bool)
            for part, which in self.dealt(n, shared if n > 2 else None, parts):
                added = _unpacked(more[n, part]) - 1
                out[n][which] += np.maximum(added, 0)
                others[which] = added >= 0
            shared = others
        return out, shared


class Automaton:
    """States, arcs and failure arcs that the texts of a block can reach.

    Arcs lie in arrays, one entry for each distinct n-gram of the block; a walk looks
    them up in a table of those that its own text can meet.
    """

    def __init__(self, block: Block, counts: dict[int, np.ndarray], *, order: int, mu: float, learned: int, distinct: int):
        self.block, width = block, len(block.words)
        p = single = (counts[1] + 1.0) / (learned + distinct + 1.0)
        self.single = np.log10(single)
        # state 0 has no context; the others are the contexts that occur and can be gone on from
        state, states = {0: np.zeros(1, np.int64)}, 1
        fail, price = [np.zeros(1, np.int64)], [np.zeros(1)]
        for n in range(1, order):
            goes_on = counts[n] > 0
            if n > 1:
                goes_on &= block.tokens[block.gram(n).first] != 0
            state[n] = np.where(goes_on, states - 1 + np.cumsum(goes_on), -1)
            states += int(goes_on.sum())
            fail.append((state[n - 1][block.suffixes(n)] if n > 1 else np.zeros(width, np.int64))[goes_on])
            price.append(np.log10(mu / (counts[n][goes_on] + mu)))
        self.fail, self.price = np.concatenate(fail), np.concatenate(price)
        self.start = max(int(state[1][0]), 0) if order > 1 else 0
        #: For each length: whether an n-gram is an arc, its state and token as one number, its weight, and the state it leads to.
        self.arcs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(1, order + 1):
            token, occurs = block.tokens[block.gram(n).first], counts[n] > 0
            if n == 1:
                source, occurs = np.zeros(width, np.int64), np.ones(width, bool)  # from no context, the unknown has an arc too
            else:
                context = block.contexts(n)
                of_context, below, source = counts[n - 1][context], p[block.suffixes(n)], state[n - 1][context]
                p = np.where(of_context > 0, (counts[n] + mu * below) / (of_context + mu), below)
            # the longest context that what was read ends with; after an end nothing is read
            target = state[n] if n < order else state[n - 1][block.suffixes(n) if n > 1 else np.zeros(width, np.int64)]
            self.arcs[n] = occurs, source * width + token, np.log10(p), np.maximum(target, 0)

    def walk(self, begin: int, end: int) -> float:
        """The log10 probability of the tokens at ``begin`` to ``end``, read from left to right."""
        table: dict[int, int] = {}
        weight: list[float] = []
        to: list[int] = []
        for n, (occurs, key, log_p, target) in self.arcs.items():
            at = self.block.gram(n).at[begin:end]
            at = at[at >= 0]
            at = at[occurs[at]]
            table.update(zip(key[at].tolist(), range(len(weight), len(weight) + len(at)), strict=True))
            weight += log_p[at].tolist()
            to += target[at].tolist()
        fail, price, width = self.fail, self.price, len(self.block.words)
        state, total = self.start, 0.0
        for token in self.block.tokens[begin:end].tolist():
            while (arc := table.get(state * width + token)) is None:
                total += price[state]
                state = int(fail[state])
            total += weight[arc]
            state = to[arc]
        return float(total)


def _asks(lengths: list[int], parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                for n in lengths:
                    yield pa.RecordBatch.from_pylist(list(block.asks(n, parts)), schema=_ASK_ARROW)

    return run


def _asks_after(n: int, parts: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(block.to_pylist()[0])
        _, shared = b.counts(answers.to_pylist(), parts, n - 1)
        return pa.Table.from_pylist(list(b.asks(n, parts, shared)), schema=_ASK_ARROW)

    return run


def _answer(asks: pa.Table) -> pa.Table:
    """All asks of one length and part: one more than what other blocks add to each count (0 where no other has the n-gram), and sums over the part."""
    n, part = asks["n"][0].as_py(), asks["part"][0].as_py()
    own = [_unpacked(x) for x in asks["own"].to_pylist()]
    cuts, every = [0, *accumulate(map(len, own))], np.concatenate(own)
    if n == 1:
        numbers = _Numbers()
        at = np.concatenate([np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in (k.split(b"\n") for k in asks["keys"].to_pylist())])
    else:
        _, at = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in asks["keys"].to_pylist()]), return_inverse=True)
    total = np.bincount(at, weights=every).astype(np.int64)  # exact below 2^53
    more = np.where(np.bincount(at)[at] > 1, total[at] - every + 1, 0)
    known = [int(total.sum()), int((total > 0).sum())] if n == 1 else [0, 0]
    rows = [
        {"n": n, "part": part, "block": block, "more": _packed(more[a:b]), "learned": known[0] if k == 0 else 0, "distinct": known[1] if k == 0 else 0}
        for k, (block, a, b) in enumerate(zip(asks["block"].to_pylist(), cuts, cuts[1:], strict=False))
    ]
    return pa.Table.from_pylist(rows, schema=_ANSWER_ARROW)


def _answers(asks: DataFrame) -> DataFrame:
    return asks.groupBy("n", "part").applyInArrow(_answer, _ANSWER)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: float = MU) -> DataFrame:
    """Scores of every text by a model learned from those that are not held out.

    Returns a row for each row of ``docs``: ``id_col, held_out, n_tokens`` (an end with
    them), ``n_known`` (tokens that occur in texts learned from), ``train_tokens`` (all
    tokens learned from), ``base_score`` (sum of log10 of each token's own probability,
    one added to each count) and ``score`` (log10 of the text's probability).

    A null text is empty: one end. A row with a null id is scored, neither learned from
    nor held out; rows that repeat an id or a text are texts of their own. Where nothing
    is learned from, all tokens are unknown. Texts may be of any length: one is held by
    its task with a few numbers for each token. An empty table gives an empty table;
    other columns are not read. To the driver come two sums
    and the number of blocks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    read = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(~held_out(F.col(id_col)), F.lit(False)).alias("learned"), text.alias("text"))
    blocks = written(read.mapInArrow(_tokenise, _BLOCK), "lm-blocks")
    parts = max(LEAST_PARTS, blocks.count())
    first = [1, 2] if order > 1 else [1]
    answers = written(_answers(blocks.mapInArrow(_asks(first, parts), _ASK)), "lm-answers")
    for n in range(3, order + 1):
        asks = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_asks_after(n, parts), _ASK)
        answers = answers.unionByName(written(_answers(asks), f"lm-answers-{n}"))
    learned, distinct = (int(x or 0) for x in answers.agg(F.sum("learned"), F.sum("distinct")).first())

    def read_texts(block: pa.Table, known: pa.Table) -> pa.Table:
        b = Block(block.to_pylist()[0])
        counts, _ = b.counts(known.to_pylist(), parts, order)
        automaton = Automaton(b, counts, order=order, mu=mu, learned=learned, distinct=distinct)
        begins = np.concatenate([[0], b.ends[:-1]])
        sums = lambda x: np.add.reduceat(x[b.tokens[1:]], begins)
        scores = [automaton.walk(a + 1, e + 1) for a, e in zip(begins, b.ends, strict=True)]
        return pa.table(
            {
                "id": pa.array(b.row["ids"], pa.int64()), "n_tokens": b.ends - begins, "n_known": sums((counts[1] > 0).astype(np.int64)),
                "train_tokens": np.full(len(scores), learned, np.int64), "base_score": sums(automaton.single), "score": pa.array(scores, pa.float64()),
            }
        )

    fields = "id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(read_texts, fields)
    back = F.col("id").cast(docs.schema[id_col].dataType)
    return out.select(back.alias(id_col), F.coalesce(held_out(back), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
