"""Secret scans by rules and by automata inferred from labelled credentials.

Rules find credentials in three kinds. What they find is a labelled sample of
credential formats. For each kind a prefix tree is built from a bounded,
hash-chosen sample of distinct values: a node branches by the characters that
follow significantly more often than others of their classes do (fixed
prefixes), and one branch has all other characters, with the shares of their
classes. So a node keeps many arrivals however random the values are, and
lengths show. States whose shares agree within Hoeffding's bound, and whose
successors do, are merged (red-blue order, as in ALERGIA) into a probabilistic
automaton: formats of fixed length stay chains, others get loops.

Every run of credential characters in every text is scored, whole, without signs
at its ends and in the pieces between dots, slashes and equal signs; so are the
values that rules find. A run is a secret where its log-likelihood per character
is not below what nearly all labelled values of a kind reach and it is likelier,
by ``LEAST_BITS``, than as ordinary text, which is told by the frequencies of
character pairs in all texts outside rule matches. Runs of a length that no
likely value of any kind has are passed without a look at their characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .spans import scored_spans

KINDS = ("assign", "access", "hex")
LEARNED = "format"
#: Distinct labelled values of each kind that automata are inferred from, at most; the least by hash.
LABELLED_VALUES = 1000
#: Characters of a value from which on one looping state stands for all that follow.
DEEPEST = 128
#: Significance of the test that two states differ, and of the one that a character is fixed.
ALPHA, FIXED_ALPHA = 0.05, 0.001
#: Share of the labelled values that may lie below the threshold of their kind.
BELOW = 0.01
#: Bits by which a run must be likelier as a credential than as ordinary text: credentials are taken to be one run in 8,192.
LEAST_BITS = 13
#: Weight of a character's own frequency when its frequency after another one is estimated.
PAIR_WEIGHT = 64
#: Probability of a symbol or end that a state has never shown.
UNSEEN = 2.0**-64
#: Distinct rejected runs that a task holds about at most.
CACHE_LIMIT = 400_000

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "api")
_SIGNS, _CUTS = "+/_.=-", re.compile(r"[^./=]+")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Rule matches as (kind, start, end, the credential itself), by start and then kind."""
    out, low = [], text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_GROUPS = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"} | {c: c for c in _SIGNS}
#: Each credential character's class; classes are digits, letters of hexadecimal digits or others in either case, and single signs.
CLASS = {c: k for k, g in _GROUPS.items() for c in g}
#: Numbers of characters for pairs: 0 is whatever ends a run.
_PLACE = np.zeros(256, np.int64)
for _i, _c in enumerate(CLASS, 1):
    _PLACE[ord(_c)] = _i
_PLACES = len(CLASS) + 1


def pair_counts(text: str) -> np.ndarray:
    """How often each character follows each other one in the runs of a text (flat)."""
    at = _PLACE[np.frombuffer(f" {text} ".encode(), np.uint8)]
    return np.bincount(at[:-1] * _PLACES + at[1:], minlength=_PLACES * _PLACES)


@dataclass
class State:
    """Probability to end; fixed characters, and the others with the shares of their classes, each with the next state."""

    end: float
    fixed: dict[str, tuple[float, int]]
    other: tuple[float, int, dict[str, float]] | None


@dataclass
class Automaton:
    """State 0 begins. ``ordinary``: bits of each pair of characters in ordinary text."""

    states: list[State]
    threshold: float = -math.inf
    ordinary: np.ndarray | None = None
    #: Whether a value of each length can reach the threshold; longer ones are always scored.
    possible: list[bool] = field(default_factory=list)

    def likelihood(self, value: str) -> float:
        """Log-likelihood in bits."""
        total, at = 0.0, 0
        for ch in value:
            p = UNSEEN
            state = self.states[at] if at is not None else None
            at = None
            if state and ch in state.fixed:
                p, at = state.fixed[ch]
            elif state and state.other and (kind := CLASS.get(ch)) in state.other[2]:
                p, at = state.other[0] * state.other[2][kind] / len(_GROUPS[kind]), state.other[1]
            total += math.log2(max(p, UNSEEN))
        return total + math.log2(max(self.states[at].end if at is not None else 0, UNSEEN))

    def score(self, value: str) -> float:
        """Log-likelihood per character, in bits."""
        return self.likelihood(value) / (len(value) + 1)

    def odds(self, value: str) -> float:
        """Bits by which a value is likelier here than as ordinary text."""
        if self.ordinary is None:
            return math.inf
        at = _PLACE[np.frombuffer(f" {value} ".encode(), np.uint8)]
        return self.likelihood(value) - float(self.ordinary[at[:-1], at[1:]].sum())

    def accepts(self, value: str) -> bool:
        n = len(value)
        return (n >= len(self.possible) or self.possible[n]) and self.score(value) >= self.threshold and self.odds(value) >= LEAST_BITS

    def settle(self, values: list[str]) -> Automaton:
        """Set the threshold from labelled values, and the lengths that can reach it."""
        scores = sorted(map(self.score, values))
        self.threshold = scores[int(BELOW * len(scores))] - 1e-9 if scores else math.inf
        lost = math.log2(UNSEEN)
        best, self.possible = {0: 0.0}, []
        for n in range(2 * DEEPEST):
            end = max((x + math.log2(max(self.states[s].end if s is not None else 0, UNSEEN)) for s, x in best.items()), default=-math.inf)
            self.possible.append(end / (n + 1) >= self.threshold)
            after: dict[int | None, float] = {None: max(best.values()) + lost}
            for s, x in best.items():
                if s is None:
                    continue
                steps = list(self.states[s].fixed.values())
                if self.states[s].other:
                    p, t, shares = self.states[s].other
                    steps.append((max(p * q / len(_GROUPS[k]) for k, q in shares.items()), t))
                for p, t in steps:
                    after[t] = max(after.get(t, -math.inf), x + math.log2(max(p, UNSEEN)))
            best = after
        return self


class _Tree:
    """Prefix-tree nodes as counts: arrivals, ends, fixed characters and the others, each with a child."""

    def __init__(self, values: list[str]):
        self.arrivals: list[int] = []
        self.ends: list[int] = []
        self.fixed: list[dict[str, list[int]]] = []
        self.other: list[list | None] = []
        todo = [(self.node(), values)]
        depth = {0: 0}
        while todo:
            at, here = todo.pop()
            d = depth[at]
            on = [v for v in here if len(v) > d]
            self.arrivals[at], self.ends[at] = len(here), len(here) - len(on)
            if not on:
                continue
            if d >= DEEPEST:
                kinds = Counter(CLASS[ch] for v in on for ch in v[d:])
                self.arrivals[at] += kinds.total()
                self.ends[at] = len(here)
                self.other[at] = [kinds.total(), at, kinds]
                continue
            follow: dict[str, list[str]] = {}
            for v in on:
                follow.setdefault(v[d], []).append(v)
            many = sum(len(_GROUPS[k]) for k in {CLASS[ch] for ch in follow})
            bound = 1 / many + math.sqrt(math.log(2 * many / FIXED_ALPHA) / (2 * len(on)))
            rest: list[str] = []
            for ch, some in sorted(follow.items()):
                if len(some) / len(on) > bound:
                    child = self.node()
                    self.fixed[at][ch] = [len(some), child]
                    depth[child] = d + 1
                    todo.append((child, some))
                else:
                    rest += some
            if rest:
                child = self.node()
                self.other[at] = [len(rest), child, Counter(CLASS[v[d]] for v in rest)]
                depth[child] = d + 1
                todo.append((child, rest))

    def node(self) -> int:
        self.arrivals.append(0)
        self.ends.append(0)
        self.fixed.append({})
        self.other.append(None)
        return len(self.arrivals) - 1

    def share(self, at: int, ch: str) -> float:
        """Share of a fixed character, or what the others' share of its class comes to."""
        if ch in self.fixed[at]:
            return self.fixed[at][ch][0] / self.arrivals[at]
        return self.other[at][2][CLASS[ch]] / len(_GROUPS[CLASS[ch]]) / self.arrivals[at] if self.other[at] else 0.0

    def next(self, at: int, ch: str) -> int | None:
        """The child by a fixed character, or else by the others where they have its class."""
        if ch in self.fixed[at]:
            return self.fixed[at][ch][1]
        return self.other[at][1] if self.other[at] and self.other[at][2][CLASS[ch]] else None

    def children(self, at: int) -> list[tuple[str | None, int]]:
        return [(ch, t) for ch, (_, t) in sorted(self.fixed[at].items())] + ([(None, self.other[at][1])] if self.other[at] else [])

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether shares, and those of all common successors, differ by no more than chance allows."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = pair = todo.pop()
            if pair in seen or a == b:
                continue
            seen.add(pair)
            most = bound * (1 / math.sqrt(self.arrivals[a]) + 1 / math.sqrt(self.arrivals[b]))
            of = lambda at, kind: self.other[at][2][kind] / self.arrivals[at] if self.other[at] else 0.0
            if abs(self.ends[a] / self.arrivals[a] - self.ends[b] / self.arrivals[b]) > most:
                return False
            fixed = {*self.fixed[a], *self.fixed[b]}
            if any(abs(self.share(a, ch) - self.share(b, ch)) > most for ch in fixed):
                return False
            kinds = {k for at in (a, b) if self.other[at] for k in self.other[at][2]} - {CLASS[ch] for ch in fixed}
            if any(abs(of(a, k) - of(b, k)) > most for k in kinds):
                return False
            todo += [(x, y) for ch in sorted(fixed) if (x := self.next(a, ch)) is not None and (y := self.next(b, ch)) is not None]
            if self.other[a] and self.other[b]:
                todo.append((self.other[a][1], self.other[b][1]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the counts of ``b`` and what follows it to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.arrivals[a] += self.arrivals[b]
            self.ends[a] += self.ends[b]
            for ch, (n, t) in sorted(self.fixed[b].items()):
                if ch in self.fixed[a]:
                    self.fixed[a][ch][0] += n
                    todo.append((self.fixed[a][ch][1], t))
                elif self.next(a, ch) is not None:
                    self.other[a][0] += n
                    self.other[a][2][CLASS[ch]] += n
                    todo.append((self.other[a][1], t))
                else:
                    self.fixed[a][ch] = [n, t]
            if self.other[b]:
                if self.other[a]:
                    self.other[a][0] += self.other[b][0]
                    self.other[a][2].update(self.other[b][2])
                    if self.other[b][1] != b:
                        todo.append((self.other[a][1], self.other[b][1]))
                else:
                    n, t, kinds = self.other[b]
                    self.other[a] = [n, a if t == b else t, Counter(kinds)]


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """A probabilistic automaton from distinct example values, by merging compatible prefix-tree states."""
    tree, bound = _Tree(sorted(values)), math.sqrt(0.5 * math.log(2 / alpha))
    red, blue = [0], [(0, ch) for ch, t in tree.children(0) if t != 0]
    while blue:
        parent, ch = blue.pop(0)
        edge = tree.fixed[parent].get(ch) if ch is not None else tree.other[parent]
        if edge is None or edge[1] in red:
            continue
        b = edge[1]
        for r in red:
            if tree.compatible(r, b, bound):
                edge[1] = r
                tree.fold(r, b)
                break
        else:
            red.append(b)
        blue = [(s, c) for s in red for c, t in tree.children(s) if t not in red]
    number, kinds = {s: i for i, s in enumerate(red)}, sorted({CLASS[ch] for v in values for ch in v})
    states = []
    for s in red:
        n, other = max(tree.arrivals[s], 1), tree.other[s]
        shares = {k: (other[2][k] + 0.5) / (other[0] + 0.5 * len(kinds)) for k in kinds} if other else {}
        states.append(State(tree.ends[s] / n, {ch: (m / n, number[t]) for ch, (m, t) in tree.fixed[s].items()}, (other[0] / n, number[other[1]], shares) if other else None))
    return Automaton(states).settle(values)


def fit(docs: DataFrame, *, text_col: str = "text", labelled_values: int = LABELLED_VALUES) -> dict[str, Automaton]:
    """Infer an automaton for each kind of which rules find values.

    All texts are read, for labels and for the frequencies of character pairs
    outside them. To the driver come ``labelled_values`` of each kind, the least by
    hash, and the counts of pairs. Null texts have none; repeated values count
    once; without labels there is no automaton; texts of any length are whole.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, kinds = np.zeros(_PLACES * _PLACES, np.int64), [pa.string(), pa.string(), pa.int64()]
        for b in batches:
            found = set()
            for text in b.column(0).to_pylist():
                at, parts = 0, []
                for kind, x, y, value in base_spans(text):
                    found.add((kind, value, 1))
                    parts.append(text[at:x])
                    at = max(at, y)
                pairs += pair_counts(" ".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sorted(found), strict=True) if found else [()] * 3, kinds, strict=True)], ["kind", "value", "n"])
        where = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([""] * len(where), kinds[0]), pa.array(list(map(str, where.tolist())), kinds[1]), pa.array(pairs[where])], ["kind", "value", "n"])

    rows = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "kind string, value string, n bigint")
    counted = cut(rows.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    pairs = np.zeros(_PLACES * _PLACES)
    for r in counted.where("kind = ''").collect():
        pairs[int(r["value"])] = r["n"]
    pairs = pairs.reshape(_PLACES, _PLACES)
    single = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * _PLACES)
    ordinary, model = np.log2((pairs + PAIR_WEIGHT * single) / (pairs.sum(1, keepdims=True) + PAIR_WEIGHT)), {}
    for kind in KINDS:
        chosen = counted.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(labelled_values).collect()
        if chosen:
            model[kind] = infer([r["value"] for r in chosen])
            model[kind].ordinary = ordinary
    return model


class Scorer:
    """Scores runs under all automata; each distinct run once, as long as the tables have room."""

    def __init__(self, model: dict[str, Automaton]):
        self.model, self.rejected, self.accepted = model, set(), {}
        least = min((next((n for n, ok in enumerate(a.possible) if ok and n), 2 * DEEPEST) for a in model.values()), default=0)
        self.runs = re.compile(f"[A-Za-z0-9+/_.=-]{{{least},}}") if least else None

    def bits(self, value: str) -> float | None:
        """Bits of a value that a rule found, whether accepted or not."""
        return max((a.odds(value) for a in self.model.values()), default=None)

    def parts(self, run: str) -> list[tuple[int, int, float]]:
        """What is accepted of a run: the whole, else the run without signs at its ends, else pieces."""
        low, high = len(run) - len(run.lstrip(_SIGNS)), len(run.rstrip(_SIGNS))
        for spans in dict.fromkeys((((0, len(run)),), ((low, high),), tuple(p.span() for p in _CUTS.finditer(run)))):
            found = [(a, b, max(x.odds(run[a:b]) for x in taking)) for a, b in spans if a < b and (taking := [x for x in self.model.values() if x.accepts(run[a:b])])]
            if found:
                return found
        return []

    def found(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Accepted spans of a text. Most runs are known to be ordinary words, so a text is looked at as a set of them first."""
        if not self.runs:
            return
        for run in set(self.runs.findall(text)).difference(self.rejected):
            if run in self.accepted:
                continue
            if parts := self.parts(run):
                self.accepted[run] = parts
            elif len(run) < 2 * DEEPEST:
                self.rejected.add(run)
        if self.accepted:
            for m in self.runs.finditer(text):
                for a, b, bits in self.accepted.get(m[0], ()):
                    yield m.start() + a, m.start() + b, bits
        if len(self.rejected) > CACHE_LIMIT:
            self.rejected.clear()
        self.accepted.clear()


def find_scored(text: str, scorer: Scorer) -> list[tuple[str, int, int, str, bool, float | None]]:
    """All secrets of a text: (kind, start, end, value, whether a rule found it, bits)."""
    base = base_spans(text)
    out = [(k, a, b, text[a:b], True, scorer.bits(value)) for k, a, b, value in base]
    covered, i, reach = sorted((a, b) for _, a, b, _ in base), 0, 0
    for a, b, bits in scorer.found(text):
        while i < len(covered) and covered[i][0] < b:
            reach = max(reach, covered[i][1])
            i += 1
        if reach <= a:
            out.append((LEARNED, a, b, text[a:b], False, bits))
    order = {k: i for i, k in enumerate((*KINDS, LEARNED))}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def find(text: str, model: dict[str, Automaton]) -> list[tuple[str, int, int, str, bool]]:
    """All secrets of a text: (kind, start, end, value, whether a rule found it)."""
    return [s[:5] for s in find_scored(text, Scorer(model))]


def find_secrets(docs: DataFrame, model: dict[str, Automaton] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``secrets`` (spans in code points, end exclusive, with their bits) of each row.

    Without a model one is fitted on the same texts. A run that overlaps a rule's
    match adds no span. Null and empty texts have no spans; repeated rows and null
    ids stay as they are; texts of any length are read as a whole, in time
    proportional to it; an empty table gives an empty table; other columns are
    dropped.
    """
    bounded_batches(docs.sparkSession)
    model = fit(docs, text_col=text_col) if model is None else model
    id_type = docs.schema[id_col].dataType.simpleString()
    ddl, arrow, names = scored_spans()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [[dict(zip(names, s, strict=True)) for s in find_scored(t, scorer)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, arrow)], [id_col, "secrets"])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, f"`{id_col}` {id_type}, secrets {ddl}")


def masked(text: str, model: dict[str, Automaton] | Scorer, mask: str = "[SECRET]") -> str:
    """The text with each secret, or each run of overlapping ones, replaced."""
    out, at = [], 0
    for _, a, b, *_ in find_scored(text, model if isinstance(model, Scorer) else Scorer(model)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, model: dict[str, Automaton] | None = None, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets masked in ``text_col``; a null text stays null."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, text_col=text_col) if model is None else model
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            texts = [None if t is None else masked(t, scorer) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
