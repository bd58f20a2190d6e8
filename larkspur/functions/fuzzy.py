"""Similarity of normalised texts, from 0 to 100.

Definitions (our own statement of well-known measures; L is the length of the
longest common subsequence):

* ``ratio(a, b) = 100 * 2 L / (|a| + |b|)``, and 100 for two empty texts.
* ``token_sort`` is the ratio of the sorted words.
* ``token_set``: with I, A, B the shared and own words, 0 where a side has no
  words, 100 where I is not empty and A or B is; else the largest of the ratios of
  "I A" to "I B", I to "I A" and I to "I B" (the latter two only where I is not empty).
* ``partial(a, b)`` is the best ratio of the shorter text to a window of its
  length in the longer one, windows cut off at either end included.
* ``wratio``: 0 where a side is empty. Up to a length quotient of 1.5 the largest
  of ratio and 0.95 times token_sort and token_set. Beyond, with s = 0.9 (0.6
  from a quotient of 8), the largest of ratio, s * partial and 0.95 * s times the
  partial ratio of sorted words and of word sets (100 where words are shared).

Each distinct pair is computed once in an Arrow batch, with bit-parallel LCS.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import C, col


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one addition on |a|-bit integers per character of b."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, own_x, own_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not own_x or not own_y):
        return 100.0
    with_x, with_y = (" ".join(filter(None, (both, o))) for o in (own_x, own_y))
    found = [ratio(with_x, with_y)]
    if both:
        found += [ratio(both, with_x), ratio(both, with_y)]
    return max(found)


def partial(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 0.0
    if short in long:
        return 100.0
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, w) for w in windows)


def partial_token(a: str, b: str) -> float:
    if set(a.split()) & set(b.split()):
        return 100.0
    return partial(_sorted(a), _sorted(b))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    q = max(len(a), len(b)) / min(len(a), len(b))
    if q < 1.5:
        return max(ratio(a, b), 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    s = 0.6 if q >= 8 else 0.9
    return max(ratio(a, b), s * partial(a, b), 0.95 * s * partial_token(a, b))


def _vectorised(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in seen:
                seen[pair] = f(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return run


_MEASURES = {"ratio": ratio, "token_sort": token_sort, "token_set": token_set, "partial": partial, "wratio": wratio}


def similarities(names: list[str], a: C, b: C) -> Column:
    """A struct of several measures of two columns; the texts travel once, and each distinct pair is computed once in a batch."""

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in names]))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs = pd.DataFrame({"a": a, "b": b})
        known = pairs.dropna().drop_duplicates()
        for n in names:
            known[n] = [float(_MEASURES[n](x, y)) for x, y in zip(known["a"], known["b"], strict=True)]
        return pairs.merge(known.astype({n: "float64" for n in names}), "left", ["a", "b"])[names]

    return run(col(a), col(b))


def similarity(name: str, a: C, b: C) -> Column:
    """``ratio, token_sort, token_set, partial`` or ``wratio`` of two columns."""
    return _vectorised(_MEASURES[name])(col(a), col(b))
