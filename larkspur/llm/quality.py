"""Quality rules: base counts, and multivariate outliers by robust estimates.

Every text gets counts. Texts that fail the base rules are out; the others form
vectors of four transformed statistics: length of words, marks (punctuation and
symbols), capitals and distinct words. Each group (language and source) gets a
minimum-covariance-determinant estimate of its centre and scatter, and a text is
rejected where its Mahalanobis distance from its group is beyond a chi-square
quantile. Repeated lines and windows are no statistics of the vector: most
texts have none, so three quarters of a group would have no spread in them.

A short text's statistics vary more than a long one's. So a deviation from the
group's median is settled: multiplied by ``sqrt(n / (n + SETTLED_WORDS))``,
after which its variance depends little on the length ``n``.

Copies say nothing about spread, so estimates are made from distinct vectors.
For each group a sample of about ``START_ROWS`` goes through concentration
steps from random starts, each until its determinant settles, with exact
subsets; where the sample is the whole group that is the estimate. Else steps go
on over all rows, which are dealt into chunks once: distances fall into fine
logarithmic bins, each bin's count and moments are added up in a chunk before
anything is shuffled, and the nearest bins
that hold the wanted share (of the last one that part which is wanted) give the
next estimate, until determinants settle. A step moves a few hundred small rows
for each group, whatever share of the table that group has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chisquare import cdf, quantile
from .common import bounded_batches, cut, fresh, is_small, sized, written

#: Statistics of a text that passes the base rules, as SQL over its counts.
STATISTICS = {
    "s0": "ln(word_chars / n_words)",
    "s1": "sqrt(n_marks / word_chars)",
    "s2": "sqrt(n_capitals / word_chars)",
    "s3": "ln(n_distinct) / ln(n_words)",
}
#: Variance that the statistic of one text has from counting alone (a Poisson count, or one character or word more).
NOISE = ("pow(word_chars, -2)", "0.25 / word_chars", "0.25 / word_chars", "pow(n_distinct * ln(n_words), -2)")
#: Words from which a text's statistics vary as those of much longer ones do.
SETTLED_WORDS = 300
#: Share of a group's rows that an estimate is made from.
SHARE = 0.75
#: Rows of a group that starts are made from; random starts; steps over all rows, at most (they settle long before).
START_ROWS, STARTS, MOST_STEPS = 1500, 50, 50
#: Change of a logarithmic determinant that counts as settled (a thousandth of the determinant, far below its sampling error).
SETTLED = 1e-3
#: Rows that pass the base rules from which a group has its own estimate, ten for each statistic; smaller ones pool by language, then together.
LEAST_ROWS = 40
#: Chance that a text of the group's own distribution is rejected, were it normal.
REJECT = 1e-9
BINS_PER_OCTAVE = 64
#: Rows of a group (64 bytes each) that a step reads together.
CHUNK_ROWS = 4096
SYMBOLS = "#*$%&|<>"

_P = len(STATISTICS)
_PAIRS = list(combinations_with_replacement(range(_P), 2))
_SPACES = " \t\n\x0b\x0c\r"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CAPITALS = bytes(range(65, 91))


def _all_counts(text: str) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeated = 0
    if n > 3:
        pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        window = pair[:-1] * np.int64(len(seen)) + ids[2:]
        _, which, times = np.unique(window, return_inverse=True, return_counts=True)
        again = times[which] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= again
        repeated = int(inside.sum())
    chars = len(text) - sum(map(text.count, _SPACES))
    less = [len(raw) - len(raw.translate(None, some)) for some in (_MARKS, _CAPITALS)]
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated, *less, len(seen)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_distinct")


def counts(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    return _all_counts(text)[:6]


def _counted(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """The rows of ``docs``, all columns, with their counts under ``names``; a null text counts as empty."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    ddl = docs
    for name in names:
        ddl = ddl.withColumn(name, F.lit(0).cast("bigint"))
    columns = ddl.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*(_all_counts(t or "") for t in b.column(at).to_pylist()), strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in found)], columns)

    return docs.mapInArrow(run, ddl.schema)


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _groups(passed: DataFrame) -> DataFrame:
    """``lang, source`` to the number of the group whose estimate they share."""
    own = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    by_lang = F.sum(F.when(F.col("rows") < LEAST_ROWS, F.col("rows")).otherwise(0)).over(Window.partitionBy("lang"))
    level = F.when(F.col("rows") >= LEAST_ROWS, 0).when(by_lang >= LEAST_ROWS, 1).otherwise(2)
    named = own.withColumn("level", level)
    name = F.to_json(F.struct("level", F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") < 1, F.col("source")).alias("source")))
    return named.select("lang", "source", F.xxhash64(name).alias("group"))


_SETTLED = f"n_words / (n_words + {SETTLED_WORDS}D)"


def _statistic(i: int) -> Column:
    return F.expr(f"CAST({STATISTICS[f's{i}']} AS DOUBLE)")


def _shifted(median: str) -> list[Column]:
    """The statistics of a row as settled deviations from its group's medians."""
    return [((_statistic(i) - F.col(median)[i]) * F.sqrt(F.expr(_SETTLED))).alias(f"s{i}") for i in range(_P)]


def _distance(estimate: str = "") -> Column:
    """Squared Mahalanobis distance of a row from the estimate that it is joined with."""
    d = [F.col(f"s{i}") - F.col(f"{estimate}centre")[i] for i in range(_P)]
    return sum(F.col(f"{estimate}inverse")[k] * d[i] * d[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS))


_MOMENTS = ["rows", *(f"m{i}" for i in range(_P)), *(f"c{i}{j}" for i, j in _PAIRS), *(f"u{i}" for i in range(_P))]


def _inverted(scatter: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and logarithmic determinant; a statistic with less spread than counting alone gives has that."""
    scatter = scatter + np.diag(np.maximum(noise - np.diag(scatter), 0) + 1e-12)
    return np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1])


def subset_size(n: int, p: int = _P) -> int:
    """Rows that an estimate is made from: all where they are too few for a robust one (five for each statistic)."""
    return math.ceil(SHARE * n) if n > 5 * p else n


def _estimated(x: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    centre = x.mean(0)
    return centre, *_inverted((x - centre).T @ (x - centre) / len(x), noise.mean(0))


def _squared(x: np.ndarray, centre: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return (((x - centre) @ inverse) * (x - centre)).sum(1)


def concentrated(x: np.ndarray, noise: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, inverse scatter and logarithmic determinant of the best ``h`` rows that steps from random starts reach.

    A step takes the ``h`` rows that are nearest under the current estimate (ties
    to the earlier row), and is repeated until the determinant settles.
    """
    if h == len(x):
        return _estimated(x, noise)
    rng, best = np.random.default_rng(0), None
    for _ in range(STARTS):
        some = rng.choice(len(x), x.shape[1] + 1, replace=False)
        now, last = _estimated(x[some], noise[some]), np.inf
        while True:
            near = np.argsort(_squared(x, *now[:2]), kind="stable")[:h]
            now = _estimated(x[near], noise[near])
            if now[2] >= last - 1e-9:
                break
            last = now[2]
        if best is None or now[2] < best[2]:
            best = now
    return best


#: What makes the scatter of the nearest share, or of the rows within the 97.5 % quantile, that of a whole normal group.
_INSIDE, _WITHIN = (q / cdf(quantile(q, _P), _P + 2) for q in (SHARE, 0.975))


def robust(x: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and inverse scatter of a group that is at hand as a whole, reweighted once."""
    h = subset_size(len(x))
    centre, inverse, _ = concentrated(x, noise, h)
    if h == len(x):
        return centre, inverse
    inside = _squared(x, centre, inverse) / _INSIDE <= quantile(0.975, _P)
    x, noise = x[inside], noise[inside]
    centre = x.mean(0)
    return centre, _inverted((x - centre).T @ (x - centre) / len(x) * _WITHIN, noise.mean(0))[0]


_ESTIMATE = "group bigint, centre array<double>, inverse array<double>, logdet double"


def _upper(inverse: np.ndarray) -> list[float]:
    return [float(inverse[i, j]) for i, j in _PAIRS]


def _estimates(moments: DataFrame, scale: float = 1.0) -> DataFrame:
    """Centre, inverse scatter and logarithmic determinant from the moments of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                n = row["rows"]
                centre = np.array([row[f"m{i}"] for i in range(_P)]) / n
                scatter = np.zeros((_P, _P))
                for i, j in _PAIRS:
                    scatter[i, j] = scatter[j, i] = row[f"c{i}{j}"] / n - centre[i] * centre[j]
                inverse, logdet = _inverted(scatter * scale, np.array([row[f"u{i}"] for i in range(_P)]) / n)
                out.append((row["group"], centre.tolist(), _upper(inverse), logdet))
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], ["group", "centre", "inverse", "logdet"])

    return moments.select("group", *_MOMENTS).mapInArrow(run, _ESTIMATE)


def _started(rows: DataFrame) -> DataFrame:
    """From a sample of each group: its final estimate where that is the whole group, else the start of further steps."""
    names = [*(f"s{i}" for i in range(_P)), *(f"u{i}" for i in range(_P))]

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        values = sample.sort_values(names, kind="stable")[names].to_numpy(float)
        x, noise = values[:, :_P], values[:, _P:]
        whole = len(sample) == sample["of"].iloc[0]
        centre, inverse, logdet = (*robust(x, noise), 0.0) if whole else concentrated(x, noise, subset_size(len(x)))
        return pd.DataFrame({"group": sample["group"].iloc[:1], "centre": [centre.tolist()], "inverse": [_upper(inverse)], "logdet": [logdet], "whole": [whole]})

    # a share by hash, so that no task has to rank a group; a group of at most START_ROWS comes whole
    place = F.pmod(F.xxhash64(*names), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.where(place * F.col("of") < START_ROWS).select("group", "of", *names)
    return sample.groupBy("group").applyInPandas(run, f"{_ESTIMATE}, whole boolean")


def _packed(rows: DataFrame) -> DataFrame:
    """The rows of each group in chunks of about ``CHUNK_ROWS``, dealt by hash, so that a step meets its estimate once a chunk and not once a row."""
    names = [*(f"s{i}" for i in range(_P)), *(f"u{i}" for i in range(_P))]
    chunk = F.pmod(F.xxhash64(*names), F.ceil(F.col("of") / CHUNK_ROWS)).alias("chunk")
    return rows.groupBy("group", chunk).agg(F.collect_list(F.array(*names)).alias("values")).select("group", "values")


_SUMS = f"group bigint, bin int, {', '.join(f'{c} double' for c in _MOMENTS)}"


def _summed(chunks: DataFrame, estimates: DataFrame, small: bool, most: float | None = None) -> DataFrame:
    """Moments of the rows of each group by logarithmic bins of their distance from its estimate; with ``most``, of those within it, in one bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            which = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            values = lists.flatten().flatten().to_numpy().reshape(-1, 2 * _P)
            centre, inverse = (b.column(k).flatten().to_numpy().reshape(-1, n)[which] for k, n in ((2, _P), (3, len(_PAIRS))))
            x = values[:, :_P]
            d = x - centre
            distance = sum(inverse[:, k] * d[:, i] * d[:, j] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS))
            bins = np.floor(np.log2(np.maximum(distance, 1e-9)) * BINS_PER_OCTAVE).astype(np.int64) if most is None else np.zeros(len(x), np.int64)
            columns = [np.ones(len(x)), *x.T, *(x[:, i] * x[:, j] for i, j in _PAIRS), *values[:, _P:].T]
            keys = np.stack([b.column(0).to_numpy()[which], bins], 1)
            if most is not None:
                inside = distance <= most
                keys, columns = keys[inside], [c[inside] for c in columns]
            found, at = np.unique(keys, axis=0, return_inverse=True)
            sums = [np.bincount(at.ravel(), c, len(found)) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32)), *map(pa.array, sums)], ["group", "bin", *_MOMENTS])

    met = chunks.join(sized(estimates, small), "group").select("group", "values", "centre", "inverse")
    return met.mapInArrow(run, _SUMS).groupBy("group", "bin").agg(*(F.sum(c).alias(c) for c in _MOMENTS))


def _step(chunks: DataFrame, estimates: DataFrame, small: bool) -> DataFrame:
    """The moments of the nearest ``SHARE`` of each group under its estimate; of the last bin, the part that is wanted."""
    binned = _summed(chunks, estimates, small)
    of = Window.partitionBy("group")
    wanted = F.ceil(SHARE * F.sum("rows").over(of)) - (F.sum("rows").over(of.orderBy("bin")) - F.col("rows"))
    near = binned.withColumn("part", F.least(F.lit(1.0), wanted / F.col("rows"))).where(F.col("part") > 0)
    return near.groupBy("group").agg(*(F.sum(F.col(c) * F.col("part")).alias(c) for c in _MOMENTS))


def estimate(rows: DataFrame, small: bool) -> DataFrame:
    """Robust estimates ``(group, centre, inverse)`` from distinct ``(group, of, s0, ..., u0, ...)``.

    ``of`` has the number of the group's rows, ``u0, ...`` their variance from
    counting alone. ``small``: whether there are few enough groups to broadcast
    their estimates.
    """
    started = cut(_started(rows))
    final = started.where("whole").select("group", "centre", "inverse")
    now = started.where("NOT whole").drop("whole")
    if now.isEmpty():
        return final
    large, done = cut(_packed(rows.where(F.col("of") > START_ROWS))), None
    for _ in range(MOST_STEPS):
        before = now.select("group", F.col("logdet").alias("before"))
        stepped = _estimates(_step(large, now, small)).join(before, "group")
        stepped = cut(stepped.withColumn("settled", F.abs(F.col("before") - F.col("logdet")) < SETTLED).drop("before"))
        # a group takes part until it has settled, so that later steps read the others' rows only
        finished, now = stepped.where("settled").drop("settled"), stepped.where("NOT settled").drop("settled")
        done = finished if done is None else done.unionByName(finished)
        if now.isEmpty():
            break
    now = cut(done.unionByName(now))
    kept = _summed(large, now, small, _INSIDE * quantile(0.975, _P))
    return final.unionByName(cut(_estimates(kept, _WITHIN)).select("group", "centre", "inverse"))


def _fitted(counted: DataFrame) -> tuple[DataFrame, bool]:
    """From stored counts: ``lang, source, limit`` with the medians and estimate of their group; whether that is small."""
    passed = counted.where(f"NOT ({BASE_FAILED})")
    groups = cut(_groups(passed))
    small = is_small(groups)
    named = groups.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "group")
    rows = passed.join(sized(named, small), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")))
    medians = cut(rows.groupBy("group").agg(F.array(*(F.percentile_approx(_statistic(i), 0.5, 10_000) for i in range(_P))).alias("median")))
    vectors = rows.join(sized(medians, small), "group").select("group", *_shifted("median"), *((F.expr(sql) * F.expr(_SETTLED)).alias(f"u{i}") for i, sql in enumerate(NOISE))).distinct()
    vectors = cut(vectors)
    sizes = cut(vectors.groupBy("group").agg(F.count(F.lit(1)).alias("of")))
    estimates = estimate(vectors.join(sized(sizes, small), "group"), small)
    limits = groups.join(estimates, "group").join(medians, "group")
    return cut(limits.select("lang", "source", F.struct("median", "centre", "inverse").alias("limit"))), small


def _judged(counted: DataFrame, limits: DataFrame, small: bool) -> DataFrame:
    """``counted``, all columns, with ``base_failed``, ``distance`` and ``kept``."""
    named = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "limit")
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    joined = counted.join(sized(named, small), same, "left").drop("__lang", "__source").withColumn("base_failed", F.expr(BASE_FAILED))
    shifted = joined.select("*", *(F.when(~F.col("base_failed"), c).alias(f"s{i}") for i, c in enumerate(_shifted("limit.median"))))
    scored = shifted.withColumn("distance", _distance("limit.")).drop("limit", *STATISTICS)
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= quantile(1 - REJECT, _P), F.lit(True)))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdict of every row.

    Returns ``id_col``, the counts, ``base_failed``, ``distance`` (squared; null
    where base rules failed) and ``kept``. Null and empty texts have no words and
    fail. A null language or source is a value like others. Repeated rows and
    texts with equal statistics count once for the estimates and have the same
    verdict. Texts of any length are counted as a whole, in memory that is a few
    times their own. In a group of 20 rows or fewer nothing is rejected but by the
    base rules. An empty table gives an empty table; other columns are dropped.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = cut(_counted(rows, "text", list(COUNTS)).drop("text"))
    judged = _judged(counted, *_fitted(counted))
    return judged.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows and columns of ``docs`` that the rules keep.

    Texts are counted once and written with their counts, then filtered in
    columns; they are not shuffled where the table of groups is small. Nulls,
    empty and very long texts, ties, repeated rows and an empty table are as in
    ``judge``; columns of ``docs`` may have any names.
    """
    names = [fresh(docs, f"__{c}") for c in COUNTS]
    wide = written(_counted(docs, text_col, names), "counted")
    narrow = [F.col(name).alias(c) for name, c in zip(names, COUNTS, strict=True)]
    limits, small = _fitted(cut(wide.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *narrow)))
    whole = wide.select(F.struct(*docs.columns).alias("row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *narrow)
    return _judged(whole, limits, small).where("kept").select("row.*")
