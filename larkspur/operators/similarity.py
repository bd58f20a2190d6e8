"""Pairs of similar texts without a shared key: an exact join by inverted lists of prefixes.

A pair whose ratio is ``least`` or more is ``k`` insertions and deletions apart at
most, where the length of either text bounds ``k``. Each of these spoils ``q`` of the
q-grams of a text, so the two share a q-gram among the ``q * k + 1`` rarest of each.
Only these are listed, lists of the same q-gram meet, and what differs too much in
length is dropped there; the measure itself decides.

``token_set`` compares words, shared ones first. Two-letter grams of a text with
blanks around it do not depend on the order of its words, so the same lists find
pairs that are alike as a whole. A text may also be alike for the words that it
shares alone; then the rest of its letters is few, and one of its rarest words, as
many as have more letters than that, is a word of the other.

Before the measure decides, a pair meets two sketches of 64 bits: the parities of a
text's letters and of its pairs of letters. An edit changes one letter, so one bit,
and up to three pairs of letters.

A q-gram that many texts list is dealt into blocks of these, and each pair of blocks
meets in a task of its own; so no list is in one place, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..session import checkpointed

MEASURES = ("ratio", "token_set")
#: Below this the number of edits is not bounded by a text's own length.
LEAST = 200 / 3
#: Texts in a block of a list.
BLOCK = 2048
#: Rows of counts (a gram and a number) that may be broadcast.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table for the right side of a join, broadcast where it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _rarest(lists: DataFrame, order: Column, upto: Column) -> DataFrame:
    """Rows ``id, key, ...`` of each id as far as ``upto`` says of the ones before, rarest keys first."""
    counts = checkpointed(lists.groupBy("key").agg(F.count(F.lit(1)).alias("freq")))
    window = Window.partitionBy("id").orderBy("freq", "key")
    before = F.coalesce(F.sum(order).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lists.join(_small(counts), "key").withColumn("before", before).where(upto).drop("before", "freq")


def _blocks(rows: DataFrame, side: str) -> DataFrame:
    """``key, n_<side>``: blocks of each list that needs more than one."""
    counts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(f"n_{side}"))
    return checkpointed(counts.where(F.col(f"n_{side}") > 1))


def _parities(values: Column) -> Column:
    """64 bits, each the parity of how many of the values have its number."""
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(v), F.lit(64)).cast("int"))
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda bits, v: bits.bitwiseXOR(bit(v)))


def _meet(left: DataFrame, right: DataFrame, close: Column) -> DataFrame:
    """Distinct pairs ``x < y`` of ids whose lists ``id, key, size`` meet and that are ``close`` (of ``size, letters, twos`` and those of the ``other``)."""
    many = _small(checkpointed(_blocks(left, "l").join(_blocks(right, "r"), "key", "full")))
    one = lambda c: F.coalesce(c, F.lit(1))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(many, "key", "left").withColumn(own, F.pmod(F.xxhash64("id"), one(f"n_{own}")).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), one(f"n_{other}") - 1))).drop("n_l", "n_r")

    others = dealt(right, "r", "l").withColumnsRenamed({c: f"other_{c}" for c in ("id", "size", "letters", "twos")})
    met = dealt(left, "l", "r").join(others, ["key", "l", "r"]).where((F.col("id") != F.col("other_id")) & close)
    return met.select(F.least("id", "other_id").alias("x"), F.greatest("id", "other_id").alias("y")).distinct()


def candidates(texts: DataFrame, measure: str, least: float) -> DataFrame:
    """Pairs ``x < y`` of ids that may be alike, all that are among them; ``texts`` has ``id, text``, distinct and not empty."""
    if measure not in MEASURES or not LEAST < least <= 100:
        raise ValueError(f"measure is one of {MEASURES}, least is above {LEAST:.1f} and at most 100")
    if measure == "token_set":
        words = F.array_sort(F.array_distinct(F.filter(F.split("text", " "), lambda w: w != "")))
        texts = texts.select("id", words.alias("words")).where(F.size("words") > 0)
        texts = checkpointed(texts.withColumn("text", F.array_join("words", " ")))
    q = 2 if least >= 80 else 1  # so that some q-grams are left after all edits
    size = F.length("text")
    padded = F.concat(F.lit(" " * (q - 1)), F.col("text"), F.lit(" " * (q - 1)))
    grams = F.transform(F.sequence(F.lit(1), size + q - 1), lambda i: F.substring(padded, i, F.lit(q)))
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    known = texts.withColumn("grams", grams).select("id", size.alias("size"), _parities(letters).alias("letters"), _parities(F.col("grams")).alias("twos"), "grams")
    facts = ["id", "size", "letters", "twos"]
    # a q-gram that a text has three times is three keys
    each = known.select(*facts, F.explode("grams").alias("gram")).groupBy(*facts, "gram").agg(F.count(F.lit(1)).cast("int").alias("n"))
    each = checkpointed(each.select(*facts, F.explode(F.sequence(F.lit(1), "n")).alias("i"), "gram").select(*facts, F.concat_ws(":", "i", "gram").alias("key")))
    edits = F.floor(F.col("size") * (2 * (100 - least) / least) + 1e-9)
    listed = checkpointed(_rarest(each, F.lit(1), F.col("before") <= q * edits))
    apart = (F.col("size") + F.col("other_size")) * ((100 - least) / 100) + 1e-9
    differ = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}")))
    close = (F.abs(F.col("size") - F.col("other_size")) <= apart) & (differ("letters") <= apart) & (differ("twos") <= (2 * q - 1) * apart)
    pairs = _meet(listed, listed, close)
    if measure == "token_set":
        rows = texts.select("id", size.alias("size"), F.explode("words").alias("key"))
        rest = F.col("size") * ((200 - 2 * least) / (200 - least)) + 1e-9  # letters that need not be shared
        first = checkpointed(_rarest(rows, F.length("key") + 1, F.col("before") <= rest))
        pairs = pairs.unionByName(_meet(first, checkpointed(rows), F.lit(True))).distinct()
    return pairs


def similar_pairs(rows: DataFrame, text: str, measure: str = "ratio", least: float = 90.0) -> DataFrame:
    """Pairs ``a < b`` of distinct texts whose ``measure`` is ``least`` or more, with their ``score``.

    Texts come as they are to be compared (normalised); equal ones are one text, nulls
    and empty ones (``token_set``: texts without words) are in no pair. An empty table
    gives no pairs.
    """
    texts = rows.select(F.col(text).alias("text")).where("text <> ''").distinct()
    texts = checkpointed(texts.withColumn("id", F.monotonically_increasing_id()))
    pairs = checkpointed(candidates(texts, measure, least))
    of = lambda i, name: texts.select(F.col("id").alias(i), F.col("text").alias(name))
    both = pairs.join(of("x", "t"), "x").join(of("y", "u"), "y").select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"))
    return both.withColumn("score", fuzzy.similarity(measure, "a", "b")).where(F.col("score") >= least)
