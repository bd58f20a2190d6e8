"""The prefix trie of all conversations, by digests of their prefixes.

Every conversation is a path from the root, one node for each of its prefixes;
prefixes that are equal are one node. A prefix is known by a digest that adds up
128 bits of each turn with its position, so that a conversation of any length is
digested in chunks by as many tasks as it has chunks.

The least member of a node owns it. Members of a deeper node are members of the
ones above, so what a conversation owns is the lower end of its path: a chain,
from its first owned depth down. That depth is found for all conversations at
once by binary search, in which each round is one join of a row per conversation
with the owners among the minima over equal digests. The key has the
conversation in it, so no key is hot however many share a node.

Chains are added up from their ends. A chain's sum then goes to all nodes above
its first in one step, by the digests of the depths that its conversation does
not own: a trie may have as many levels of chains as turns, which rounds would
take one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Conversations in a row that borrow from the first of them, and the numbers of turns borrowed (less than this).
FAMILY, BORROWED = 5, 9
#: Turns of a conversation that are added up together.
CHUNK = 4096
LANES = ("l0", "l1", "l2", "l3")
KEY = ["depth", "hi", "lo"]
#: A node with more than this part of all rows is joined by broadcast, so there are no more such nodes than this.
HOT_NODES = 10_000
#: Ids that are written together before they are hashed.
IDS_AT_ONCE = 4096


def _compact(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, digest, bytes`` of each row with a conversation."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.where("conv IS NOT NULL").select("conv", "turn", "role", F.sha2(whole.cast("binary"), 256).alias("digest"), F.octet_length("text").cast("bigint").alias("bytes"))


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``part`` and ``within`` (from 1, in order), and ``conv, part, offset, n`` with the rows before the part and in the whole conversation.

    Parts are ranges of the sorted table, so a conversation of any size is sorted by many tasks.
    """
    ordered = cut(rows.repartitionByRange("conv", "turn", "role", "digest").withColumn("part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "role", "digest"))
    parts = ordered.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy("conv")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(every).alias("n"))
    return ordered.withColumn("within", within.cast("bigint")), parts


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, depth, digest, bytes`` of the rebuilt turns (depth from 1), and ``conv, turns`` of every conversation.

    A conversation begins with the first turns of the first of its five, as many as
    the CRC of its number says, and goes on with its own after as many.
    """
    rows, parts = _numbered(cut(_compact(turns)))
    parts = cut(parts)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED).cast("bigint")
    sizes = parts.groupBy("conv").agg(F.max("n").alias("n")).withColumn("h", h).withColumn("base", F.col("conv") - F.pmod("conv", F.lit(FAMILY)))
    lent = sizes.select(F.col("conv").alias("base"), F.col("n").alias("of_base"))
    taken = F.least("h", F.coalesce("of_base", F.lit(0))).cast("bigint")
    convs = cut(sizes.join(lent, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")))
    # parts of a conversation, not its rows, are joined with what is known of it
    known = parts.join(convs.select("conv", "h", "taken"), "conv").select("conv", "part", "offset", "h", "taken")
    placed = cut(rows.join(known, ["conv", "part"]).select("conv", (F.col("offset") + F.col("within")).alias("pos"), "h", "taken", "digest", "bytes"))
    own = placed.where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes")
    heads = placed.where(F.col("pos") < BORROWED).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "digest", "bytes")
    begun = convs.select("conv", "base", "h").join(heads, "base").where("depth <= h").select("conv", "depth", "digest", "bytes")
    return own.unionByName(begun), convs.select("conv", "turns")


def _running(df: DataFrame, sums: list[str], *, upwards: bool) -> DataFrame:
    """``sums`` added up along each ``conv`` by depth, from the first turn on or, upwards, from the last one back; by chunks."""
    order, chunks = ("depth", "chunk") if not upwards else (F.desc("depth"), F.desc("chunk"))
    df = df.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    totals = df.groupBy("conv", "chunk").agg(*(F.sum(c).alias(f"{c}_") for c in sums))
    before = Window.partitionBy("conv").orderBy(chunks).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "chunk", *(F.sum(f"{c}_").over(before).alias(f"{c}_") for c in sums)).where(F.col(f"{sums[0]}_").isNotNull())
    along = Window.partitionBy("conv", "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({c: F.sum(c).over(along) for c in sums}).join(totals, ["conv", "chunk"], "left")
    return df.withColumns({c: F.col(c) + F.coalesce(f"{c}_", F.lit(0)) for c in sums}).drop(*(f"{c}_" for c in sums))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, chunk, depth, hi, lo, bytes, last``: the digest of every prefix, the empty one too, and whether it is all of the conversation."""
    bits = lambda k: F.xxhash64(F.lit(k), "depth", "digest")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    lanes = [low(bits(1)), F.shiftrightunsigned(bits(1), 32), low(bits(2)), F.shiftrightunsigned(bits(2), 32)]
    root = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("bytes"), *(F.lit(0).cast("bigint").alias(n) for n in LANES))
    rows = turns.select("conv", "depth", "bytes", *(c.alias(n) for c, n in zip(lanes, LANES, strict=True))).unionByName(root)
    rows = _running(rows, list(LANES), upwards=False)
    both = lambda a, b: F.shiftleft(low(F.col(a)), 32).bitwiseOR(low(F.col(b)))
    rows = rows.select("conv", "chunk", "depth", both("l0", "l1").alias("hi"), both("l2", "l3").alias("lo"), "bytes")
    ends = convs.select("conv", F.floor(F.col("turns") / CHUNK).alias("chunk"), "turns")
    return rows.join(ends, ["conv", "chunk"], "left").withColumn("last", F.coalesce(F.col("depth") == F.col("turns"), F.lit(False))).drop("turns")


def first_owned(convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conv, turns, first``: the least depth at which the conversation is its node's least member; beyond its turns where there is none.

    ``convs(conv, turns)`` are halved once a round; ``nodes`` has ``owner, depth``.
    """
    longest = convs.agg(F.max("turns")).first()[0] or 0
    owned = nodes.select(F.col("owner").alias("conv"), F.col("depth").alias("mid"), F.lit(True).alias("owned")).repartition("conv", "mid").persist(StorageLevel.DISK_ONLY)
    state = convs.select("conv", "turns", F.lit(0).cast("bigint").alias("low"), (F.col("turns") + 1).alias("high"))
    for _ in range((longest + 1).bit_length()):
        state = state.withColumn("mid", F.when(F.col("low") < F.col("high"), F.shiftright(F.col("low") + F.col("high"), 1)))
        found = state.join(owned, ["conv", "mid"], "left")
        high = F.when(F.col("owned"), F.col("mid")).otherwise(F.col("high"))
        low = F.when(F.col("owned").isNull() & F.col("mid").isNotNull(), F.col("mid") + 1).otherwise(F.col("low"))
        state = cut(found.select("conv", "turns", low.alias("low"), high.alias("high")))
    owned.unpersist()
    return state.select("conv", "turns", F.col("low").alias("first"))


def _with_owner(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``rows`` (checkpointed) with the ``owner`` of the node of their key; the few nodes with many members by broadcast."""
    hot = nodes.where(F.col("n_convs") * HOT_NODES > total).select(*KEY, "owner")
    known = rows.join(F.broadcast(hot), KEY, "left")
    rest = known.where("owner IS NULL").drop("owner").join(nodes.select(*KEY, "owner"), KEY)
    return known.where("owner IS NOT NULL").unionByName(rest)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``depth, hi, lo, conv`` to rows of up to IDS_AT_ONCE ids of a node, comma-joined, with the first of them."""
    key, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(KEY, key, strict=True), conv=ids[0], ids=",".join(map(str, ids)))])

    for b in batches:
        for *at, conv in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if ids and (at != key or len(ids) == IDS_AT_ONCE):
                yield out()
                ids = []
            key = at
            ids.append(conv)
    if ids:
        yield out()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to the SHA-256 of all ids of a node, one piece in memory at a time."""
    key, sha = None, None
    for b in batches:
        rows = []
        for *at, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            if at == key:
                sha.update(b",")
            else:
                if sha:
                    rows.append(dict(zip(KEY, key, strict=True), ends_sha256=sha.hexdigest()))
                key, sha = at, hashlib.sha256()
            sha.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_pylist(rows)
    if sha:
        yield pa.RecordBatch.from_pylist([dict(zip(KEY, key, strict=True), ends_sha256=sha.hexdigest())])


def ends(paths: DataFrame) -> DataFrame:
    """``depth, hi, lo, ends_sha256`` of the nodes at which conversations end.

    Ids are written in ranges of the sorted table, so that what one task has to read
    in order, as a hash must, is a few long strings for a node of many.
    """
    key = "depth bigint, hi bigint, lo bigint"
    each = paths.where("last").select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    pieces = each.mapInArrow(_pieces, f"{key}, conv bigint, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(_hashes, f"{key}, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (``rebuilt``).

    ``turns`` has ``conv_id, turn, role, text``. Rows are ordered by turn, nulls
    first; where turns tie, by role, then by digest of the text. A null role or text
    is empty, repeated rows are turns of their own, rows without a conversation are
    left out, a conversation without rebuilt turns ends at the root. Texts may be of
    any length, conversations too. An empty table gives no rows; other columns are
    not read. To the driver come the longest conversation's number of turns and the
    number of prefixes.

    Columns: ``conv_id`` (the least member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    rows, convs = rebuilt(turns)
    convs = cut(convs)
    paths = cut(prefixes(rows, convs))
    nodes = cut(paths.groupBy(*KEY).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")))
    chains = first_owned(convs, nodes).where("first <= turns")
    # the node above a chain's first is on the path of the chain's conversation
    above = chains.where("first > 0").select("conv", "first", (F.col("first") - 1).alias("depth"))
    above = cut(above.join(paths.select("conv", *KEY), ["conv", "depth"]))
    attached = above.groupBy(*KEY).agg(F.count(F.lit(1)).alias("attached"))
    parents = _with_owner(above, nodes, paths.count()).select("conv", F.col("first").alias("depth"), F.col("owner").alias("parent"))
    chain_ends = chains.select(F.col("conv").alias("owner"), F.col("turns").alias("depth"), F.lit(0).alias("below"))
    links = nodes.join(attached, KEY, "left").join(chain_ends, ["owner", "depth"], "left")
    n_children = F.coalesce("attached", F.lit(0)) + F.coalesce("below", F.lit(1))
    links = links.select(F.col("owner").alias("conv"), *KEY, "n_convs", n_children.alias("n_children"), F.when(n_children == 0, 1).otherwise(0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    summed = cut(_running(links, ["leaves", "saved"], upwards=True))
    # a chain's sum for all depths above it, met chunk by chunk
    sums = summed.select("conv", "depth", "leaves", "saved").join(chains.select("conv", F.col("first").alias("depth")), ["conv", "depth"])
    sums = sums.select("conv", F.col("depth").alias("first"), "leaves", "saved", F.explode(F.sequence(F.lit(0), F.floor(F.col("depth") / CHUNK))).alias("chunk"))
    upper = paths.join(sums, ["conv", "chunk"]).where("depth < first").groupBy(*KEY).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    out = summed.join(parents, ["conv", "depth"], "left").join(upper, KEY, "left").join(ends(paths), KEY, "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("bigint")
    parent = F.coalesce("parent", F.when(F.col("depth") > 0, F.col("conv")))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
        plus("leaves", "more_leaves").alias("n_leaves"), plus("saved", "more_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
