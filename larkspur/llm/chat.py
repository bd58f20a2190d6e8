"""Chat formatting from an event log.

A log has one row for each event: ``conv_id, turn, copy, seq, kind, role,
text``. It is partitioned by conversation and sorted by message and sequence;
a fold over the sorted rows then rebuilds each message:

* ``open`` sets the role, ``delta`` appends streamed text,
* ``edit`` puts its text in place of what there is, ``regenerate`` drops what
  there is; deltas may follow either. Other kinds change nothing.

Events of a message follow one another in the sorted log, so the fold holds one
message at a time however long a conversation is.

A message is rendered as ``<s>ROLE\\nTEXT</s>``. Control strings inside a role
or text (``<s> </s> [INST] [/INST]``) get a backslash after their bracket, and
those which already have backslashes there get one more, so that taking one
away again gives the text exactly. The loss mask covers assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

OPEN, CLOSE = "<s>", "</s>"
#: Regular expressions of what is escaped: a bracket, any backslashes, the rest of a control string.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
#: Roles whose texts are trained on.
TRAINED = ("assistant",)

_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of one message, and the bounds of its text in it."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Fold sorted events into (conv_id, turn, position, role, text)."""
    key, conv, position, role, parts = None, None, -1, "", []
    for b in batches:
        for c, turn, copy, kind, r, text in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if key != (c, turn, copy):
                if key is not None:
                    yield key[0], key[1], position, role, "".join(parts)
                position = position + 1 if key is not None and c == conv else 0
                key, conv, role, parts = (c, turn, copy), c, "", []
            if kind == "open":
                role = r or ""
            elif kind == "delta":
                parts.append(text or "")
            elif kind == "edit":
                parts = [text or ""]
            elif kind == "regenerate":
                parts = []
    if key is not None:
        yield key[0], key[1], position, role, "".join(parts)


def format_log(log: DataFrame) -> DataFrame:
    """Rebuild and render every message of a log.

    Returns one row for each message: ``conv_id, turn, position`` (from 0),
    ``role, text, rendered`` and ``loss`` (bounds in ``rendered`` of the text to
    train on, or null). A conversation's output is its rows' ``rendered`` in the
    order of ``position``; rows leave the operator in that order, a conversation
    within one partition. ``seq`` orders the events of a message, ``copy`` sets
    apart messages with the same turn. Null texts and roles count as empty; null
    ids and turns are values like others and come first; repeated events apply
    again; an empty log gives an empty table.
    """
    bounded_batches(log.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in log.schema}
    out = f"conv_id {types['conv_id']}, turn {types['turn']}, position bigint, role string, text string, rendered string, loss struct<start:bigint,end:bigint>"
    arrow = [("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string()), ("loss", pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []

        def noted():
            for b in batches:
                kinds[:] = [b.schema.field(0).type, b.schema.field(1).type]
                yield b

        def flush(rows):
            schema = pa.schema([("conv_id", kinds[0]), ("turn", kinds[1]), *arrow])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows, size = [], 0
        for conv, turn, position, role, text in _messages(noted()):
            rendered, start, end = render(role, text)
            rows.append((conv, turn, position, role, text, rendered, {"start": start, "end": end} if role in TRAINED else None))
            size += len(rendered)
            if len(rows) >= 2048 or size > 4 << 20:
                yield flush(rows)
                rows, size = [], 0
        if rows:
            yield flush(rows)

    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "copy", "seq")
    return dealt.select("conv_id", "turn", "copy", "kind", "role", "text").mapInArrow(run, out)


def read_back(formatted: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Parse formatted conversations again and digest what was read.

    Takes the rows of ``format_log``, which are dealt by conversation and sorted
    by position first. ``ordered``: they still lie as they left that operator, so
    need neither; an error is raised where that turns out to be wrong. A message is
    read from its rendered segment alone; the loss mask is applied to the segment.
    A null id is a value like others; an empty table gives an empty table; texts
    of any length are read one message at a time; repeated positions raise.
    """
    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    conv_type = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, now, kind = None, None, pa.null()

        def closed():
            turns, n, loss, loss_chars, chars = now
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        def flush():
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for b in batches:
            kind = b.schema.field(0).type
            for c, position, rendered, mask in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or c != conv:
                    if now is not None:
                        done.append(closed())
                    conv, now = c, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if position != now[1]:
                    raise ValueError(f"message {position} of conversation {c} is where message {now[1]} should be")
                head, body = rendered[len(OPEN) : rendered.index(CLOSE, len(OPEN))].split("\n", 1)
                now[0].update(f"{unescape_role(head)}\n{unescape(body)}\n".encode())
                now[1] += 1
                if mask is not None:
                    trained = unescape(rendered[mask["start"] : mask["end"]])
                    now[2].update(trained.encode())
                    now[3] += len(trained)
                now[4] += len(rendered)
            if len(done) >= 2048:
                yield flush()
                done = []
        if now is not None:
            done.append(closed())
        if done:
            yield flush()

    return formatted.select("conv_id", "position", "rendered", "loss").mapInArrow(
        run, f"conv_id {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def log_of_turns(conversations: DataFrame, delta_chars: int = 256) -> DataFrame:
    """A table of finished turns as the log that would have led to it: assistants stream in deltas.

    Turns with the same number are set apart by role and then text, repeated rows
    among them; a null text is empty; null roles, turns and ids are values like
    others; an empty table gives an empty log; other columns are dropped. A long
    text streams in as many deltas as it needs.
    """
    from pyspark.sql import Window

    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    # cut in one pass: a substring would look for its beginning from the start each time
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    streamed = F.transform(F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(pieces), lambda p: F.struct(F.lit("delta").alias("kind"), p.alias("piece")))
    whole = F.array(F.struct(F.lit("delta").alias("kind"), F.col("text").alias("piece")))
    opened = F.array(F.struct(F.lit("open").alias("kind"), F.lit("").alias("piece")))
    events = F.concat(opened, F.when(F.col("role") == "assistant", streamed).otherwise(whole))
    return rows.select("conv_id", "turn", "copy", "role", F.posexplode(events).alias("seq", "event")).select(
        "conv_id", "turn", "copy", "seq", F.col("event.kind").alias("kind"), "role", F.col("event.piece").alias("text")
    )


def escaping_probe(spark: SparkSession, like: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant who both say control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string").select(
        *(F.col(c).cast(like.schema[c].dataType) for c in ("conv_id", "turn", "role", "text"))
    )
