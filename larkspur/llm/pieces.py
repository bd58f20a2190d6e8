"""SentencePiece encoding and decoding through a distinct-chunk table.

When no piece of the vocabulary has a whitespace marker after another
character, no merge can cross from the end of a word into the marker of the
next one. A text is then the concatenation of *marked words* (a run of markers
and what follows up to the next marker), and each of them is segmented alone.
Words repeat, so each distinct marked word of a task goes through the library
once; the ids of a text are joined back from that table by position.

The table belongs to the task and is emptied when it reaches
``TABLE_LIMIT`` entries, which bounds memory without changing any result. A
table for the whole corpus would need each word of each text to cross a shuffle
twice, which is many times the input; a task's table needs no shuffle, so
hot sources and groups of copies have no effect either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Distinct marked words that a task holds at most.
TABLE_LIMIT = 300_000
MARK = "▁"

_MARKED_WORD = re.compile(" +[^ ]*")


class ChunkTable:
    """Ids of marked words as little-endian unsigned 32-bit integers, by word."""

    def __init__(self, model_path: str, limit: int = TABLE_LIMIT):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.limit = limit
        self.table: dict[str, bytes] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers; chunks can't be segmented alone")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.lone = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with begin and end ids."""
        words = [_MARKED_WORD.findall(f" {t}".replace(MARK, " ")) if t else [] for t in texts]
        if len(self.table) > self.limit:
            self.table.clear()
        new = set().union(*words).difference(self.table)
        if new:
            # the library adds one marker in front of what it gets, so the first one goes
            todo = [w for w in new if w != " "]
            for w, ids in zip(todo, self.sp.encode([w[1:] for w in todo], num_threads=1), strict=True):
                self.table[w] = np.array(ids, "<u4").tobytes()
            self.table[" "] = self.lone
        get = self.table.__getitem__
        return [b"".join((self.begin, *map(get, ws), self.end)) for ws in words]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.sp.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)


def encode_decode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text with begin and end ids, then decode those ids.

    Returns ``id_col``, ``n_tokens`` (bigint, all ids), ``ids`` (binary:
    little-endian unsigned 32-bit integers) and ``decoded`` (string), one row
    for each input row. A null text counts as empty, which has just the begin
    and end ids. Null ids, repeated rows and ties stay as they are; texts of any
    length are encoded as a whole; an empty table gives an empty table; other
    columns are dropped.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for b in batches:
            ids = table.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(table.decode(ids), pa.string())],
                [id_col, "n_tokens", "ids", "decoded"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens bigint, ids binary, decoded string")
