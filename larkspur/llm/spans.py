"""Spans as rows of ``array<struct<kind, start, end, value, base>>`` and their digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,value:string,base:boolean>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())]))


def scored_spans() -> tuple[str, pa.DataType, list[str]]:
    """Type as DDL and as Arrow type, and field names, of spans with a score in bits (null without a model)."""
    fields = [*SPAN_ARROW.value_type, pa.field("bits", pa.float64())]
    return SPAN_DDL.replace("base:boolean", "base:boolean,bits:double"), pa.list_(pa.struct(fields)), [f.name for f in fields]


def count(spans: str, kind: str) -> Column:
    """Base spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


def joined(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_digest(spans: str) -> Column:
    return F.sha2(joined(F.filter(spans, lambda s: s["base"])).cast("binary"), 256)
